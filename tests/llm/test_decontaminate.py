import hashlib
import re

from downfield.llm import decontaminate as D
from tests.llm import fixtures as X

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def tokens(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, window=10):
    out = []
    for t in texts:
        w, hit, found = tokens(t), set(), set()
        for i, x in items:
            v = tokens(x)
            n = min(window, len(v))
            for k in range(len(v) - n + 1 if n and i is not None else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(i)
        out.append((len(w), sorted(hit), sorted(found)))
    return out


ITEMS = [(1, " ".join(X.words(30, 1))), (2, " ".join(X.words(12, 2))), (3, "w1é W2"), (4, None), (None, "one"), (5, ""), (6, " ".join(X.words(30, 1))), (20, "same TEXT twice here"), (3, "1 2 3 4 5 6 7 8 9 10 11")]
TEXTS = X.AWKWARD + [" ".join(X.words(50, 9) + X.words(30, 1)[5:25] + X.words(9, 8)), " ".join(X.words(30, 1) * 3), " ".join(X.words(12, 2)[:9]), "w1é, w2! W1É w2 w1é (w2)"]


def check(spark, **kw):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.decontaminate(X.docs(spark, TEXTS), items, **kw).collect()
    assert [(r["n_words"], r["hits"], r["items"]) for r in got] == brute(TEXTS, ITEMS, kw.get("window", 10))
    assert got[0]["text_"] == "y" and not any(c.startswith("__") for c in got[0].asDict())


def test_equal_to_brute_force(spark):
    check(spark)


def test_blocks_and_other_sizes(spark):
    check(spark, block_windows=7)
    check(spark, window=4, shingle=2)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.decontaminate(X.empty(spark), items).count() == 0
    got = D.decontaminate(X.docs(spark, ["a b"]), items.limit(0)).first()
    assert (got["n_words"], got["hits"], got["items"]) == (2, [], [])


def test_digest(spark):
    df = spark.createDataFrame([([2, 10, 1],), ([],)], "items array<long>").select(D.items_digest().alias("x"))
    assert [r["x"] for r in df.collect()] == [hashlib.sha256(b).hexdigest() for b in (b"1,10,2", b"")]

import random

import numpy as np
from pyspark.sql import functions as F

from downfield.llm import components as C, ngram_join as N, shared as S
from tests.llm import brute, fixtures as X


def near(words, edits, seed):
    r, w = random.Random(seed), list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    out = list(X.AWKWARD) + ["A b c d e F", "a B c d e f", "a b c d e f g", "x y z", "X Y z", "one two three four five six seven"]
    base, short, passage = X.words(120, 1, 5000), X.words(24, 2, 5000), X.words(60, 3, 5000)
    out += [near(base, k % 5, k) for k in range(150)]  # a large group of near copies, linked in part and in chains
    out += [near(base, 9 + k % 6, 1000 + k) for k in range(60)]
    out += [near(short, k % 3, 2000 + k) for k in range(120)]
    out += [" ".join(X.words(60, 100 + k, 9000) + passage + X.words(20, 300 + k, 9000)) for k in range(100)]  # a passage that many share
    out += [" ".join(passage[: 40 + k % 20]) + f" end{k % 30}" for k in range(90)]  # little else than the passage
    out += [" ".join(base)] * 80
    random.Random(7).shuffle(out)
    return out


def test_equal_to_brute_force(spark):
    docs = X.docs(spark, corpus()).withColumn("node", F.lit("x"))
    docs = docs.unionByName(docs.filter("doc_id % 50 = 1"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.join_components(docs).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute.components(rows), key=key)


def test_empty(spark):
    assert N.join_components(X.empty(spark)).count() == 0
    got = N.join_components(X.docs(spark, [None, "", "a"])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(0, 0, 0), (1, 0, 1), (2, 1, 2)]


def test_combinations_meet():
    """Any two linked sets of frequent tokens have a key in common."""
    r = random.Random(5)
    for n in (3, 4, 7, 8, 9, 31, 32, 33, 100, 257):
        for _ in range(20):
            pool = [r.getrandbits(64) for _ in range(2 * n)]
            x = pool[:n]
            y = None
            for drop in range(n, -1, -1):
                kept = x[: n - drop]
                extra = r.randint(0, drop)
                cand = kept + pool[n : n + extra]
                both = len(kept)
                if cand and 4 * both >= 3 * (n + len(cand) - both):
                    y = cand
                    break
            (a, p), (b, q) = (N.combinations(np.array(s, np.uint64), len(s)) for s in (x, y))
            one, two = dict(zip(a.tolist(), p.tolist())), dict(zip(b.tolist(), q.tolist()))
            assert any(7 * min(one[k], two[k]) >= 3 * (n + len(y)) for k in one.keys() & two.keys()), (n, len(y))


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 2000 + k) for k in range(200)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in list(parent)}
    got = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in got} == want and len(got) == len(want)
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_tokens_are_counted_in_parts(spark):
    """Each token of the first share of the hash space comes in one pass, and no pass has most of them."""
    docs = spark.createDataFrame([(k, " ".join(X.words(200, k, 3000))) for k in range(40)], "doc_id long, text string")
    seen = [{(r["token"], r["node"]) for r in N.first_tokens(docs, turn).collect()} for turn in range(N.PASSES)]
    raw = [t.encode() for _, t in docs.collect()]
    s = N.Sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    on = s.hash < np.uint64(int(N.FIRST * 2**64))
    want = set(zip(s.hash[on].view(np.int64).tolist(), s.node[s.row[on]].tolist()))
    assert set().union(*seen) == want and sum(map(len, seen)) == len(want)
    assert max(map(len, seen)) < 0.6 * len(want)


def test_tokens_of_nodes_left_are_counted_in_parts(spark, monkeypatch):
    """Each part holds the tokens of its own, so that a part's exchanges alone lie on disk."""
    parts, cut = [], N.cut

    def spied(df, label):
        out = cut(df, label)
        if label == "tokens":
            parts.append({r["token"] for r in out.collect()})
        return out

    monkeypatch.setattr(N, "cut", spied)
    r, rows = random.Random(4), []
    for k in range(40):
        w = X.words(60, k % 8, 3000)
        w[r.randrange(60)] = f"edit{k}"
        rows.append((k, " ".join(w)))
    got = sorted(tuple(x) for x in N.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute.components(rows))
    assert len(parts) == N.PASSES > 1 and all(t % N.PASSES == turn for turn, p in enumerate(parts) for t in p)


def test_a_full_heap_is_tidied(spark, monkeypatch):
    """The driver lets go of finished executions once its heap is in use beyond a share."""
    done = []
    monkeypatch.setattr(S, "tidy", done.append)
    S.discard(S.cut(spark.range(3), "test-heap"))
    assert not done
    monkeypatch.setattr(S, "FULL", 0.0)
    S.discard(S.cut(spark.range(3), "test-heap"))
    assert done == [spark]

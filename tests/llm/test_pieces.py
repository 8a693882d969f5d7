import random

import numpy as np
import pytest

from downfield.llm import pieces as P
from tests.llm import fixtures as X

PT = pytest.importorskip("public_tokenizers")
PATH = PT.path("piece_bpe_32k.model")
ALPHABET = "thereinganotiod.é,\n\t的0X-<_\U0001f600"


def texts(n, seed, length):
    r = random.Random(seed)
    out = []
    for k in range(n):
        t = "".join(r.choice(ALPHABET) for _ in range(r.randint(1, length)))
        if k % 2:
            t = " " * r.randint(0, 3) + t.replace("o", " ").replace("n", "  ") + " " * r.randint(0, 2)
        out.append(t)
    return out


def test_lattice_and_parts_equal_the_library():
    m = P.Model.at(PATH)
    for t in texts(120, 1, 100):
        want = m.library.encode(t)
        assert np.frombuffer(m.encode_texts([t])[0], np.int32).tolist() == want
        assert m.decode(np.array(want)) == m.library.decode(want)
        if " " not in t:
            assert m.trace(P.SPACE + t, 0, len(t) + 1, P.START, P.END, True, True) == want


def test_matrices_compose_associatively():
    m = P.Model.at(PATH)
    t = P.SPACE + "thereingan" * 30
    cuts = [0, 70, 140, 210, len(t)]
    each = [m.transfer(t, a, b, a == 0, b == len(t)) for a, b in zip(cuts, cuts[1:])]
    left = P.compose(P.compose(P.compose(each[0], each[1]), each[2]), each[3])
    right = P.compose(each[0], P.compose(each[1], P.compose(each[2], each[3])))
    assert left == right == m.transfer(t, 0, len(t), True, True)


def test_chunked_texts_equal_the_library(spark):
    m = P.Model.at(PATH)
    rows = X.AWKWARD[:11] + texts(60, 2, 400) + ["a" * 1000, " " * 500, "ab" + " " * 300 + "cd", "x" + "▁" * 90, "\n" * 200, "a b" * 100, "0123456789" * 40 + " " + "é" * 200]
    docs = X.docs(spark, rows).withColumnRenamed("hits", "ids")
    for chunk, fan in ((50, 2), (97, 3), (61, P.FAN), (P.CHUNK, P.FAN)):
        got = P.decode(P.encode(docs, PATH, chunk=chunk, round_trip="round_trip", fan=fan), PATH).collect()
        assert len(got) == len(rows) and "n_words" in got[0].asDict()
        for r in got:
            t = (r["text"] or "").replace(P.SPACE, " ")
            assert r["ids"] == m.library.encode(t), (chunk, t)
            assert r["decoded"] == t and r["round_trip"]


def test_empty(spark):
    assert P.decode(P.encode(X.empty(spark), PATH), PATH).count() == 0


def test_parts_cover_the_text():
    r = random.Random(4)
    for t in texts(200, 6, 300) + ["a" * 300, " " * 300, "a " * 150]:
        for chunk in (7, 20, 64):
            got = P.split_text(t, chunk)
            assert [b for b, _, _ in got] == [0, *(e for _, e, _ in got[:-1])] and got[-1][1:] == (len(t), False)
            for b, e, inside in got[:-1]:
                assert (t[e] != " " and t[e - 1] != " ") if inside else (t[e] == " " and t[e - 1] != " ")
    assert r


def test_giant_texts_go_through_matrices(spark):
    """The long texts of the tables are cut inside words, and the registered query's ids are the library's."""
    import os

    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        return
    docs = spark.read.parquet(path).filter(f"length(text) > {P.CHUNK}").select("doc_id", "text")
    rows = docs.collect()
    m = P.Model.at(PATH)
    chunks = P._chunks(docs.selectExpr("doc_id rid", "text"), P.CHUNK).filter("cut")
    inside = {r["doc_id"] for r in rows if any(" " not in r["text"][k - 1 : k + 1] for k in range(P.CHUNK, len(r["text"]), P.CHUNK))}
    assert {r["rid"] for r in chunks.collect()} == inside and len(inside) > 3
    got = {r["doc_id"]: r["ids"] for r in P.encode(docs, PATH).collect()}
    assert got == {r["doc_id"]: m.library.encode(r["text"]) for r in rows}

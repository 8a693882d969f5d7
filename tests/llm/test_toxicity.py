import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from downfield.llm import toxicity as T
from tests.llm import fixtures as X

BAD = ["vilewort", "grimble", "scumbo", "Ünfug"]


def corpus(spark, n=900):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = X.words(60, i, 300)
        y = int(r.random() < 0.25)
        for _ in range(3 * y):
            w[r.randrange(60)] = r.choice(BAD)
        rows.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, y))
    truth = {i: int(any(b in t.split() for b in BAD)) for i, t in rows}
    rows += [(n + 1, None), (n + 2, ""), (None, "grimble scumbo grimble"), (0, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("x")), spark.createDataFrame(labels + [(None, 1), (n + 7, 1)], "doc_id long, toxic int"), truth


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    model = T.fit(docs, labels)
    got = T.score(docs, model, evidence=True).collect()
    assert len(got) == len(truth) + 4
    for r in got:
        assert 0 <= r["toxicity"] <= 1
        if r["text"] is None or r["text"] == "":
            assert r["toxicity"] == model.empty < 0.2 and r["evidence"] == []
        elif r["doc_id"] is None:
            assert r["toxicity"] >= T.REJECT and all(0 < e["similarity"] < 1.0001 for e in r["evidence"])
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [(r["toxicity"] >= T.REJECT) == bool(truth[r["doc_id"]]) for r in held]
    assert len(held) > 200 and sum(right) >= 0.98 * len(right)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels, _ = corpus(spark, 300)
    other = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (T.score(docs, T.fit(docs, x)).select("toxicity").collect() for x in (labels, other))
    assert one == two


def test_search_is_exact():
    r = np.random.default_rng(1)
    vectors = []
    for i in range(700):
        f = np.sort(r.choice(60, r.integers(1, 8), replace=False))
        w = r.random(len(f)) + 0.01
        vectors.append((f, w / np.sqrt(w @ w)) if i % 9 else vectors[0] if vectors else (f, w / np.sqrt(w @ w)))
    index = T.BlockMax(vectors, 60)
    dense = np.zeros((700, 60))
    for i, (f, w) in enumerate(vectors):
        dense[i, f] = w
    for f, w in vectors[:150]:
        best, near = index.nearest(f, w, 15)
        all_ = dense[:, f] @ w
        want = np.lexsort((np.arange(700), -np.round(all_, 9)))[:15]
        want = want[all_[want] > 0]
        assert best.tolist() == want.tolist() and np.allclose(near, all_[want])


def test_isotonic():
    x, y = T.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert x.tolist() == [0.1, 0.2, 0.4] and y.tolist() == [0, 0.5, 1]


def test_empty(spark):
    docs, labels, _ = corpus(spark, 60)
    assert T.score(X.empty(spark), T.fit(X.empty(spark), labels)).count() == 0
    assert {r["toxicity"] for r in T.score(docs, T.fit(docs, labels.limit(0))).collect()} == {0.0}

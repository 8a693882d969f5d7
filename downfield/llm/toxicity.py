"""Toxicity by the nearest labelled examples, exact TF-IDF cosine and block-max inverted indexes.

Examples are a bounded sample of the labelled rows (``MAX_EXAMPLES`` of each class, by a hash of the id).  Features are the
words and the grams of five, seven and nine characters of lower-cased letters that are far likelier in toxic examples, all of
them; their document frequencies are counted over all documents.  A text's neighbours are its ``K`` examples of highest cosine: blocks of examples are bounded by each
feature's largest weight in them, and a block whose bound is below the k-th best so far is skipped, so the search is exact.
The neighbours vote by similarity, and isotonic calibration (leave-one-out over the examples, weighted back to the labels'
own shares) turns votes into probabilities.  A text without any feature gets the share of toxic examples without any.

Defined results: null and empty texts have no features; repeated rows get equal scores; very long texts are read whole; an
empty table gives no rows; without usable labels every score is 0; of examples that tie in cosine the first in the index's
order counts.  Labels of null or of ids that are not in the documents are not used; if an id is labelled more than once, its
highest label counts.  Columns named toxicity or evidence are replaced; all others are handed on.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from downfield.llm import bytetext as B
from downfield.llm.shared import bounded_batches, cut, discard

#: A feature's likelihood ratio against chance (G) has to make it no accident among a million grams.
MAX_EXAMPLES, LEAST_G, LEAST_LIFT = 4096, 26.0, 4.0
GRAMS, K, BLOCK = (5, 7, 9), 15, 64
#: Bytes of text whose grams are in memory at once.
PIECE = 1 << 18
REJECT = 0.7
_U = np.uint64


def _letters() -> np.ndarray:
    out = np.arange(0x250, dtype=np.uint32)
    for c in range(0x250):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 and unicodedata.category(low)[0] == "L" else 32
    return out


_LOWER = _letters()


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word and gram of a piece; a text is read with a space before and after it."""
    starts = (raw & 0xC0) != 0x80
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(starts, out=before[1:])
    first = np.minimum(before[at], len(chars))  # characters before each row
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n + 2)
    text = np.full(len(chars) + 2 * len(n), 32, np.uint32)
    low = chars.copy()
    small = chars < 0x250
    low[small] = _LOWER[chars[small]]
    text[np.arange(len(chars)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = low
    hashes, rows = [], []
    wide = text.astype(_U) + _U(1)
    h = np.zeros(len(text), _U)
    for n in range(1, min(max(GRAMS), len(text)) + 1):
        h = h[: len(text) - n + 1] * _U(0x100000001B3) + wide[n - 1 :]
        if n in GRAMS:
            inside = row[: len(h)] == row[n - 1 :]
            hashes.append(B.mix(h[inside]))
            rows.append(row[: len(h)][inside])
    begin, end, _ = B.runs(text != 32, np.array([0, len(text)]))
    sums = np.zeros(len(text) + 1, _U)
    np.cumsum(B.mix(wide) * B.powers(len(text)), out=sums[1:])
    hashes.append(B.mix((sums[end] - sums[begin]) * B.powers(len(text) + 1, inverse=True)[begin] + (end - begin).astype(_U)))
    rows.append(row[begin])
    return np.concatenate(hashes), np.concatenate(rows)


class Features:
    """The chosen grams: which of a piece's grams they are."""

    def __init__(self, hashes: list[int]):
        self.keys = np.sort(np.array(hashes, np.int64).view(_U)) if len(hashes) else np.zeros(0, _U)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> _U(44)).astype(np.int64)] = True

    def vectors(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, feature and count, by row, then feature."""
        h, row = grams(raw, at)
        on = np.flatnonzero(self.bits[(h >> _U(44)).astype(np.int64)])
        if not len(self.keys) or not len(on):
            z = np.zeros(0, np.int64)
            return z, z, z
        k = np.minimum(np.searchsorted(self.keys, h[on]), len(self.keys) - 1)
        hit = self.keys[k] == h[on]
        pair, times = np.unique(row[on][hit] * len(self.keys) + k[hit], return_counts=True)
        return pair // len(self.keys), pair % len(self.keys), times


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 3 == 1


def examples(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> tuple[DataFrame, dict[int, float]]:
    """Rows (doc_id, toxic, text) of at most ``most`` labelled documents of each class, and a class's labels per example."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    share: dict[int, float] = {}
    parts = []
    for y in (0, 1):
        of = known.filter(F.col("toxic") == y)
        n = of.count()
        share[y] = max(1.0, n / most)
        parts.append(of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * most rows of two numbers
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id"), share


def _distinct(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sorted hashes, each once for every row that has it."""
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[once]


def choose_features(rows: DataFrame) -> list[int]:
    """Hashes of the grams ``LEAST_LIFT`` times as frequent in toxic examples as in others, beyond chance.

    Only grams that are in enough toxic examples to pass, were they in no other, are counted in the others.
    """

    def in_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, at in B.pieces(batch, "text", PIECE):
                h, times = np.unique(_distinct(*grams(raw, at)), return_counts=True)
                yield pa.record_batch({"h": pa.array(h.view(np.int64)), "n": pa.array(times.astype(np.int64))})

    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    share = max(n1, 1) / max(n1 + n0, 1)
    least = max(2.0, LEAST_G / (2 * max(-math.log(share), 1e-9)))
    of = rows.filter("toxic = 1").select("text").mapInArrow(in_toxic, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    ones = of.toArrow()  # bounded by the number of examples; never as Python objects
    if not ones.num_rows:
        return []
    hashes = ones.column("h").to_numpy().view(_U)
    order = np.argsort(hashes)
    keys, toxic = hashes[order], ones.column("n").to_numpy()[order].astype(float)
    shared = rows.sparkSession.sparkContext.broadcast(Features(keys.view(np.int64)))

    def in_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shared.value
        n = np.zeros(len(features.keys), np.int64)
        for batch in batches:
            for _, raw, at in B.pieces(batch, "text", PIECE):
                n += np.bincount(features.vectors(raw, at)[1], minlength=len(n))
        on = np.flatnonzero(n)
        yield pa.record_batch({"f": pa.array(on.astype(np.int32)), "n": pa.array(n[on])})

    others = np.zeros(len(keys))
    got = rows.filter("toxic = 0").select("text").mapInArrow(in_others, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    others[got.column("f").to_numpy()] = got.column("n").to_numpy()
    shared.unpersist()
    n = toxic + others
    lift = ((toxic + 0.5) / (n1 + 1)) / ((others + 0.5) / (n0 + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (toxic * np.log(toxic / (n * share)) + np.where(others > 0, others * np.log(others / (n * max(1 - share, 1e-9))), 0.0))
    return keys[(lift >= LEAST_LIFT) & (g >= LEAST_G)].view(np.int64).tolist()


def document_frequencies(docs: DataFrame, features: Features) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each feature, over the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(features.keys), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, raw, at in B.pieces(batch, "text", PIECE):
                df += np.bincount(features.vectors(raw, at)[1], minlength=len(df))
        on = np.flatnonzero(df)
        yield pa.record_batch({"f": pa.array(np.concatenate(([-1], on)).astype(np.int32)), "n": pa.array(np.concatenate(([n], df[on])))})

    out, n = np.zeros(len(features.keys), np.int64), 0
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        if r["f"] < 0:
            n = r["n"]
        else:
            out[r["f"]] = r["n"]
    return n, out


class BlockMax:
    """An inverted index of unit vectors with the largest weight of each feature in each block of documents."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_features: int):
        f = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)])
        w = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
        d = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        order = np.lexsort((d, f))
        self.doc, self.weight, f = d[order], w[order], f[order]
        self.begin = np.searchsorted(f, np.arange(n_features + 1))
        self.blocks = -(-len(vectors) // BLOCK)
        self.size = len(vectors)
        self.most = np.zeros((n_features, self.blocks))
        np.maximum.at(self.most, (f, self.doc // BLOCK), self.weight)

    def _scores(self, features: np.ndarray, weights: np.ndarray, block: np.ndarray) -> np.ndarray:
        docs, parts = [], []
        for f, w in zip(features.tolist(), weights.tolist()):
            a, b = self.begin[f], self.begin[f + 1]
            d = self.doc[a:b]
            on = block[d // BLOCK]
            docs.append(d[on])
            parts.append(w * self.weight[a:b][on])
        return np.bincount(np.concatenate(docs), np.concatenate(parts), self.size)

    def nearest(self, features: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k documents of highest positive cosine, ties by place, and their cosines."""
        bound = weights @ self.most[features]
        order = np.argsort(-bound, kind="stable")
        chosen = np.zeros(self.blocks, bool)
        now = order[:2]
        scores = np.zeros(self.size)
        while True:
            fresh = np.zeros(self.blocks, bool)
            fresh[now] = True
            scores += self._scores(features, weights, fresh)
            chosen |= fresh
            least = np.partition(scores, -k)[-k] if self.size > k else 0.0
            left = order[~chosen[order] & (bound[order] >= max(least - 1e-9, 1e-12))]
            if not len(left):
                break
            now = left[: 2 * len(now)]
        best = np.lexsort((np.arange(self.size), -np.round(scores, 9)))[:k] if self.size <= 256 else None
        if best is None:
            some = np.flatnonzero(scores >= least - 1e-9) if least > 0 else np.flatnonzero(scores > 0)
            best = some[np.lexsort((some, -np.round(scores[some], 9)))][:k]
        best = best[scores[best] > 0]
        return best, scores[best]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best non-decreasing fit: score from each x on."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b * c
            pools[-1][2] += c
        else:
            pools.append([a, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """Index, weights and calibration; everything in it is bounded by the numbers of examples and features."""

    def __init__(self, features: Features, idf: np.ndarray, ids: list, labels: np.ndarray, counts: list, share: dict[int, float]):
        self.features, self.idf = features, idf
        weight = np.where(labels > 0, share.get(1, 1.0), share.get(0, 1.0))
        some = [i for i, (f, _) in enumerate(counts) if len(f)]
        none = [i for i, (f, _) in enumerate(counts) if not len(f)]
        # like examples side by side make blocks' bounds tight
        some.sort(key=lambda i: (int(counts[i][0][np.argmax(self.idf[counts[i][0]])]), int(labels[i]), ids[i]))
        self.ids, self.labels = [ids[i] for i in some], labels[some].astype(float)
        vectors = [self.unit(*counts[i]) for i in some]
        self.index = BlockMax(vectors, len(features.keys))
        # shares of toxic examples, with one clean document put to those without features
        self.empty = float(weight[none] @ labels[none]) / (float(weight[none].sum()) + 1.0) if none else 0.0
        votes = np.array([self.vote(*v, leave=j) for j, v in enumerate(vectors)])
        self.steps, self.rates = isotonic(votes, self.labels, weight[some]) if len(some) else (np.zeros(0), np.zeros(0))

    def unit(self, features: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(times)) * self.idf[features]
        return features, w / np.sqrt(w @ w)

    def vote(self, features: np.ndarray, weights: np.ndarray, leave: int = -1) -> float:
        best, near = self.index.nearest(features, weights, K + (leave >= 0))
        if leave >= 0:
            keep = best != leave
            best, near = best[keep][:K], near[keep][:K]
        if not len(best):
            return 0.0
        w = 1 / (1.05 - np.minimum(near, 1))  # by distance
        return round(float(w @ self.labels[best] / w.sum()), 9)

    def score(self, features: np.ndarray, times: np.ndarray) -> float:
        if not len(features) or not len(self.steps):
            return self.empty
        at = np.searchsorted(self.steps, self.vote(*self.unit(features, times)), side="right") - 1
        return float(np.clip(self.rates[max(at, 0)], 0, 1))

    def evidence(self, features: np.ndarray, times: np.ndarray) -> list[dict]:
        if not len(features) or not len(self.steps):
            return []
        best, near = self.index.nearest(*self.unit(features, times), K)
        return [{"doc_id": self.ids[i], "similarity": float(s), "toxic": int(self.labels[i])} for i, s in zip(best.tolist(), near.tolist())]


def fit(docs: DataFrame, labels: DataFrame, most_examples: int = MAX_EXAMPLES) -> Model:
    bounded_batches(docs.sparkSession)
    rows, share = examples(docs, labels, most_examples)
    rows = cut(rows, "toxicity-examples")  # read more than once, and bounded
    features = Features(choose_features(rows))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in B.pieces(batch, "text", PIECE):
                row, f, n = features.vectors(raw, at)
                cutpoints = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = lambda v: pa.ListArray.from_arrays(pa.array(cutpoints.astype(np.int32)), pa.array(v.astype(np.int32)))
                yield pa.record_batch([part.column("doc_id"), part.column("toxic"), lists(f), lists(n)], names=["doc_id", "toxic", "f", "n"])

    got = rows.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, f array<int>, n array<int>").toArrow().combine_chunks()  # bounded by the examples
    ids, toxic = got.column("doc_id").to_pylist(), got.column("toxic").to_pylist()
    lists = [[x.values.to_numpy().astype(np.int32) for x in got.column(c)] for c in ("f", "n")]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], lists[0][i].tobytes(), lists[1][i].tobytes()))
    discard(rows)
    n, df = document_frequencies(docs, features)
    idf = np.log((1 + n) / (1 + df)) + 1
    return Model(features, idf, [ids[i] for i in order], np.array([toxic[i] for i in order], int), [(lists[0][i], lists[1][i]) for i in order], share)


def score(docs: DataFrame, model: Model, text: str = "text", evidence: bool = False) -> DataFrame:
    """The columns of ``docs``, toxicity (0 to 1) and, if asked for, the evidence; columns so named before are replaced."""
    bounded_batches(docs.sparkSession)
    new = ["toxicity", *(["evidence"] if evidence else [])]
    keep = [c for c in docs.columns if c not in new]
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the numbers of examples and features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, raw, at in B.pieces(batch, "__text", PIECE):
                row, f, n = m.features.vectors(raw, at)
                out = np.full(part.num_rows, m.empty)
                found: list[list] = [[] for _ in range(part.num_rows)]
                begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else []
                for a, b in zip(begin, [*begin[1:], len(row)]):
                    out[row[a]] = m.score(f[a:b], n[a:b])
                    if evidence:
                        found[row[a]] = m.evidence(f[a:b], n[a:b])
                yield pa.record_batch([*part.columns[:-1], pa.array(out), *([pa.array(found, kind)] if evidence else [])], names=[*keep, *new])

    more = ", evidence array<struct<doc_id:bigint,similarity:double,toxic:int>>" if evidence else ""
    return rows.mapInArrow(run, f"{fields}, toxicity double{more}")

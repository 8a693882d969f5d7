"""Benchmark decontamination by a prefix-filtered set join.

Each item is cut into windows of ``window`` consecutive words (an item of fewer words is one window).  A window is the
set of its ``shingle``-word shingles, ordered by how rare they are in the whole corpus.  Containment of the whole window is
asked for, so the necessary prefix is the rarest shingle alone: a document that lacks it cannot hold the window.
Documents look up that prefix token, its place in the window gives the only place where the window can begin (positional
bound), the window has to end inside the text (length bound), and the words are compared one by one.

Defined results: a null text has no words; an item without words or with a null id has no windows; items of equal windows all
count; of a window's shingles that tie in rarity the one of the least hash is the prefix; very long texts are read whole; an
empty benchmark or document table gives no hits or no rows; repeated rows each get their result; columns named as the new ones
are replaced, other columns are handed on unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from downfield.llm import bytetext as B
from downfield.llm.shared import bounded_batches, cut, discard

WINDOW, SHINGLE = 10, 5
#: Windows in one broadcast index; a larger benchmark is taken in blocks of this many, each of bounded size.
BLOCK_WINDOWS = 200_000
_BITS = 22
_U = np.uint64


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows, words joined by spaces, each with the ids of its items."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in B.pieces(batch, "text"):
                w = B.Words(raw, at, B.ALNUM, True)
                ids, data = part.column(0).to_pylist(), w.raw.tobytes()
                keys, items = [], []
                for r, i in enumerate(ids):
                    a, b = w.first[r], w.first[r + 1]
                    words = [data[s:e].decode() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist())]
                    for k in range(max(1, len(words) - window + 1) if words else 0):
                        keys.append(" ".join(words[k : k + window]))
                        items.append(i)
                yield pa.record_batch({"key": pa.array(keys, pa.string()), "item": pa.array(items, pa.int64())})

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("item_id is not null and text is not null")
    return rows.mapInArrow(windows, "key string, item long").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return B.Words(raw, np.array([0, len(raw)]), B.ALNUM, True).hash


class _Lookup:
    """Which of many hashes are in a small set, and where: a bit map first, then a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.keys >> _U(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[(hashes >> _U(64 - _BITS)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return at[:0]
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        return at[self.keys[k] == hashes[at]]


def _window_shingles(h: np.ndarray, shingle: int) -> np.ndarray:
    return B.shingles(h, min(shingle, len(h)))


def rarity(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """How often each given shingle occurs in the corpus, by shingle length; counted over every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {n: _Lookup(k) for n, k in keys.items()}
        for batch in batches:
            for _, raw, at in B.pieces(batch, "text"):
                w = B.Words(raw, at, B.ALNUM, True)
                for n, table in look.items():
                    s = B.shingles(w.hash, n)
                    p = table.find(s)
                    p = p[w.row[p] == w.row[p + n - 1]]
                    got, times = np.unique(s[p], return_counts=True)
                    yield pa.record_batch({"n": pa.array(np.full(len(got), n, np.int32)), "h": pa.array(got.view(np.int64)), "times": pa.array(times.astype(np.int64))})

    out: dict[int, dict[int, int]] = {n: {} for n in keys}
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n int, h long, times long").groupBy("n", "h").agg(F.sum("times").alias("times"))
    for r in found.collect():  # at most the shingles of one block of windows
        out[r["n"]][r["h"]] = r["times"]
    return out


def _index(windows: list, times: dict[int, dict[int, int]], shingle: int) -> dict:
    """prefix token -> windows that need it: (place of the token, word hashes, words, items)."""
    index: dict[int, dict[int, list]] = {}
    for key, items in windows:
        h = _word_hashes(key)
        s = _window_shingles(h, shingle).view(np.int64).tolist()
        n = min(shingle, len(h))
        rank = [(times[n].get(x, 0), x, i) for i, x in enumerate(s)]
        rarest = min(rank)
        if rarest[0]:  # a window whose rarest shingle is nowhere in the corpus cannot occur
            index.setdefault(n, {}).setdefault(rarest[1], []).append((rarest[2], h, key.encode(), items))
    return index


def _match(docs: DataFrame, shared) -> DataFrame:
    """Add this block's hit words (places in the text's words) and items to the columns ``hits`` and ``items``."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        look = {n: _Lookup(np.array(list(t), np.int64).view(_U)) for n, t in index.items()}
        for batch in batches:
            for part, raw, at in B.pieces(batch, "text"):
                w = B.Words(raw, at, B.ALNUM, True)
                data, counts = w.raw.tobytes(), w.counts()
                hit = np.zeros(len(w.hash) + 1, np.int64)
                items: dict[int, set] = {}
                for n, t in index.items():
                    s = B.shingles(w.hash, n)
                    places = look[n].find(s)
                    for p, x in zip(places.tolist(), s[places].view(np.int64).tolist()):
                        row = w.row[p]
                        for place, h, key, ids in t[x]:
                            a, b = p - place, p - place + len(h)
                            if a < w.first[row] or b > w.first[row + 1] or not np.array_equal(w.hash[a:b], h):
                                continue
                            if b" ".join(data[i:j] for i, j in zip(w.start[a:b].tolist(), w.end[a:b].tolist())) == key:
                                hit[a] += 1
                                hit[b] -= 1
                                items.setdefault(int(row), set()).update(ids)
                on = np.cumsum(hit)[:-1] > 0
                old_hits, old_items = part.column("hits").to_pylist(), part.column("items").to_pylist()
                hits, found = [], []
                for r in range(part.num_rows):
                    mine = np.flatnonzero(on[w.first[r] : w.first[r + 1]]).tolist() if r in items else []
                    hits.append(sorted({*(old_hits[r] or []), *mine}) if old_hits[r] else mine)
                    found.append(sorted({*(old_items[r] or []), *items.get(r, ())}))
                new = {"n_words": pa.array(counts.astype(np.int64)), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([new.get(f.name, part.column(i)) for i, f in enumerate(part.schema)], names=part.schema.names)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Columns of ``docs`` with n_words, hits (places of hit words) and items (sorted ids of items that occur); columns so named before are replaced.

    One pass over the texts counts rarity, one finds the windows; a benchmark of more than ``block_windows`` windows adds a
    chained narrow pass per block, never a shuffle of the texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs.withColumns({"text": F.col("text").cast("string"), "n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<long>")})
    all_windows = cut(item_windows(benchmark, window), "windows")
    blocks = max(1, -(-all_windows.count() // block_windows))
    for b in range(blocks):
        part = all_windows if blocks == 1 else all_windows.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        windows = [(r["key"], r["items"]) for r in part.collect()]
        keys: dict[int, set] = {}
        for key, _ in windows:
            h = _word_hashes(key)
            keys.setdefault(min(shingle, len(h)), set()).update(_window_shingles(h, shingle).tolist())
        times = rarity(docs, {n: np.array(sorted(k), _U) for n, k in keys.items()}) if windows else {}
        out = _match(out, spark.sparkContext.broadcast(_index(windows, times, shingle)))
    discard(all_windows)
    return out


def items_digest(items: DataFrame | str = "items"):
    return F.sha2(F.array_join(F.array_sort(F.transform(F.col(items), lambda x: x.cast("string"))), ","), 256)

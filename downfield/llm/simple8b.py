"""Token-id files in Simple-8b words, written and read through Spark's own file access.

A file is a run of blocks, each followed by ``SEPARATOR``.  A block holds whole ids of one or more documents:

    magic 4s | shard u32 | n_docs u32 | n_words u32 | n_marks u32 | n_ids u64
    doc ids i64[n_docs] | flags u8[n_docs] (1: id is null, 2: continues the previous block's document)
    ids of each document u32[n_docs] | marks u32[n_marks] | words u64[n_words]

marks[k] is the number of ids before word k * MARK, so that a reader can start at any mark (see ``read_from``).  The upper four bits of a word
are its selector; selector 15 says that the next word is one raw 64-bit value (the escape for values of over 60 bits).

Defined results: a null text is empty and has the end id alone; rows of equal doc_id lie together, ordered by a hash of the text, and repeated
rows are documents of their own; null ids come first; very long texts go on over several blocks; only doc_id and text are read, so
other columns clash with nothing; an empty table writes no block.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from downfield.llm.shared import cut, fresh_path

MAGIC, SEPARATOR, MARK = b"DFS8", "\x00DF\n", 128
#: Ids in a block, about; a longer document goes on in the next block.
BLOCK_IDS = 1 << 16
RANGE_BYTES = 256 << 20
#: selector -> values in a word of 60 bits each side of which are 60 // n bits wide.
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
_HEAD = struct.Struct("<4sIIIIQ")
_U = np.uint64


_WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.uint8)
_LIMITS = np.array([1 << int(b) for b in _WIDTHS[:-1]], np.uint64)


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of 64-bit unsigned values: each word takes the most values that fit, zero padded at the end."""
    v = values.astype(_U)
    n = len(v)
    if not n:
        return np.zeros(0, _U)
    width = _WIDTHS[np.searchsorted(_LIMITS, v, side="right")]
    # widest[j][i]: the most of 2 ** j widths from i on; past the end there is padding, which always fits
    widest = [np.concatenate((width, np.zeros(60, np.uint8)))]
    for j in range(5):
        last = widest[-1]
        widest.append(np.maximum(last, np.concatenate((last[1 << j :], np.zeros(1 << j, np.uint8)))))
    pick = np.full(n, ESCAPE, np.uint8)
    for s in range(len(PER_WORD) - 1, -1, -1):
        k = PER_WORD[s]
        j = k.bit_length() - 1
        most = np.maximum(widest[j][:n], widest[j][k - (1 << j) : k - (1 << j) + n])
        np.putmask(pick, most <= 60 // k, s)
    take = np.array([*PER_WORD, 1, 1])[pick]  # escapes too take one value
    starts, i, step = [], 0, take.tolist()
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    chosen = pick[starts]
    escaped = chosen == ESCAPE
    at = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(escaped)[:-1]))
    words = np.zeros(len(starts) + int(escaped.sum()), _U)
    words[at] = chosen.astype(_U) << _U(60)
    words[at[escaped] + 1] = v[starts[escaped]]
    padded = np.concatenate((v, np.zeros(60, _U)))
    for s in np.unique(chosen[~escaped]):
        k = PER_WORD[s]
        on = np.flatnonzero(chosen == s)
        got = words[at[on]]
        for j in range(k):
            got |= padded[starts[on] + j] << _U(j * (60 // k))
        words[at[on]] = got
    return words


def counts_of(words: np.ndarray) -> np.ndarray:
    """How many values each word yields (0 for an escape's selector word, 1 for its raw word)."""
    table = np.array([*PER_WORD, 0, 0], np.int64)
    sel = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)  # words may end with a selector whose raw word is not among them
    if (sel == ESCAPE).any():  # a raw word may look like a selector, so walk from escape to escape
        i = 0
        for p in np.flatnonzero(sel == ESCAPE).tolist():
            if p >= i:
                raw[p + 1] = True
                i = p + 2
    out = table[sel]
    out[raw[:-1]] = 1
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of the words; each selector's words are decoded at once."""
    count = counts_of(words)
    start = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(start[-1]), _U)
    raw = np.zeros(len(words), bool)
    raw[1:] = count[:-1] == 0
    out[start[:-1][raw]] = words[raw]
    sel = (words >> _U(60)).astype(np.int64)
    for s in np.unique(sel[~raw & (count > 0)]):
        k = PER_WORD[s]
        on = np.flatnonzero((sel == s) & ~raw)
        for j in range(k):
            out[start[on] + j] = (words[on] >> _U(j * (60 // k))) & ((_U(1) << _U(60 // k)) - _U(1))
    return out[:n]


def block(shard: int, doc_ids: list, flags: list, counts: list, ids: np.ndarray) -> bytes:
    words = pack(ids)
    before = np.concatenate(([0], np.cumsum(counts_of(words))[:-1])) if len(words) else np.zeros(0)
    marks = before[::MARK].astype(np.uint32)
    head = _HEAD.pack(MAGIC, shard, len(doc_ids), len(words), len(marks), len(ids))
    return b"".join((head, np.array(doc_ids, np.int64).tobytes(), np.array(flags, np.uint8).tobytes(), np.array(counts, np.uint32).tobytes(), marks.tobytes(), words.tobytes()))


def read_blocks(content: bytes) -> Iterator[tuple[int, list, list, list, np.ndarray]]:
    at = 0
    while at < len(content):
        magic, shard, n_docs, n_words, n_marks, n_ids = _HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += _HEAD.size
        parts = []
        for kind, n in ((np.int64, n_docs), (np.uint8, n_docs), (np.uint32, n_docs), (np.uint32, n_marks), (_U, n_words)):
            parts.append(np.frombuffer(content, kind, n, at))
            at += np.dtype(kind).itemsize * n
        at += len(SEPARATOR)
        yield shard, parts[0].tolist(), parts[1].tolist(), parts[2].tolist(), unpack(parts[4], n_ids)


def read_from(content: bytes, begin: int, n: int) -> np.ndarray:
    """Ids ``begin`` to ``begin + n`` of a block's content, decoded from the mark before them on and no further than they go."""
    _, _, n_docs, n_words, n_marks, n_ids = _HEAD.unpack_from(content)
    at = _HEAD.size + n_docs * (8 + 1 + 4)
    marks = np.frombuffer(content, np.uint32, n_marks, at)
    words = np.frombuffer(content, _U, n_words, at + 4 * n_marks)
    stop = min(begin + n, n_ids)
    first = max(int(np.searchsorted(marks, begin, side="right")) - 1, 0)
    last = int(np.searchsorted(marks, stop, side="left"))
    lead = first * MARK
    if lead and words[lead - 1] >> _U(60) == ESCAPE and counts_of(words[:lead])[-1] == 0:
        lead -= 1  # the mark stands between an escape and its raw word
    part = words[lead : last * MARK + 1]
    before = int(marks[first]) if n_marks else 0
    return unpack(part, stop - before)[begin - before :]


#: Characters that no normal form changes and on which this module and the library agree about letters, numbers and spaces.
_UNSURE = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
_LETTER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The letters stand first, as most parts begin with one and no other alternative does.
_PARTS = re.compile(f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^\t-\r \x85\xa0{_LETTER}{_NUMBER}]+")
_ENDS = "</w>"


class Encoder:
    """A tokenizers file of lower-cased words with word ends, each different word of plain texts encoded once while the cache, or the one before it, lasts.

    The library encodes the words, many in one call, and the ids are cut after each word's end.  A text with characters
    beyond the plain ones, or with what may be a special token, goes to the library as a whole.
    """

    CACHE, TOGETHER = 200_000, 2_000
    _open: dict[str, "Encoder"] = {}

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls._open:  # a worker that is used again keeps its cache
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.old = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_ENDS)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32).tobytes()

    def learn(self, words: list[str]) -> None:
        for k in range(0, len(words), self.TOGETHER):
            some = words[k : k + self.TOGETHER]
            ids = np.frombuffer(self.whole(" ".join(some)), np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some) and (not len(ids) or stop[-1] == len(ids)):
                data, begin = ids.tobytes(), 0
                for w, end in zip(some, (4 * stop).tolist()):
                    self.cache[w] = data[begin:end]
                    begin = end
            else:
                for w in some:
                    self.cache[w] = self.whole(w)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if "<|" in t or not t.isascii() and _UNSURE.search(t) else _PARTS.findall(t.lower()) for t in texts]
        known = [s for s in split if s is not None]
        met = set().union(*known)
        new = met - self.cache.keys()
        if len(self.cache) + len(new) > self.CACHE:  # memory stays bounded; what is met in neither of the last two caches is encoded again
            self.old, self.cache, new = self.cache, {}, met
        known_before = new & self.old.keys()
        self.cache.update((w, self.old[w]) for w in known_before)
        self.learn(list(new - known_before))
        get = self.cache.__getitem__
        return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]


def _ranges(docs: DataFrame) -> int:
    """Ranges of about ``RANGE_BYTES`` by the size that Spark knows of the input, and not fewer than it deals by default."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    default = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(default, -(-known // RANGE_BYTES)) if known < 1 << 60 else default  # a size that large stands for one that isn't known


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the ids in ascending order of doc_id.

    The texts are dealt by ranges of doc_id and each task writes one file, whose shard number follows the ranges.  There are so many
    ranges that a file stays far below what one read can hold.  Equal ids follow each other by a hash of the text, then the text;
    null ids come first; an empty table writes no block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.at(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32).tobytes()
        ids, flags, counts, data, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            out = block(shard, ids, flags, counts, np.frombuffer(b"".join(data), np.uint32))
            for x in (ids, flags, counts, data):
                x.clear()
            held = 0
            return pa.record_batch({"block": pa.array([out], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, got in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    got, more = got + end, False
                    while got:
                        now, got = got[: 4 * (BLOCK_IDS - held)], got[4 * (BLOCK_IDS - held) :]
                        ids.append(i or 0)
                        flags.append((i is None) + 2 * more)
                        counts.append(len(now) // 4)
                        data.append(now)
                        held, more = held + len(now) // 4, True
                        if held >= BLOCK_IDS:
                            yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))  # rows of one id are dealt by it too
    rows = rows.repartitionByRange(_ranges(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    rows.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_ids(spark, path: str) -> DataFrame:
    """shard, start (ids before it in the shard), doc_id, n_tokens, ids (u32 little-endian) of each document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                at, open_doc = 0, None
                for shard, ids, flags, counts, values in read_blocks(content.as_py()):
                    values, rows, begin = values.astype(np.uint32), [], 0
                    for i, flag, n in zip(ids, flags, counts):
                        data = values[begin : begin + n].tobytes()
                        begin += n
                        if flag & 2:
                            open_doc[3].append(data)
                        else:
                            if open_doc:
                                rows.append(open_doc)
                            open_doc = [shard, at, None if flag & 1 else i, [data]]
                        at += n
                    if rows:
                        yield _rows(rows)
                if open_doc:
                    yield _rows([open_doc])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "shard int, start long, doc_id long, ids binary")


def _rows(rows: list) -> pa.RecordBatch:
    shard, start, ids, data = zip(*rows)
    return pa.record_batch({"shard": pa.array(shard, pa.int32()), "start": pa.array(start, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "ids": pa.array([b"".join(d) for d in data], pa.binary())})


def with_totals(rows: DataFrame) -> DataFrame:
    """``start`` counted over all shards; there are as many shards as files, so their running sum is small."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base"))
    return rows.join(base, "shard").withColumn("start", F.col("start") + F.col("base")).drop("base")


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files, read them back: shard, start, doc_id, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "simple8b")
    write_ids(docs, tokenizer, path, end_id)
    rows = read_ids(spark, path).select("shard", "start", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return with_totals(cut(rows, "token-rows"))

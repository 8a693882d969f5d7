"""SentencePiece encoding and decoding as a max-plus parallel scan.

The model is a byte-pair one, whose merges a plain sum of piece scores does not reproduce.  Its result is, however, the only
segmentation in which every two neighbouring pieces are what the merges make of their joined text, so it is the best path of
a lattice whose nodes are pieces and whose edges weigh 0 where neighbours agree and minus infinity where they do not.

A text of more than ``CHUNK`` characters is cut each ``CHUNK`` characters, wherever in a word that is.  The states of such a cut
are the pieces that end at or reach over it.  No piece crosses into a space that follows a word, so a boundary there has one
state, and only what lies between a cut and the spaces around it needs more: each such part yields the max-plus matrix from its
states at one side to those at the other (weights 0 and minus infinity, so for each state those from which it is reached), the
matrices of a run of parts are combined associatively, ``FAN`` at a time in rounds, and the states of the best path go back
down the same tree, so that each part traces its own pieces independently.  Between boundaries of one state, the library itself
encodes each different space-separated part once.

Defined results: a null text is empty and has no ids; U+2581 is a space, as for the library; repeated rows each get theirs; a
very long text without any space is one run of parts; of paths that tie there is only one, as merges take the leftmost of equal
scores; columns named as the new ones are replaced, all others are handed on; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from downfield.llm.shared import bounded_batches, cut

CHUNK, FAN = 32768, 64
#: Characters around a part that its boundary states need: more than two of the longest pieces.
AROUND = 64
SPACE = "▁"
START = END = ("", 0)


class Model:
    """A SentencePiece model file with the parts of it that the lattice needs."""

    CACHE = 200_000
    _open: dict[str, "Model"] = {}

    @classmethod
    def at(cls, path: str) -> "Model":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.id = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        if 2 * self.longest > AROUND:
            raise ValueError(f"pieces of {self.longest} characters need more than {AROUND} around a part")
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.bytes = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.cache: dict[str, bytes] = {}
        self.agreed: dict[tuple[str, str], bool] = {}

    # parts between spaces

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [parts(t) for t in texts]
        new = set().union(*split) - self.cache.keys()
        if len(self.cache) + len(new) > self.CACHE:
            self.cache = {}
            new = set().union(*split)
        new = list(new)
        for p, ids in zip(new, self.library.encode(new, num_threads=1)):
            self.cache[p] = np.array(ids or [self.id[SPACE]], np.int32).tobytes()
        get = self.cache.__getitem__
        return [b"".join(map(get, s)) for s in split]

    # the lattice

    def merge(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored neighbours join first, the leftmost of equals."""
        s = list(text)
        while len(s) > 1:
            score, at = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(s, s[1:]))))
            if score == -np.inf:
                break
            s[-at : 2 - at] = [s[-at] + s[1 - at]]
        return s

    def agree(self, a: str, b: str) -> bool:
        if not a:
            return True
        got = self.agreed.get((a, b))
        if got is None:
            if len(self.agreed) > 1_000_000:
                self.agreed.clear()
            got = self.agreed[a, b] = self.merge(a + b) == [a, b]
        return got

    def matches(self, text: str, at: int) -> list[str]:
        """The pieces that begin at ``at``; a character outside the vocabulary is a piece of its own."""
        out = [text[at : at + n] for n in range(1, min(self.longest, len(text) - at) + 1) if text[at : at + n] in self.id or n == 1]
        return [p for p in out if self.merge_ok(p)]

    def merge_ok(self, piece: str) -> bool:
        got = self.agreed.get((piece, ""))
        if got is None:
            got = self.agreed[piece, ""] = self.merge(piece) == [piece]
        return got

    def states(self, text: str, at: int) -> list[tuple[str, int]]:
        """The pieces (with how far they reach over) that begin before ``at`` and end at or after it."""
        return [(p, b + len(p) - at) for b in range(max(0, at - self.longest), at) for p in self.matches(text, b) if b + len(p) >= at]

    def forward(self, text: str, begin: int, end: int, into: list[tuple[str, int]]) -> dict[int, dict[str, int]]:
        """place -> piece that ends there -> bits of the states from which it is reached, for text[begin:end]."""
        at: dict[int, dict[str, int]] = {}
        for k, (piece, over) in enumerate(into):
            there = at.setdefault(begin + over, {})
            there[piece] = there.get(piece, 0) | 1 << k
        for i in range(begin, end):
            here = at.get(i)
            if not here:
                continue
            for p in self.matches(text, i):
                bits = 0
                for a, b in here.items():
                    if self.agree(a, p):
                        bits |= b
                if bits:
                    there = at.setdefault(i + len(p), {})
                    there[p] = there.get(p, 0) | bits
        return at

    def transfer(self, text: str, begin: int, end: int, first: bool, last: bool) -> tuple[list, dict]:
        """The states before a chunk, and for each state after it the bits of the former from which it is reached."""
        into = [START] if first else self.states(text, begin)
        at = self.forward(text, begin, end, into)
        if last:
            bits = 0
            for b in at.get(end, {}).values():
                bits |= b
            return into, {END: bits}
        return into, {s: at.get(end + s[1], {}).get(s[0], 0) for s in self.states(text, end)}

    def trace(self, text: str, begin: int, end: int, state: tuple[str, int], to: tuple[str, int], first: bool, last: bool) -> list[int]:
        """Ids of the pieces that begin in the chunk on the path between the two states."""
        at = self.forward(text, begin, end, [START if first else state])
        stop = begin + (0 if first else state[1])
        place = end if last else end + to[1]
        piece = next(iter(at[end])) if last and end > stop else to[0]
        out: list[int] = []
        while place > stop:
            out[:0] = self.ids_of(piece)
            place -= len(piece)
            if place <= stop:
                break
            piece = next(a for a in at[place] if self.agree(a, piece))
        return out

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte.get(b, self.unknown) for b in piece.encode("utf-8", "surrogatepass")]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def few(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that the Python objects of a slice stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def parts(text: str) -> list[str]:
    """Space-separated parts, each with the spaces before it but one, which is the one that the library puts in front."""
    if not text:
        return []
    got = text.replace(SPACE, " ").split(" ")
    if "" not in got:
        return got
    out, spaces = [], 0
    for i, w in enumerate(got):
        if w or i + 1 == len(got):
            out.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    return out


def compose(a: tuple[list, dict], b: tuple[list, dict]) -> tuple[list, dict]:
    """The max-plus product of two transfer matrices (bits of zero weights)."""
    (into, one), (between, two) = a, b
    out = {}
    for s, bits in two.items():
        got = 0
        for k, m in enumerate(between):
            if bits >> k & 1:
                got |= one.get(m, 0)
        out[s] = got
    return into, out


def split_text(text: str, chunk: int) -> list[tuple[int, int, bool]]:
    """(begin, end, whether the end is a cut inside a word) of the parts of a text that is cut each ``chunk`` characters.

    Around a cut, parts end before the nearest spaces; a cut that meets spaces moves before them.
    """
    ends: dict[int, bool] = {}
    last = 0
    for cut_at in range(chunk, len(text), chunk):
        if text[cut_at] == " " or text[cut_at - 1] == " ":
            while cut_at > last and text[cut_at - 1] == " ":
                cut_at -= 1
            if cut_at > last and text[cut_at] == " ":
                ends[cut_at] = False
                last = cut_at
            continue
        before = text.rfind(" ", last, cut_at)
        while before > last and text[before - 1] == " ":
            before -= 1
        if before > last:
            ends[before] = False
        ends[cut_at] = True
        last = cut_at
        after = text.find(" ", cut_at, cut_at + chunk)
        if after != -1:
            ends[after] = False
            last = after
    ends[len(text)] = False
    at = sorted(ends)
    return [(b, e, ends[e]) for b, e in zip([0, *at], at) if e > b]


_CHUNKS = "rid long, chunk int, run int, place int, text string, begin int, end int, first boolean, last boolean, cut boolean"


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """Chunks of long texts with the characters around them that their boundary states need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, rows, number, place, first = text.replace(SPACE, " "), [], 0, 0, True
                for k, (b, e, inside) in enumerate(split_text(text, size)):
                    before, after = max(0, b - AROUND), min(len(text), e + AROUND)
                    part = text[before:after]
                    # the library's leading space: at a text's begin it is added, at a cut before a space it is that space
                    rows.append((rid, k, number, place, part, b - before, e - before, first, not inside, inside or not first))
                    number, place, first = number + (not inside), place + 1 if inside else 0, not inside
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[x.split()[0] for x in _CHUNKS.split(", ")]).cast(pa.schema([("rid", pa.int64()), ("chunk", pa.int32()), ("run", pa.int32()), ("place", pa.int32()), ("text", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("cut", pa.bool_())]))

    return docs.mapInArrow(run, _CHUNKS)


def _lattice_text(r: dict) -> tuple[str, int, int]:
    """The characters that the merges see: a first chunk begins with the space that stands before it."""
    text, b, e = r["text"], r["begin"], r["end"]
    if r["first"]:
        own = text[b:e]
        lead = "" if own.startswith(" ") and r["chunk"] else " "
        text, b, e = lead + text[b:], 0, len(lead) + e - b
    if r["last"]:
        text = text[:e]
    return text.replace(" ", SPACE), b, e


_STATE = "struct<p:string,o:int>"
_MATRIX = f"rid long, run int, chunk int, into array<{_STATE}>, out array<struct<p:string,o:int,of:array<int>>>"
_KNOWN = "rid long, run int, chunk int, s_piece string, s_over int, t_piece string, t_over int"


def _packed(keys: list[tuple], matrices: list[tuple[list, dict]]) -> pa.RecordBatch:
    """Rows of ``_MATRIX``: the states before, and for each state after it the places of the former from which it is reached."""
    state = [("p", pa.string()), ("o", pa.int32())]
    into = [[{"p": p, "o": o} for p, o in m[0]] for m in matrices]
    out = [[{"p": p, "o": o, "of": [k for k in range(len(m[0])) if bits >> k & 1]} for (p, o), bits in m[1].items()] for m in matrices]
    ids = [pa.array(c, t) for c, t in zip(zip(*keys), (pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*ids, pa.array(into, pa.list_(pa.struct(state))), pa.array(out, pa.list_(pa.struct([*state, ("of", pa.list_(pa.int32()))])))], names=["rid", "run", "chunk", "into", "out"])


def _unpacked(row: dict) -> tuple[list, dict]:
    return [(x["p"], x["o"]) for x in row["into"]], {(x["p"], x["o"]): sum(1 << k for k in x["of"]) for x in row["out"]}


def _path(each: list[tuple[list, dict]], begin: tuple[str, int], to: tuple[str, int]) -> list[tuple[tuple, tuple]]:
    """The states before and after each of some matrices in a row, on the path from ``begin`` to ``to``."""
    prefix = [each[0]]
    for m in each[1:]:
        prefix.append(compose(prefix[-1], m))
    first, out = 1 << each[0][0].index(begin), []
    for k in range(len(each) - 1, -1, -1):
        into, matrix = each[k]
        state = next(s for i, s in enumerate(into) if matrix[to] >> i & 1 and prefix[k - 1][1].get(s, 0) & first) if k else begin
        out.append((state, to))
        to = state
    return out[::-1]


def known_states(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """The states before and after each part (rid, run, chunk) on its run's best path, by a tree of compositions."""

    def combined(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        whole = _unpacked(rows[0])
        for r in rows[1:]:
            whole = compose(whole, _unpacked(r))
        return pa.Table.from_batches([_packed([(rows[0]["rid"], rows[0]["run"], rows[0]["chunk"] // fan)], [whole])])

    def states(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        begin = (rows[0]["s_piece"], rows[0]["s_over"]) if "s_piece" in rows[0] else START
        to = (rows[0]["t_piece"], rows[0]["t_over"]) if "s_piece" in rows[0] else END
        found = _path([_unpacked(r) for r in rows], begin, to)
        out = [(r["rid"], r["run"], r["chunk"], s[0], s[1], t[0], t[1]) for r, (s, t) in zip(rows, found)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32()))], names=[x.split()[0] for x in _KNOWN.split(", ")])

    longest = matrices.groupBy("rid", "run").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= fan:
        return matrices.groupBy("rid", "run").applyInArrow(states, _KNOWN)
    # parts are numbered within their run, so that a group has ``fan`` of them at most
    upper = cut(matrices.groupBy("rid", "run", F.floor(F.col("chunk") / fan)).applyInArrow(combined, _MATRIX), "pieces-matrices")
    ends = known_states(upper, fan).withColumnRenamed("chunk", "g")
    within = matrices.withColumn("g", F.floor(F.col("chunk") / fan).cast("int")).join(ends, ["rid", "run", "g"])
    return within.groupBy("rid", "run", "g").applyInArrow(states, _KNOWN)


def _encode_long(docs: DataFrame, path: str, size: int, fan: int = FAN) -> DataFrame:
    """rid and ids of each long text (rid, text)."""
    chunks = cut(_chunks(docs, size), "pieces-chunks")
    spread = chunks.repartition("rid", "chunk")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.at(path)
        for batch in few(batches, 32):
            rows = batch.to_pylist()
            yield _packed([(r["rid"], r["run"], r["place"]) for r in rows], [model.transfer(*_lattice_text(r), r["first"], r["last"]) for r in rows])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.at(path)
        for batch in few(batches, 32):
            out = []
            for r in batch.to_pylist():
                if r["s_piece"] is None:  # no cut at either end: one state there, and the library goes between
                    own = r["text"][r["begin"] : r["end"]]
                    own = own[1:] if own.startswith(" ") and r["chunk"] else own
                    out.append(model.encode_texts([own])[0] or np.array([model.id[SPACE]], np.int32).tobytes())
                else:
                    got = model.trace(*_lattice_text(r), (r["s_piece"], r["s_over"]), (r["t_piece"], r["t_over"]), r["first"], r["last"])
                    out.append(np.array(got, np.int32).tobytes())
            yield pa.record_batch({"rid": batch.column("rid"), "chunk": batch.column("chunk"), "ids": pa.array(out, pa.binary())})

    made = cut(spread.filter("cut").mapInArrow(matrices, _MATRIX), "pieces-matrices")
    known = known_states(made, fan).withColumnRenamed("chunk", "place")
    traced = spread.join(known, ["rid", "run", "place"], "left").mapInArrow(ids, "rid long, chunk int, ids binary")
    # a text's chunks meet again in one row, as the text itself did
    return traced.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts")).select("rid", F.expr("aggregate(parts, x'', (a, p) -> concat(a, p.ids))").alias("ids"))


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", chunk: int = CHUNK, round_trip: str = "", fan: int = FAN) -> DataFrame:
    """The columns of ``docs`` and the ids of each whole text as an array of integers; columns so named before are replaced.

    ``round_trip`` names a column to tell whether decoding the ids gives the text, found where the text is encoded.
    """
    bounded_batches(docs.sparkSession)
    new = [ids, *([round_trip] if round_trip else [])]
    keep = [c for c in docs.columns if c not in new]
    whole = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields[:-1])
    is_long = F.length("__text") > chunk

    def made(m: Model, raw: list[bytes], texts: list[str]) -> list[pa.Array]:
        at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int32)
        out = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), np.int32)))]
        if round_trip:
            out.append(pa.array([m.decode(np.frombuffer(x, np.int32)) == t.replace(SPACE, " ") for x, t in zip(raw, texts)], pa.bool_()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.at(model)
        for part in few(batches, 128):
            texts = part.column(len(keep)).to_pylist()
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made(m, m.encode_texts(texts), texts)], names=[*keep, *new])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.at(model)
        for batch in few(batches, 16):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made(m, batch.column(len(keep) + 1).to_pylist(), batch.column(len(keep)).to_pylist())], names=[*keep, *new])

    out_schema = (f"{fields}, " if keep else "") + f"`{ids}` array<int>" + (f", `{round_trip}` boolean" if round_trip else "")
    short = whole.filter(~is_long).mapInArrow(run, out_schema)
    long = cut(whole.filter(is_long).withColumn("__rid", F.monotonically_increasing_id()), "pieces-long")
    done = _encode_long(long.select(F.col("__rid").alias("rid"), F.col("__text").alias("text")), model, chunk, fan)
    joined = long.join(done, long["__rid"] == done["rid"]).select(*(long[c] for c in keep), long["__text"], done["ids"].alias("__ids")).mapInArrow(unpacked, out_schema)
    return short.unionByName(joined)


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` and the text of the ids (null ids: empty)."""
    keep = [c for c in encoded.columns if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema.fields)
    place = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.at(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(place)
                values, offs = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                texts = [m.decode(values[a:b]) for a, b in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*keep, text])

    return encoded.select(*keep).mapInArrow(run, f"{fields}, `{text}` string")

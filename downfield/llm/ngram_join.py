"""Exact Jaccard self-join of documents' word shingles by token-combination prefixes, as components of the links.

Texts with equal shingle sets are one node.  Sets that link share a token in prefixes of n - ceil(t n) + 1 tokens of any one
order of all tokens (hashed shingles), so a node of which more than n - ceil(t n) tokens are its own links with nothing.

1. Of each node, the tokens of a fixed share ``FIRST`` of the hash space are counted, in ``PASSES`` passes; nodes with too many tokens of their own
   among them end here.  What the others lose by that only makes more tokens single: the rest is a question among the rest.
2. The nodes left are checked against the leader of their ``SKETCH`` least tokens that they share most of, so that groups of
   near copies are components before any keys are made.
3. All tokens of the nodes left are counted by components: tokens of one component end here; a token of more than ``FREQUENT``
   is frequent.  The order is single, rare, frequent, then by hash.  A prefix of rare tokens has these as single keys.  If it
   reaches into the frequent class, it is extended by g tokens, frequent tokens fall in g classes by hash, and since sets that
   link share g + 1 tokens of extended prefixes, they share a rare one or two frequent ones of one class: all rare tokens and
   two-token combinations within a class are the keys.  g follows the sets' size, so a set has about as many keys as tokens.
4. Keys of more than one component give candidates, again leaders first; only nodes of different components are candidates
   after that.  Bounds on size and on what can be shared from the key's place on go into the join, before the sets are checked.

Defined results: texts of null or without words have no shingles and are components of their own; a text of fewer than
five words is one shingle; repeated rows share a component; a component's id is the least doc_id of its rows (null only if
all are null), whatever ties; very long texts are read whole, in pieces of rows; an empty table gives no rows; only doc_id and
text are read, so other columns clash with nothing.  Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from downfield.llm import bytetext as B
from downfield.llm.components import components
from downfield.llm.shared import bounded_batches, cut, discard

WORDS, SIMILARITY = 5, (3, 4)
FIRST, FREQUENT, SKETCH = 0.35, 64, 8
#: Passes that count the tokens of that share, and later those of the nodes left, each its part of them, so that less lies on disk at once.
PASSES = 2
BITS = tuple(f"bits{i}" for i in range(8))
_LIMITS = [np.uint64(int(FIRST * k / PASSES * 2**64)) for k in range(PASSES + 1)]
_U = np.uint64
_I = np.int64


def need(n):
    """Tokens that a set of n shares with any set it links to: ceil(t n)."""
    return -(-n * SIMILARITY[0] // SIMILARITY[1])


class Sets:
    """The distinct shingle hashes of a piece's rows, by row, then hash; node is a row's 64-bit set hash (0: empty)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, words: int = WORDS):
        w = B.Words(raw, at, B.NOT_SPACE, True)
        rows = len(at) - 1
        s = B.shingles(w.hash, words)
        on = np.flatnonzero(w.row[: len(s)] == w.row[words - 1 :]) if len(s) else np.zeros(0, _I)
        h, row = [s[on]], [w.row[on]]
        counts = w.counts()
        for n in range(1, words):  # a short text's whole sequence
            r = np.flatnonzero(counts == n)
            if len(r):
                h.append(B.shingles(w.hash, n)[w.first[r]] ^ _U(n))
                row.append(r)
        h, row = np.concatenate(h), np.concatenate(row)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.hash, self.row = h[once], row[once]
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        self.size = np.diff(self.first)
        total = np.zeros(len(self.hash) + 1, _U)
        np.cumsum(B.mix(self.hash), out=total[1:])
        self.node = B.mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(_U)).view(_I)
        self.node[self.size == 0] = 0


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id, node and n of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in B.pieces(batch, "text"):
                s = Sets(raw, at)
                yield pa.record_batch([part.column("doc_id"), pa.array(s.node), pa.array(s.size.astype(_I))], names=["doc_id", "node", "n"])

    return docs.mapInArrow(run, "doc_id long, node long, n long")


def first_tokens(docs: DataFrame, turn: int) -> DataFrame:
    """token and node for a pass's part of the first share of the hash space, a node once for each task that meets it."""
    least, limit = _LIMITS[turn : turn + 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for _, raw, at in B.pieces(batch, "text"):
                s = Sets(raw, at)
                fresh = np.zeros(len(s.node), bool)
                for i in np.flatnonzero(s.size > 2).tolist():
                    k = s.node[i].item()
                    if k not in met:
                        met.add(k)
                        fresh[i] = True
                on = np.flatnonzero(fresh[s.row] & (s.hash >= least) & (s.hash < limit))
                yield pa.record_batch({"token": pa.array(s.hash[on].view(_I)), "node": pa.array(s.node[s.row[on]])})

    return docs.select("text").mapInArrow(run, "token long, node long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n and the hashes of the wanted (rep, node); the texts are dealt by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part, raw, at in B.pieces(batch, "text"):
                s = Sets(raw, at)
                node = part.column("node").to_numpy()
                on = [i for i in np.flatnonzero(s.node == node).tolist() if not (node[i].item() in met or met.add(node[i].item()))]
                yield pa.record_batch({"node": pa.array(node[on], pa.int64()), "n": pa.array(s.size[on].astype(np.int32)), "hashes": _lists([s.hash[s.first[i] : s.first[i + 1]] for i in on])})

    joined = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"])).select("text", "node")
    # a node whose rows lie apart is made once for each of them
    return joined.mapInArrow(run, "node long, n int, hashes array<long>").dropDuplicates(["node"])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*arrays, np.zeros(0, _U)]).view(_I)))


def classes(n: int) -> list[int]:
    """The g of a set of n tokens, and those of sets that it may link to: by the powers of two that their sizes lie at."""
    sizes = {n, max(1, n * SIMILARITY[0] // SIMILARITY[1]), -(-n * SIMILARITY[1] // SIMILARITY[0])}
    return sorted({max(1, (1 << (m.bit_length() - 1)) // 8) for m in sizes})


def combinations(frequent: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set of n tokens of which the (unsorted) ``frequent`` come last in the order, and their room.

    Of the first g + 1 tokens that linked sets share, two make a key, so at most g come before the later of the two.
    """
    tokens = np.unique(frequent)
    rare, out, room = n - len(tokens), [np.zeros(0, _U)], [np.zeros(0, _I)]
    if n - need(n) + 1 <= rare:
        return out[0], room[0]  # its own prefix is rare: what links to it shares a rare token
    for g in classes(n):
        prefix = tokens[: max(0, n - need(n) + 1 + g - rare)]
        order = np.argsort(prefix % _U(g), kind="stable")
        t, c = prefix[order], (prefix % _U(g))[order]
        for gap in range(1, len(t)):
            on = np.flatnonzero(c[gap:] == c[:-gap])
            if not len(on):
                break
            a, b = t[on], t[on + gap]
            out.append(B.mix(B.mix(np.minimum(a, b)) + np.maximum(a, b) * _U(3) + _U(g)))
            room.append(np.minimum(g + len(tokens) - order[on + gap], len(tokens)))
    return np.concatenate(out), np.concatenate(room)


def exact_keys(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """A cut of key, node, n, left (tokens that another component has too), room, bits of the nodes that may link beyond their component.

    ``room`` is how many tokens a node can share with another if the key is the first of the order that they share.  ``BITS`` columns
    are a bit map of the tokens that another component has too: a bit that the other node lacks is a token that it lacks.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[np.ndarray, int, int, int, np.ndarray]] = []
            maps: list[np.ndarray] = []
            for i, (node, n) in enumerate(zip(batch.column("node").to_pylist(), batch.column("n").to_pylist())):
                rare, often = (np.unique(np.asarray(batch.column(c)[i].values, _I).view(_U)) for c in ("rare", "often"))
                left = len(rare) + len(often)
                want = n - need(n) + 1 - (n - left)  # places of the prefix after the single tokens
                if want <= 0:
                    continue
                bits = np.zeros(64 * len(BITS), np.uint8)
                bits[(np.concatenate((rare, often)) % _U(len(bits))).astype(_I)] = 1
                maps.append(np.packbits(bits).view(_I))
                room = left - np.arange(len(rare), dtype=_I)
                if len(rare) >= want:
                    rows.append((rare[:want], node, n, left, room[:want]))
                else:
                    more, places = combinations(often, n)
                    rows.append((np.concatenate((rare, more)), node, n, left, np.concatenate((room, places))))
            if rows:
                times = [len(r[0]) for r in rows]
                yield pa.record_batch({"key": pa.array(np.concatenate([r[0] for r in rows]).view(_I)), **{c: pa.array(np.repeat(np.array([r[j] for r in rows], _I), times)) for j, c in ((1, "node"), (2, "n"), (3, "left"))}, "room": pa.array(np.concatenate([r[4] for r in rows])), **{b: pa.array(np.repeat(np.array([m[j] for m in maps], _I), times)) for j, b in enumerate(BITS)}})

    each = sets.select("node", "n", F.explode("hashes").alias("token"))
    entries = each.join(comps, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("c"))
    # counts of pre-aggregated distinct pairs, then a join of plain exchanges: a token of a third of the nodes is split
    parts = []
    for turn in range(PASSES):
        of, mine = (df.filter(F.pmod("token", F.lit(PASSES)) == turn) for df in (entries, each))
        often = cut(of.select("token", "c").distinct().groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token", (F.col("df") > FREQUENT).alias("frequent")), "tokens")
        parts.append(cut(mine.join(often, "token"), "shared-tokens"))
        discard(often)
    shared = reduce(DataFrame.unionByName, parts)
    lists = shared.groupBy("node", "n").agg(*(F.collect_list(F.when(x, F.col("token"))).alias(c) for c, x in (("rare", ~F.col("frequent")), ("often", F.col("frequent")))))  # at most a text's own tokens
    out = cut(lists.mapInArrow(keys, "key long, node long, n long, left long, room long, " + ", ".join(f"{b} long" for b in BITS)), "keys")
    discard(*parts)
    return out


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    mine = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                both = np.concatenate((x.values.to_numpy(), y.values.to_numpy()))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if SIMILARITY[1] * same >= SIMILARITY[0] * (len(both) - same):
                    out.append(i)
            yield batch.select(["a", "b"]).take(pa.array(out, pa.int64()))

    return pairs.join(mine, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _may_link(n: str, m: str) -> str:
    return f"{SIMILARITY[1]} * least({n}, {m}) >= {SIMILARITY[0]} * greatest({n}, {m})"


def leader_pairs(keys: DataFrame, comps: DataFrame | None, votes_least: int = 1) -> DataFrame:
    """For each node, the leader it shares most keys with and the most central of all leaders of its keys, if in other components.

    Where it is known how many tokens are a node's own, the node of the least share leads: in a group of copies with edits, that is
    the one closest to what was copied, which links with all that have few edits.
    """
    own = (F.col("n") - F.col("left")) / F.col("n") if "left" in keys.columns else F.lit(0.0)
    rows = keys.drop(*BITS).withColumn("order", F.struct(own.alias("own"), F.xxhash64("node").alias("hash")))
    rows = rows if comps is None else rows.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = rows.groupBy("key").agg(F.min(F.struct("order", "node", "n", *(["component"] if comps is not None else []))).alias("l"), F.count("*").alias("size")).filter("size > 1")
    met = rows.select("key", "node", "n", *(["component"] if comps is not None else [])).join(cut(lead.select("key", "l"), "leaders"), "key").filter(f"node != l.node and {_may_link('n', 'l.n')}" + (" and component != l.component" if comps is not None else ""))
    votes = met.groupBy("node", F.col("l.node").alias("leader")).agg(F.count("*").alias("c"), F.max(-F.col("l.order.own")).alias("central")).filter(F.col("c") >= votes_least)
    best = votes.groupBy("node").agg(F.max(F.struct("c", "leader"))["leader"].alias("most"), F.max(F.struct("central", "c", "leader"))["leader"].alias("central"))
    return best.select("node", F.explode(F.array("most", "central")).alias("leader")).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def cross_pairs(keys: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of nodes that share a key, are in different components, and may share enough.

    Only keys that join more than one component are left, and within one, nodes of equal components never pair.
    """
    rows = keys.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 != c2").select("key")
    rows = cut(rows.join(cut(mixed, "mixed-keys"), "key", "left_semi"), "mixed-rows")
    x, y = (rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "key")) for s in "xy")
    s, t = SIMILARITY
    enough = f"{s + t} * least(room_x, room_y) >= {s} * (n_x + n_y)"  # holds at the first key that a linked pair shares
    lacks = lambda a, b: " + ".join(f"bit_count({c}_{a} & ~{c}_{b})" for c in BITS)
    alike = " and ".join(f"{s + t} * (left_{a} - ({lacks(a, b)})) >= {s} * (n_x + n_y)" for a, b in ("xy", "yx"))
    both = x.join(y, "key").filter(f"node_x < node_y and component_x != component_y and {_may_link('n_x', 'n_y')} and {enough} and {alike}")
    return both.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of each row, and links (a, b) of nodes, enough of them to connect all that link."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = cut(nodes_of(docs), "nodes")
    counts = []
    for turn in range(PASSES):
        own = first_tokens(docs, turn).groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last")
        counts.append(cut(own.groupBy("node").agg(F.count("*").alias("own")), "own-tokens"))
    own = reduce(DataFrame.unionByName, counts).groupBy("node").agg(F.sum("own").alias("own"))
    # sets of one or two tokens link with equal ones only
    size = nodes.filter("n > 2").groupBy("node", "n").agg(F.min("doc_id").alias("rep"))
    alive = size.join(own, "node", "left").filter(f"coalesce(own, 0) <= n - ceil(n * {SIMILARITY[0]} / {SIMILARITY[1]})")
    sets = cut(sets_of(docs, cut(alive.select("rep", "node"), "alive")), "sets")
    least = sets.select("node", "n", F.explode(F.slice("hashes", 1, SKETCH)).alias("key"))
    # near copies share most of these; who shares few is left to the exact keys
    edges = cut(verify(leader_pairs(least, None, 3), sets), "links")
    comps = cut(components(edges), "components")
    keys = exact_keys(sets, comps)
    more = cut(verify(leader_pairs(keys, comps), sets), "links")
    edges = edges.unionByName(more)
    discard(comps, *counts)
    comps = cut(components(edges), "components")
    edges = edges.unionByName(cut(verify(cross_pairs(keys, comps), sets), "links"))
    discard(keys, sets, comps)
    return nodes, edges


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    nodes, edges = links(docs)
    comps = components(edges)
    least = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    group = least.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = group.groupBy("component").agg(F.min("least").alias("component_id"))
    of = group.join(ids, "component").select("node", "component_id")
    linked = nodes.filter("n > 0").join(of, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(nodes.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))

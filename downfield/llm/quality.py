"""Quality rules with verdicts by host.

Rules are counted per document, summed by host (one partial sum per task and host, whatever share of the rows a host holds),
each host's failure rates are shrunk by a beta prior fitted to all hosts, and the verdict is joined back.  A document is kept
if it passes the base rules and no shrunk rate of its host is beyond the rule's limit.

The prior is the beta-binomial one of the moments: its mean is the rate over all documents, and its weight comes from the
correlation within hosts that the hosts' rates show beyond chance, each host weighted by its documents.  A host of few documents
so gets about the mean and one of many its own rate, without any least size; if rates vary no more than by chance, or hosts say
nothing about that (a single one, or none of two documents), every host has the mean.

Defined results: a null text has no words (and fails); a null host is a host of its own; repeated rows count each time and each
get their verdict; very long texts are counted whole; a rate that ties with its limit is not beyond it; only the key, the host
and the text are read, so other columns clash with nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from downfield.llm import bytetext as B
from downfield.llm.shared import bounded_batches, cut

#: rule -> (condition of failure, a host's shrunk rate beyond which the host is rejected)
RULES = {
    "base": ("base_failed", 0.5),
    "symbols": ("n_words > 0 and n_symbols > n_words", 0.8),
    "lines": ("n_lines > 0 and 2 * n_dup_lines > n_lines", 0.8),
    "length": ("n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)", 0.8),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    _, where, times = np.unique(keys, return_inverse=True, return_counts=True)
    return times[where] > 1


def _row_sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def measure_piece(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    n_rows = len(at) - 1
    w = B.Words(raw, at, B.NOT_SPACE, False)
    inside = B.NOT_SPACE[raw]
    salt = B.mix(np.arange(1, n_rows + 1, dtype=np.uint64))
    hit = np.zeros(len(w.hash) + 1, np.int64)
    s = B.shingles(w.hash, 5)
    p = np.flatnonzero(w.row[: len(s)] == w.row[4:]) if len(s) else np.zeros(0, np.int64)
    p = p[_repeated(s[p] ^ salt[w.row[p]])] if len(p) else p
    hit[p] += 1
    np.subtract.at(hit, p + 5, 1)
    on = np.cumsum(hit)[:-1] > 0
    start, end, row = B.runs(raw != 10, at)
    worded = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(inside, out=worded[1:])
    full = worded[end] > worded[start]
    start, end, row = start[full], end[full], row[full]
    line = B.span_hash(w.h, start, end) ^ salt[row]
    first = np.unique(line, return_index=True)[1]
    again = np.ones(len(line), bool)
    again[first] = False
    lines_at = np.searchsorted(row, np.arange(n_rows + 1))
    return {
        "n_words": w.counts(), "word_chars": _row_sums(inside & ((raw & 0xC0) != 0x80), at), "n_symbols": _row_sums(_SYMBOL[raw], at),
        "n_lines": np.diff(lines_at), "n_dup_lines": _row_sums(again, lines_at), "n_repeat_words": _row_sums(on, w.first),
    }


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the counts of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in B.pieces(batch, "__text"):
                got = measure_piece(raw, at)
                yield pa.record_batch([*part.columns[:-1], *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=[*keep, *COUNTS])

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, " + ", ".join(f"{c} long" for c in COUNTS))


def host_verdicts(measured: DataFrame, host: str, rules: dict = RULES) -> DataFrame:
    """A row for each host: its shrunk failure rates and whether it is rejected."""
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *(F.sum(F.expr(f"{cond}").cast("long")).alias(f"f_{r}") for r, (cond, _) in rules.items()))
    n = F.col("n").cast("double")
    moments = hosts.agg(F.count("*").alias("h"), F.sum(n).alias("all"), F.sum(n * n).alias("squares"), *(f for r in rules for f in (F.sum(f"f_{r}").alias(f"sum_{r}"), F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"between_{r}"))))
    both = hosts.crossJoin(F.broadcast(moments))  # moments is one row
    rates, reject = {}, F.lit(False)
    for r, (_, limit) in rules.items():
        m = F.col(f"sum_{r}") / F.col("all")
        spread = F.col(f"between_{r}") - F.col(f"sum_{r}") * m
        room = F.col("all") - F.col("squares") / F.col("all") - (F.col("h") - 1)
        alike = F.when((room > 1e-9) & (m > 0) & (m < 1), F.try_divide(F.try_divide(spread, m * (1 - m)) - (F.col("h") - 1), room))
        weight = F.greatest(F.try_divide(1 - alike, alike), F.lit(0.0))
        rates[f"rate_{r}"] = F.when(alike > 0, (F.col(f"f_{r}") + m * weight) / (n + weight)).otherwise(m)
        reject = reject | (rates[f"rate_{r}"] > limit)
    return both.select("host", "n", *(c.alias(k) for k, c in rates.items()), reject.alias("rejected"))


def quality(docs: DataFrame, key: str = "doc_id", host: str = "source") -> DataFrame:
    """key, host, the counts, base_failed, host_rejected and kept for each row."""
    bounded_batches(docs.sparkSession)
    measured = measure(docs, [key, host]).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    measured = cut(measured, "quality")
    verdicts = host_verdicts(measured, host)
    out = measured.join(verdicts.select("host", "rejected"), measured[host].eqNullSafe(F.col("host")), "left")
    return out.select(measured["*"], F.coalesce("rejected", F.lit(False)).alias("host_rejected")).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))

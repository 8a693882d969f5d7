"""Places of pattern matches, with built-in functions only.

Spark finds matches but not where they are.  The pieces between them (``split``) and the matches alternate, so the running
sum of both lengths gives code-point offsets.  Text is split only where the pattern was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "array<struct<start:int,end:int,value:string,part:string,before:string,after:string>>"


def _quoted(pattern: str) -> Column:
    return F.lit(pattern)


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], parts: dict[str, int] | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """Add a column of ``SPAN`` for each pattern (null where it isn't found): the leftmost non-overlapping matches.

    part is the group named by ``parts``; before and after are so many code points on either side, no further than the
    neighbouring matches.
    """
    parts = parts or {}
    keep = df.columns
    df = df.select(*keep, *(F.regexp_extract_all(text, _quoted(p), F.lit(0)).alias(f"__m_{k}") for k, p in patterns.items()))
    df = df.select(
        *keep,
        *(f"__m_{k}" for k in patterns),
        *(F.when(F.size(f"__m_{k}") > 0, F.split(text, p, -1)).alias(f"__p_{k}") for k, p in patterns.items()),
        *(F.when(F.size(f"__m_{k}") > 0, F.regexp_extract_all(text, _quoted(patterns[k]), F.lit(g))).alias(f"__g_{k}") for k, g in parts.items()),
    )
    made = []
    for k in patterns:
        p, m, g = f"`__p_{k}`", f"`__m_{k}`", f"`__g_{k}`[i]" if k in parts else "cast(null as string)"
        row = f"""named_struct('start', a.at + length({p}[i]), 'end', a.at + length({p}[i]) + length({m}[i]), 'value', {m}[i], 'part', {g},
            'before', {f"right({p}[i], {before})" if before else "''"}, 'after', {f"left({p}[i + 1], {after})" if after else "''"})"""
        made.append(F.expr(f"""case when size({m}) > 0 then aggregate(sequence(0, size({m}) - 1), named_struct('at', 0, 'out', cast(array() as {SPAN})),
            (a, i) -> named_struct('at', a.at + length({p}[i]) + length({m}[i]), 'out', array_append(a.out, {row})), a -> a.out) end""").alias(k))
    return df.select(*keep, *made)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

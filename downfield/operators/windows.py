"""Ordered-partition operators. Windows of one spec share one exchange and sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

KEY, ORDER = ("player_id", "season"), ("week",)


def lead_targets(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY, order: Sequence = ORDER, prefix: str = "next_week_") -> DataFrame:
    """Each column's value in the key's next row; null in its last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in columns})


def drop_last(df: DataFrame, keys: Sequence[str] = KEY, order: Sequence = ORDER) -> DataFrame:
    """Without each key's last row, whatever nulls it has; a key of one row disappears."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__more", F.lead(F.lit(1)).over(w)).filter("__more is not null").drop("__more")


def training_rows(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY, order: Sequence = ORDER) -> DataFrame:
    """Lead targets without last rows, in one window."""
    return drop_last(lead_targets(df, columns, keys, order), keys, order)


def last_n(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_first(o) for o in order))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def first_n(df: DataFrame, n: int, keys: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


#: Ranges that a total order is cut into, and the accuracy of their ends.
RANGES, RANGE_ACCURACY = 200, 10_000


def numbered(df: DataFrame, order: Sequence, name: str = "number", by: str | None = None, descending: bool = False) -> DataFrame:
    """Row number from 1 in a total order, without one task that sees all rows.

    ``by`` is the order's first column where that is a number (``order`` itself if it is named there): its approximate quantiles cut
    the rows into ranges, each range is counted, and rows are numbered within theirs.  Equal values lie in one range.  An order that
    begins with no number is taken by one task.
    """
    kinds = dict(df.dtypes)
    by = by or (order[0] if isinstance(order[0], str) else None)
    if by is None or not any(kinds.get(by, "").startswith(k) for k in ("bigint", "int", "smallint", "double", "float", "decimal")):
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    cuts = df.agg(F.percentile_approx(by, [k / RANGES for k in range(1, RANGES)], RANGE_ACCURACY).alias("__cuts"))
    place = F.expr(f"size(filter(__cuts, c -> c {'>=' if descending else '<='} `{by}`))")
    # nulls are before all in ascending and after all in descending order
    bucket = F.when(F.col(by).isNull(), RANGES + 1 if descending else -1).otherwise(F.coalesce(place, F.lit(0)))
    cut = df.crossJoin(F.broadcast(cuts)).withColumn("__range", bucket).drop("__cuts")
    counts = cut.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    before = counts.select(F.col("__range"), F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return cut.withColumn("__k", within).join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + F.col("__k")).cast("long")).drop("__range", "__k", "__before")


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: str | None = None) -> DataFrame:
    """Exact quantiles q0, q1, ... with linear interpolation, of all rows or by a column; nulls drop out.

    Distinct values are counted first, so that frequent ones are one row; approximate quantiles cut them into ranges, and places are
    running sums within a range after the sums of the ranges before it, so that no task and no buffer holds all values of a group.
    """
    group = F.lit(0) if by is None else F.col(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(group.alias("__g"), F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    cuts = counts.agg(F.percentile_approx("__v", [k / RANGES for k in range(1, RANGES)], RANGE_ACCURACY).alias("__cuts"))
    ranged = counts.crossJoin(F.broadcast(cuts)).withColumn("__range", F.expr("coalesce(size(filter(__cuts, c -> c <= __v)), 0)")).drop("__cuts")
    sums = ranged.groupBy("__g", "__range").agg(F.sum("__c").alias("__s"))  # a row for each range of a group
    before = sums.select("__g", "__range", F.coalesce(F.sum("__s").over(Window.partitionBy("__g").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__s").over(Window.partitionBy("__g")).alias("__n"))
    upto = F.sum("__c").over(Window.partitionBy("__g", "__range").orderBy("__v"))
    placed = ranged.withColumn("__upto", upto).join(before, ["__g", "__range"]).withColumn("__upto", F.col("__upto") + F.col("__before"))
    out = []
    for i, p in enumerate(shares):
        at = F.lit(p) * (F.col("__n") - 1)
        holds = lambda k: F.max(F.when((k < F.col("__upto")) & (k >= F.col("__upto") - F.col("__c")), F.col("__v")))
        out += [holds(F.floor(at)).alias(f"__l{i}"), holds(F.ceil(at)).alias(f"__h{i}"), F.max(at - F.floor(at)).alias(f"__f{i}")]
    found = placed.groupBy("__g").agg(*out)
    values = [((1 - F.col(f"__f{i}")) * F.col(f"__l{i}") + F.col(f"__f{i}") * F.col(f"__h{i}")).alias(f"q{i}") for i in range(len(shares))]
    return found.select(*([] if by is None else [F.col("__g").alias(by)]), *values)


def ranked(df: DataFrame, by: str, *ties: str, name: str = "rank") -> DataFrame:
    """Place in a stable descending sort: equal values keep the order of the ties."""
    return numbered(df, [F.desc_nulls_last(by), *ties], name, by, descending=True)


def sleepers(predictions: DataFrame, adp: DataFrame, key: str, points: str, threshold: int = 20) -> DataFrame:
    """Players ranked at least ``threshold`` + 1 places before their draft position, ranks taken among all predictions."""
    out = ranked(predictions, points, key, name="predicted_rank").join(adp, key)
    return out.filter(F.col("adp_rank") - F.col("predicted_rank") > threshold).select(key, "predicted_rank", "adp_rank")


def over_replacement(df: DataFrame, position: str, points: str, *ties: str) -> DataFrame:
    """Points over the 13th of QB and TE, the 25th of others; null where there are fewer."""
    w = Window.partitionBy(position).orderBy(F.desc_nulls_last(points), *ties).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.when(F.col(position).isin("QB", "TE"), F.nth_value(points, 13).over(w)).otherwise(F.nth_value(points, 25).over(w))
    return df.withColumn("value_over_replacement", F.col(points) - level)


def latest_non_null(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """For each key the latest value of each column that is not null."""
    df = df.dropna(subset=list(keys))
    return df.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def positional_split(df: DataFrame, order: Sequence, share: float = 0.8) -> DataFrame:
    """``part`` is train for the first int(share * rows) in order, else test."""
    n = df.agg(F.floor(share * F.count("*")).alias("__train"))
    out = numbered(df, order, "__number").crossJoin(F.broadcast(n))
    return out.withColumn("part", F.when(F.col("__number") <= F.col("__train"), "train").otherwise("test")).drop("__number", "__train")


def hash_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """A split by a hash of the key: the same rows on any cluster, no shuffle, no sort."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) < int(1000 * share), "train").otherwise("test"))

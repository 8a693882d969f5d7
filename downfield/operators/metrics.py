"""Aggregates, evaluation metrics and the frames behind charts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window, functions as F

from downfield.operators.windows import quantiles


def usage(lineups: DataFrame, player: str = "nickname", lineup: str = "lineup_id") -> DataFrame:
    """Appearances of each player and their percentage of the lineups that exist."""
    total = lineups.agg(F.countDistinct(lineup).alias("__n"))
    counts = lineups.groupBy(player).agg(F.count("*").alias("count"))
    return counts.crossJoin(F.broadcast(total)).select(player, "count", F.bround(F.col("count") / F.col("__n") * 100, 2).alias("usage_percentage"))


def usage_by_position(lineups: DataFrame, position: str = "position", player: str = "nickname") -> DataFrame:
    return lineups.groupBy(position, player).agg(F.count("*").alias("count"))


def lineup_totals(lineups: DataFrame, lineup: str = "lineup_id") -> DataFrame:
    return lineups.groupBy(lineup).agg(F.sum("salary").alias("salary"), F.sum("lineup_points").alias("points"), F.format_string("%.2f", F.sum("lineup_points").cast("double")).alias("report"))


def mse(df: DataFrame, predicted: str, actual: str, *by: str, strict: bool = False) -> DataFrame:
    """Mean squared error by group; rows without an actual drop out, or make it null if ``strict``."""
    e = F.col(predicted) - F.col(actual)
    value = F.avg(e * e)
    return df.groupBy(*by).agg((F.when(F.count("*") == F.count(e), value) if strict else value).alias("mse"))


def mse_by_target(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """One row with the MSE of each target: name -> (column, prediction column named by the value)."""
    return df.agg(*(F.avg((F.col(p) - F.col(t)) ** 2).alias(t) for t, p in targets.items()))


def mae(df: DataFrame, predicted: str, actual: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae"))


def accuracy(df: DataFrame, predicted: str, actual: str, *by: str) -> DataFrame:
    """1 - mean absolute percentage error; actuals of 0 drop out."""
    return df.groupBy(*by).agg((1 - F.avg(F.abs(F.try_divide(F.col(actual) - F.col(predicted), F.col(actual))))).alias("accuracy"))


def consistency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Population standard deviation over mean."""
    return df.groupBy(*by).agg(F.try_divide(F.stddev_pop(value), F.avg(value)).alias("consistency"))


def mean_and_std(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations in long form, all pairs in one pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Extremes and exact quartiles of each group."""
    ends = df.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    q = quantiles(df, value, (0.25, 0.5, 0.75), by).withColumnRenamed(by, "__by")
    return ends.join(q, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "low", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"), "high")


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def kde(df: DataFrame, value: str, bandwidth: float, points: Sequence[float]) -> DataFrame:
    """Gaussian kernel density at given points, as one aggregate."""
    z = lambda p: F.exp(-((F.col(value) - p) / bandwidth) ** 2 / 2) / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    one = df.agg(*(F.avg(z(p)).alias(f"d{i}") for i, p in enumerate(points)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(p)).alias("x"), F.col(f"d{i}").alias("density")) for i, p in enumerate(points)))).alias("r")).select("r.*")


def weekly_mse(df: DataFrame, predicted: str, actual: str, week: str = "week") -> DataFrame:
    return mse(df, predicted, actual, week)


def compare(predictions: DataFrame, actuals: DataFrame, name: str, predicted: str, actual: str) -> DataFrame:
    """Predictions with actuals by name and their difference; those without an actual stay with nulls."""
    return predictions.join(actuals, name, "left").withColumn("difference", F.col(predicted) - F.col(actual))


def by_position(position: str, stats: dict[str, str], otherwise: str):
    """A position's own stat: position -> column."""
    out = None
    for p, c in stats.items():
        out = F.when(F.col(position) == p, F.col(c)) if out is None else out.when(F.col(position) == p, F.col(c))
    return out.otherwise(F.col(otherwise))


def trend(actuals: DataFrame, predictions: DataFrame, week: str = "week") -> DataFrame:
    """A player's actual values by week with predictions where there are any."""
    return actuals.join(predictions, week, "left")


def grouped_loss(df: DataFrame, targets: Sequence[str], predicted: Sequence[str], other_weight: float = 0.5) -> DataFrame:
    """Mean squared errors of targets 1-5, 6-10 and 11-15 and, at a lower weight, of the rest, added up."""
    pairs = [F.avg((F.col(p) - F.col(t)) ** 2) for t, p in zip(targets, predicted)]
    groups = [g for g in (pairs[:5], pairs[5:10], pairs[10:15]) if g]
    total = F.lit(0.0)
    for g in groups:
        total = total + sum(g[1:], g[0]) / len(g)
    if pairs[15:]:
        total = total + other_weight * (sum(pairs[16:], pairs[15]) / len(pairs[15:]))
    return df.agg(total.alias("loss"))


def consistency_loss(df: DataFrame, targets: Sequence[str], predicted: Sequence[str], at_most: Sequence[tuple[str, str]], weight: float = 0.1, l1: float = 0.01) -> DataFrame:
    """MSE plus a penalty where a predicted part is over its whole, plus an L1 term of the predictions."""
    n = len(targets)
    error = sum((F.avg((F.col(p) - F.col(t)) ** 2) for t, p in zip(targets, predicted)), F.lit(0.0)) / n
    over = sum((F.avg(F.greatest(F.col(a) - F.col(b), F.lit(0.0))) for a, b in at_most), F.lit(0.0)) / max(len(at_most), 1)
    size = sum((F.avg(F.abs(F.col(p))) for p in predicted), F.lit(0.0)) / n
    return df.agg((error + weight * over + l1 * size).alias("loss"))


def share_of_total(df: DataFrame, by: str) -> DataFrame:
    counts = df.groupBy(by).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))

"""Set-oriented prediction of a week for all players of all positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from downfield.functions.scalars import positional_points
from downfield.operators.metrics import compare, mse
from downfield.operators.models import Regressors, finished
from downfield.operators.relational import fallback_lookup

# The stats that each position is predicted by, in the order that its points take them.
POSITION_STATS = {"QB": ("passing_yards", "attempts", "completions"), "RB": ("rushing_yards", "carries", "receiving_yards"), "WR": ("receiving_yards", "targets", "receptions"), "TE": ("receiving_yards", "targets", "receptions")}
ACTIVE = ("ACT", "Active")


def candidates(roster: DataFrame, facts: DataFrame, season: int, week: int, fallback_season: int, name_match: str = "id", positions: Sequence[str] = tuple(POSITION_STATS), roster_order: str = "player_id") -> DataFrame:
    """Active roster players with the row their prediction starts from; a player repeated on the roster comes once.

    ``name_match='regex_first'`` finds a player's id as the first roster row, by ``roster_order``, whose name contains the player's.
    """
    active = roster.filter(F.col("status").isin(*ACTIVE) & F.col("position").isin(*positions))
    if name_match == "regex_first":
        active = active.drop("player_id").join(first_containing(active.select("player_name"), roster, "player_name", "player_name", "player_id", roster_order).withColumnRenamed("found", "player_id"), "player_name")
    wanted = active.select("player_id", "player_name", F.col("position"), F.col("team")).distinct()
    rows = facts.drop("player_name", "position", "team")
    return fallback_lookup(wanted, rows, "player_id", season, week, fallback_season)


def first_containing(names: DataFrame, among: DataFrame, name: str, found_name: str, found: str, order: str) -> DataFrame:
    """name and found: the first row by ``order`` whose name contains each name as a pattern, in any case.

    A name's first run of up to three letters is in whatever contains it, so rows meet by runs of letters before the patterns are
    tried; names without a letter have an empty run.
    """
    run = F.regexp_extract(F.lower("__name"), "[a-z]{3}|[a-z]{2}|[a-z]", 0)
    own = names.select(F.col(name).alias("__name")).distinct().withColumn("__run", run)
    every = among.select(F.lower(F.col(found_name)).alias("__low"), F.col(found_name).alias("__found_name"), F.col(found).alias("found"), F.col(order).alias("__o"))
    runs = F.expr("array_distinct(concat(array(''), flatten(transform(array(1, 2, 3), n -> transform(sequence(1, greatest(length(__low), 1)), i -> substring(__low, i, n))))))")
    hit = own.join(every.withColumn("__run", F.explode(runs)).drop("__low"), "__run").filter("__found_name rlike concat('(?i)', __name)")
    return hit.groupBy(F.col("__name").alias(name)).agg(F.min_by("found", F.struct("__o", "found")).alias("found"))


def predict_week(models: Regressors, rows: DataFrame, stats: Sequence[str], season: int, week: int) -> DataFrame:
    """Predictions stamped with week and season, floored and rounded."""
    out = finished(models.predict(rows, ["player_id", "player_name", "position"]), stats)
    return out.withColumns({"week": F.lit(week), "season": F.lit(season)})


def first_by_depth(rows: DataFrame, n: int, depth: str = "depth_team") -> DataFrame:
    w = Window.partitionBy("position").orderBy(depth, "player_id")
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def fantasy(predictions: DataFrame) -> DataFrame:
    """player_name, position, points of each position's predicted stats, best first."""
    slot = lambda k: F.coalesce(*(F.when(F.col("position") == p, F.col(f"predicted_{s[k]}")) for p, s in POSITION_STATS.items() if f"predicted_{s[k]}" in predictions.columns))
    points = positional_points("position", slot(0), slot(1), slot(2))
    return predictions.select("player_name", "position", points.alias("fantasy_points")).orderBy(F.desc_nulls_last("fantasy_points"), "player_name")


def comparison(predictions: DataFrame, actuals: DataFrame, name: str = "player_display_name") -> tuple[DataFrame, DataFrame]:
    """Detail of predicted and actual first stats of each position, and the MSE by position."""
    stat = lambda prefix: F.coalesce(*(F.when(F.col("position") == p, F.col(f"{prefix}{s[0]}")) for p, s in POSITION_STATS.items()))
    seen = actuals.select(name, *(F.col(s).alias(f"actual_{s}") for s in sorted({v[0] for v in POSITION_STATS.values()})))
    joined = predictions.join(seen, name, "left").withColumns({"predicted_stat": stat("predicted_"), "actual_stat": stat("actual_")})
    detail = joined.select(name, "position", "predicted_stat", "actual_stat", (F.col("predicted_stat") - F.col("actual_stat")).alias("difference"))
    return detail, mse(detail, "predicted_stat", "actual_stat", "position")


__all__ = ["ACTIVE", "POSITION_STATS", "candidates", "compare", "comparison", "fantasy", "first_by_depth", "first_containing", "predict_week"]

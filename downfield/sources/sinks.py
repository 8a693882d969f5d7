"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from downfield.operators.windows import numbered


def csv(df: DataFrame, path: str, index_by: Sequence[str] | None = None, one_file: bool = False) -> None:
    """CSV with a header; with an order given, a first column counts rows from 0. One file only for small results."""
    if index_by is not None:
        df = numbered(df, index_by, "index").select((F.col("index") - 1).alias("index"), *df.columns)
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def predictions(df: DataFrame, path: str, season: int, week: int) -> None:
    """Predictions by season, week and position; a week written again replaces itself alone."""
    out = df.withColumns({"season": F.lit(season), "week": F.lit(week)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "week", "position").parquet(path)


def dataset(df: DataFrame, path: str) -> None:
    df.repartition("season", "week").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "week").parquet(path)


def lineup_report(lineups: DataFrame) -> DataFrame:
    """A line for each player and one for each lineup's totals, in reading order."""
    player = F.format_string("%-8s %-24s %8.0f %8.2f %s", "position", "nickname", "salary", "lineup_points", F.coalesce("injury", F.lit("")))
    rows = lineups.select("lineup_id", F.col("slot"), player.alias("line"))
    totals = lineups.groupBy("lineup_id").agg(F.lit(1000).alias("slot"), F.format_string("Total salary %.0f, points %.2f", F.sum("salary"), F.sum("lineup_points")).alias("line"))
    return rows.unionByName(totals).orderBy("lineup_id", "slot")


def rows(df: DataFrame, most: int = 100_000) -> list[list]:
    """A small result as lists, at the edge only; one of more rows than ``most`` is an error, and nothing is cut off."""
    got = [list(r) for r in df.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} rows are no small result")
    return got

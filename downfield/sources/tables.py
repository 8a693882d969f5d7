"""Scans of the sport's tables, with explicit schemas, partition filters and pruned columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from downfield.functions.scalars import number, season_of_game

# Names of the sport's published columns.
STATS = (
    "completions attempts passing_yards passing_tds interceptions sacks sack_yards sack_fumbles sack_fumbles_lost passing_air_yards passing_yards_after_catch passing_first_downs passing_2pt_conversions "
    "carries rushing_yards rushing_tds rushing_fumbles rushing_fumbles_lost rushing_first_downs rushing_2pt_conversions receptions targets receiving_yards receiving_tds receiving_fumbles receiving_fumbles_lost "
    "receiving_air_yards receiving_yards_after_catch receiving_first_downs receiving_2pt_conversions target_share air_yards_share special_teams_tds fantasy_points fantasy_points_ppr"
).split()


def _schema(**kinds: str) -> T.StructType:
    types = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType()}
    return T.StructType([T.StructField(c, types[k]) for k, names in kinds.items() for c in names.split()])


SCHEMAS = {
    "weekly_stats": _schema(s="player_id player_name player_display_name position position_group recent_team season_type opponent_team", i="season week", d=" ".join(STATS)),
    "players": _schema(s="gsis_id display_name first_name last_name team_abbr current_team_id position_group position status birth_date college_name college_conference", d="height weight", i="years_of_experience entry_year rookie_year draft_number"),
    "rosters": _schema(s="player_id player_name first_name last_name team position depth_chart_position status birth_date", i="season week jersey_number years_exp", d="height weight"),
    "schedules": _schema(s="game_id home_team away_team home_qb_name away_qb_name", i="season week"),
    "depth_charts": _schema(s="gsis_id position depth_team formation club_code", i="season week"),
    "pbp": _schema(i="play_seq season week", s="game_id play_type posteam defteam offense_players defense_players"),
    "slate": _schema(s="slate nickname position injury", d="salary fppg predicted"),
    "seasonal_stats": _schema(s="player_id season_type", i="season games", d=" ".join(STATS)),
    "charting": _schema(s="game_id play_type", i="season week play_id"),
    "snap_counts": _schema(s="player_id game_id", i="week season offensive_snaps defensive_snaps special_teams_snaps total_snaps", d="offensive_snap_pct defensive_snap_pct special_teams_snap_pct"),
    "adp": _schema(s="player", i="adp_rank"),
}
PARTICIPATION = ("offense_players", "defense_players")


def seasons(first: int, last: int) -> list[int]:
    """From the first up to, and without, the last."""
    return list(range(first, last))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: number(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


class Tables:
    """Tables under one folder, parquet partitioned by season where they have one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, name: str, years: int | Iterable[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """A table of one year or several: the filter prunes partitions and the columns reach the scan."""
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        df = nan_to_null(reader.parquet(f"{self.root}/{name}"))
        if years is not None:
            wanted = [years] if isinstance(years, int) else list(years)
            df = df.filter(F.col("season").isin(wanted))
        return df.select(*columns) if columns else df

    def load_or_empty(self, name: str, *args, **kw) -> DataFrame:
        """An empty table of the schema where there is none to read yet; without a schema Spark's error stands."""
        try:
            return self.load(name, *args, **kw)
        except AnalysisException:
            if name not in SCHEMAS:
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def weekly(self, years) -> DataFrame:
        return self.load("weekly_stats", years)

    def rosters(self, years, columns: Sequence[str] | None = None) -> DataFrame:
        return self.load("rosters", years, columns)

    def plays(self, years, include_participation: bool = True) -> DataFrame:
        df = self.load("pbp", years)
        return df if include_participation else df.drop(*PARTICIPATION)

    def game_plays(self, game_id: str) -> DataFrame:
        """A game's plays; the season in its id prunes partitions."""
        return self.plays(int(game_id.split("_")[0])).filter((F.col("game_id") == game_id) & (season_of_game("game_id") == F.col("season")))

    def player_weeks(self, years, player_id: str | None = None, player_name: str | None = None) -> DataFrame:
        df = self.weekly(years)
        df = df.filter(F.col("player_id") == player_id) if player_id is not None else df
        return df.filter(F.col("player_name") == player_name) if player_name is not None else df


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file or glob with a header; a schema spares the pass that infers one."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def csv_by_position(spark: SparkSession, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """All files that match, with the position that each file's name begins with."""
    return csv(spark, pattern, schema).withColumn("position", F.regexp_extract(F.input_file_name(), r"([A-Z]+)_[^/]*$", 1))


def as_frame(spark: SparkSession, source) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return csv(spark, source) if source.endswith(".csv") else spark.read.parquet(source)
    raise ValueError(f"a path or a DataFrame, not {type(source).__name__}")


def literal(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    return spark.createDataFrame(list(zip(*columns.values())), list(columns))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once and read after that."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)

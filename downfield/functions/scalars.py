"""Scalar rules as column expressions, so that they are compiled and pushed down; there is no UDF here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Play categories.
SCRIMMAGE = ("run", "pass", "no_play")
SPECIAL_TEAMS = ("kickoff", "punt", "field_goal", "extra_point")
UNKNOWN_TEAM = "UNKNOWN_TEAM"
# names' suffixes that are dropped ("V" and a "Jr" without a dot stay).
NAME_SUFFIX = r"\s+(Jr\.|Sr\.|I{2,}|IV)$"
MIDDLE_INITIAL = r"\s+[A-Z]\.\s+"
# Points a unit in slate scoring, and yards from which on there is a bonus of 3.
SLATE_POINTS = {
    "passing_yards": 0.04, "passing_tds": 4.0, "interceptions": -1.0, "rushing_yards": 0.1, "rushing_tds": 6.0, "receptions": 0.5, "receiving_yards": 0.1, "receiving_tds": 6.0,
    "fumbles": -2.0, "return_tds": 6.0, "two_point_conversions": 2.0, "field_goals_0_39": 3.0, "field_goals_40_49": 4.0, "field_goals_50_plus": 5.0, "extra_points": 1.0,
}
SLATE_BONUS = {"passing_yards": 300, "rushing_yards": 100, "receiving_yards": 100}
# Points a unit in season-long scoring.
STANDARD_POINTS = {"passing_yards": 0.04, "passing_touchdowns": 4.0, "interceptions": -2.0, "rushing_yards": 0.1, "rushing_touchdowns": 6.0, "receiving_yards": 0.1, "receiving_touchdowns": 6.0, "fumbles_lost": -2.0}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """A number without NaN: pandas compares NaN as false, Spark as largest, so NaN becomes null where data comes in."""
    return F.when(F.isnan(col(c)), F.lit(None)).otherwise(col(c))


def finite(c: str | Column) -> Column:
    """Null for NaN and both infinities."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def players(c: str | Column, separator: str = ";", of: DataFrame | None = None) -> Column:
    """A list as an array; null is an empty array, empty elements stay (see ``without_empty``).

    A delimited string is split; with the frame that a named column is ``of``, an array is taken as it is.
    """
    listed = of is not None and isinstance(c, str) and dict(of.dtypes)[c].startswith("array")
    return F.coalesce(col(c).cast("array<string>") if listed else F.split(col(c), separator), F.array().cast("array<string>"))


def without_empty(c: str | Column) -> Column:
    return F.filter(col(c), lambda x: x != "")


def season_of_game(game_id: str | Column) -> Column:
    return F.split_part(col(game_id), F.lit("_"), F.lit(1)).cast("int")


def play_category(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.isin(*SCRIMMAGE), "scrimmage").when(c.isin(*SPECIAL_TEAMS), "special_teams").otherwise("other")


def resolved_team(own: str | Column, other: str | Column, category: str | Column) -> Column:
    """A team, else the other side's, else a stand-in on special-teams plays; null only on other plays without both."""
    return F.coalesce(col(own), col(other), F.when(col(category) == "special_teams", UNKNOWN_TEAM))


def strip(c: str | Column) -> Column:
    """White space of all kinds off both ends, where ``trim`` takes spaces only."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def normalize_name(c: str | Column) -> Column:
    c = F.regexp_replace(col(c), NAME_SUFFIX, "")
    c = F.regexp_replace(c, MIDDLE_INITIAL, " ")
    return strip(F.lower(F.replace(c, F.lit("."), F.lit(""))))


def slate_points(stats: Mapping[str, str | Column]) -> Column:
    """Slate scoring of the given stats; those left out count 0, and a null among those given makes the sum null."""
    total = F.lit(0.0)
    for name, points in SLATE_POINTS.items():
        if name in stats:
            total = total + col(stats[name]) * points
            if name in SLATE_BONUS:
                total = total + F.when(col(stats[name]) >= SLATE_BONUS[name], 3.0).otherwise(0.0)
    return total


def standard_points(stats: Mapping[str, str | Column], ppr: bool = False) -> Column:
    """Season-long scoring; stats left out or null count 0; a reception counts 1 in PPR."""
    points = STANDARD_POINTS | ({"receptions": 1.0} if ppr else {})
    total = F.lit(0.0)
    for name, p in points.items():
        if name in stats:
            total = total + F.coalesce(col(stats[name]), F.lit(0.0)) * p
    return total


def positional_points(position: str | Column, first: str | Column, second: str | Column, third: str | Column) -> Column:
    """Points of a position's three predicted stats in their order (the literal formula: slots are not what they are named)."""
    a, b, c = col(first), col(second), col(third)
    p = col(position)
    return F.when(p == "QB", a * 0.04 + c * 4 + b * 0.1).when(p == "RB", a * 0.1 + b * 0.5 + c * 0.1).otherwise(a * 0.1 + c * 0.5)


def ratio(n: str | Column, d: str | Column, otherwise: float = 0.0) -> Column:
    """n / d where d is over 0, else a constant (nulls too)."""
    return F.when(col(d) > 0, col(n) / col(d)).otherwise(F.lit(otherwise))


def value_per(points: str | Column, salary: str | Column, per: float = 1.0) -> Column:
    return F.try_divide(col(points), col(salary)) * per


def log1p_or_zero(c: str | Column) -> Column:
    """log(1 + x); 0 for x of -1 or less, null and NaN."""
    return F.coalesce(F.log1p(finite(c)), F.lit(0.0))


def clip(c: str | Column, low: float, high: float) -> Column:
    """Null stays null, which ``greatest`` alone would not leave."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def floor_at(c: str | Column, least: float = 0.01) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(least)))


def half_even(c: str | Column, places: int = 2) -> Column:
    return F.bround(col(c), places)


def total(columns: Sequence[str | Column]) -> Column:
    """A sum that is null if any part is."""
    out = col(columns[0])
    for c in columns[1:]:
        out = out + col(c)
    return out


def lookup(mapping: Mapping, key: str | Column, default=None) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(key)), F.lit(default)) if pairs else F.lit(default)


def is_scoring_week(season: str | Column, week: str | Column) -> Column:
    return col(week).between(1, F.when(col(season) >= 2021, 18).otherwise(17))


def two_places(c: str | Column) -> Column:
    return F.format_string("%.2f", col(c).cast("double"))

"""Projections, filters, joins, set operations and sorts as functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from downfield.functions.scalars import normalize_name

# projections


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that exist."""
    return df.select(*(c for c in columns if c in df.columns))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Exactly the columns of ``defaults``, in order; missing ones are constants."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in defaults.items()))


def target_names(columns: Sequence[str], prefix: str = "next_week_") -> list[str]:
    return [f"{prefix}{c}" for c in columns]


def overwrite_where(df: DataFrame, column: str, condition: Column, other: str) -> DataFrame:
    return df.withColumn(column, F.when(condition, F.col(other)).otherwise(F.col(column)))


def stamped(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "stat", value: str = "value") -> DataFrame:
    """A row for each key and column, by one pass over the rows."""
    return df.unpivot([F.col(k) for k in keys], [F.col(c) for c in columns], name, value)


# filters


def where_all(df: DataFrame, **equal) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in equal.items())))


def without_period(df: DataFrame, season: int, week: int) -> DataFrame:
    """Rows outside a season's week; rows of null season or week stay."""
    return df.filter(~F.coalesce((F.col("season") == season) & (F.col("week") == week), F.lit(False)))


def contains_name(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False)))


def not_listed(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose upper-cased value, null as empty, is none of the values."""
    return df.filter(~F.upper(F.coalesce(F.col(column), F.lit(""))).isin(*values))


def at_maximum(df: DataFrame, column: str, of: DataFrame | None = None) -> DataFrame:
    """Rows at a table's largest value, as one scalar that is broadcast."""
    top = (of if of is not None else df).agg(F.max(column).alias("__top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("__top")).drop("__top")


def prior_week(df: DataFrame, season: int, week: int) -> DataFrame:
    """The rows a week's prediction starts from: the week before, or in week 1 the last week of the season before."""
    if week == 1:
        return at_maximum(df.filter(F.col("season") == season - 1), "week")
    return df.filter((F.col("season") == season) & (F.col("week") == week - 1))


# joins


def left_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """A left equi-join; names that both sides have get the suffixes, and keys of equal names appear once.

    Sides are sorted and hashed as Spark finds best: a small right side is broadcast after its size is known.
    """
    right_on = list(right_on or left_on)
    same = [a for a, b in zip(left_on, right_on) if a == b]
    both = (set(left.columns) & set(right.columns)) - set(same)
    a = left.select(*(F.col(c).alias(c + suffixes[0] if c in both else c) for c in left.columns))
    b = right.select(*(F.col(c).alias(f"__{c}" if c in same else c + suffixes[1] if c in both else c) for c in right.columns))
    name = lambda c, s: f"__{c}" if s and c in same else c + suffixes[s] if c in both else c
    on = [a[name(x, 0)] == b[name(y, 1)] for x, y in zip(left_on, right_on)]
    return a.join(b, on, "left").drop(*(f"__{c}" for c in same))


def name_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """A left join on normalised names, many to many."""
    a, b = left.withColumn("__key", normalize_name(left_name)), right.withColumn("__key", normalize_name(right_name))
    return left_join(a, b, ["__key"]).drop("__key")


def among(df: DataFrame, column: str, *members: Column, of: DataFrame) -> DataFrame:
    """Rows whose value is in the union of the members' columns of another table."""
    values = reduce(DataFrame.union, (of.select(m.alias("__v")) for m in members))
    return df.join(values.distinct(), df[column] == F.col("__v"), "left_semi")


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence, right_order: Sequence, suffix: str = "_2") -> DataFrame:
    """Full join by row number in the given orders."""
    from downfield.operators.windows import numbered

    rank = lambda d, o: numbered(d, o, "__n")
    b = right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns})
    order = [o + suffix if isinstance(o, str) and o in left.columns and o in right.columns else o for o in right_order]
    return rank(left, left_order).join(rank(b, order), "__n", "full").drop("__n")


def fallback_lookup(wanted: DataFrame, facts: DataFrame, key: str, season: int, week: int, fallback_season: int) -> DataFrame:
    """For each wanted key its row of the week before, else its last one of the fallback season; keys without any disappear."""
    first = (F.col("season") == season) & (F.col("week") == week - 1)
    second = F.col("season") == fallback_season
    ranked = facts.filter(first | second).withColumn("__p", F.when(first, 0).otherwise(1))
    w = Window.partitionBy(key).orderBy("__p", F.desc("week"))
    best = ranked.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__p")
    return wanted.join(best, key)


def update_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of ``other`` where they are not null, by key."""
    columns = [c for c in other.columns if c not in keys]
    b = other.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = df.join(b, list(keys), "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))


# set operations and sorts


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def team_games(schedule: DataFrame, team) -> DataFrame:
    """Home games and away games of a team."""
    return schedule.filter(F.col("home_team") == team).unionAll(schedule.filter(F.col("away_team") == team))


def first_seen(df: DataFrame, column: str, position: str) -> DataFrame:
    """Distinct values with the position where each came first."""
    return df.groupBy(column).agg(F.min(position).alias("first_position"))


def top_k(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k largest, nulls last, ties in the order given."""
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(k)


def top_k_per(df: DataFrame, group: str, k: int, by: str, *ties: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(by), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

"""Registered queries: each applies an operator to whole tables, with the stand-ins that the tables allow for the sport's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from downfield.functions import scalars as S
from downfield.operators import features, lineups, metrics as M, models, participation, predictions, relational as R, windows as W
from downfield.sources.scratch import scratch
from downfield.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d):
    """A fact by player and week; value is null where it can be divided by 7."""
    week = F.date_trunc("week", "ts").cast("timestamp_ntz")
    return t(spark, d, "events").withColumns({"week": week, "stat": F.when(F.col("event_id") % 7 != 0, F.col("value"))})


def plays(spark, d):
    """Orders as plays: parts are the offence, suppliers the defence, empty and doubled elements and missing teams included."""
    of = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_partkey"))).alias("p"), F.array_sort(F.collect_list(F.col("l_suppkey"))).alias("s"))
    o = t(spark, d, "orders").join(of, F.col("o_orderkey") == F.col("l_orderkey"))
    kind = S.lookup({"1-URGENT": "run", "2-HIGH": "pass", "3-MEDIUM": "kickoff", "4-NOT SPECIFIED": "punt"}, "o_orderpriority", "timeout")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
    return o.select(
        F.col("o_orderkey").cast("int").alias("play_seq"), F.concat_ws("_", F.year("o_orderdate"), (F.col("o_custkey") % 20).cast("string")).alias("game_id"), F.year("o_orderdate").alias("season"),
        F.lit(1).alias("week"), kind.alias("play_type"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("T"), F.col("o_custkey") % 4)).alias("posteam"),
        F.when(F.col("o_orderkey") % 13 != 0, F.when(F.col("o_orderkey") % 22 != 0, F.concat(F.lit("T"), (F.col("o_custkey") + 1) % 4))).alias("defteam"),
        F.when(F.col("o_orderkey") % 17 != 0, F.concat(text("p"), F.lit(";"))).alias("offense_players"), text("s").alias("defense_players"),
    )


def slate(spark, d):
    """Parts as a slate of five positions."""
    position = S.lookup({0: "QB", 1: "RB/FLEX", 2: "WR/FLEX", 3: "TE/FLEX", 4: "DEF"}, F.col("p_partkey") % 5)
    injury = S.lookup({1: "O", 2: "q", 3: "ir"}, F.col("p_partkey") % 23)
    return t(spark, d, "part").select(F.lit("main").alias("slate"), F.col("p_name").alias("n"), F.concat(F.lit("P"), F.col("p_partkey")).alias("nickname"), position.alias("position"), (F.col("p_retailprice") * 4 + 2000).alias("salary"), F.col("p_size").cast("double").alias("fppg"), injury.alias("injury"), (F.col("p_size") + F.col("p_partkey") % 7).cast("double").alias("predicted")).drop("n")


E6 = lambda c: F.round(c, 6)


# windows


@query
def lead_targets(spark, d):
    return W.lead_targets(t(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["value"], ["user_id"], ["ts"]).select("event_id", "user_id", "value", "next_week_value")


@query
def training_rows(spark, d):
    rows = R.left_join(events(spark, d), t(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["user_id"], ["c_custkey"])
    return W.training_rows(rows, ["stat", "value"], ["user_id"], ["ts"]).select("event_id", "c_mktsegment", "next_week_stat", "next_week_value")


@query
def drop_last_week(spark, d):
    return W.drop_last(t(spark, d, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role")


@query
def last_row_per_key(spark, d):
    return W.last_n(t(spark, d, "events"), 1, ["user_id"], ["ts"]).select("user_id", "event_id", "value")


@query
def first_row_per_key(spark, d):
    return W.first_n(t(spark, d, "events"), 1, ["user_id"], ["ts"]).select("user_id", "event_id", "value")


@query
def tail_16(spark, d):
    return W.last_n(t(spark, d, "events"), 16, ["user_id"], ["ts"]).select("user_id", "event_id")


@query
def head_per_position(spark, d):
    return R.top_k_per(t(spark, d, "part"), "p_brand", 3, "p_retailprice", "p_partkey").select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query
def topk(spark, d):
    return R.top_k(t(spark, d, "orders"), 25, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query
def sleepers(spark, d):
    c = t(spark, d, "customer")
    adp = c.filter("c_custkey % 3 != 0").select("c_custkey", F.col("c_custkey").cast("int").alias("adp_rank"))
    return W.sleepers(c.select("c_custkey", "c_acctbal"), adp, "c_custkey", "c_acctbal", 20).withColumn("predicted_rank", F.col("predicted_rank").cast("long"))


@query
def value_over_replacement(spark, d):
    p = t(spark, d, "part").withColumn("position", F.when(F.col("p_size") % 2 == 0, "QB").otherwise(F.col("p_brand")))
    return W.over_replacement(p, "position", "p_retailprice", "p_partkey").select("p_partkey", "position", E6("value_over_replacement").alias("vorp"))


@query
def latest_depth_chart(spark, d):
    e = events(spark, d).withColumn("order", F.col("event_id"))
    return W.latest_non_null(e, ["user_id", "event_type"], "order", ["stat", "props"])


@query
def split_80_20(spark, d):
    return W.positional_split(t(spark, d, "customer"), ["c_custkey"]).select("c_custkey", "part")


# participation


@query
def team_snap_counts(spark, d):
    return participation.team_counts(plays(spark, d))


@query
def player_snap_counts(spark, d):
    return participation.player_counts(plays(spark, d)).drop("week")


@query
def snap_pct(spark, d):
    out = participation.snap_counts(plays(spark, d))
    return out.select("player_id", "game_id", "total_snaps", *(E6(c).alias(c) for c in out.columns if c.endswith("_pct")))


@query
def snap_pct_by_side(spark, d):
    out = participation.snap_counts(plays(spark, d), "side")
    return out.select("player_id", "game_id", *(E6(c).alias(c) for c in out.columns if c.endswith("_pct")))


@query
def simple_snap_count(spark, d):
    return participation.simple_counts(plays(spark, d)).drop("week")


# joins


@query
def left_join_dim(spark, d):
    a = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"))
    b = t(spark, d, "nation").filter("n_nationkey % 2 = 0").select("n_nationkey", F.col("n_name").alias("name"))
    return R.left_join(a, b, ["key"], ["n_nationkey"])


@query
def left_join_3key(spark, d):
    e = events(spark, d).select("event_id", "user_id", F.year("ts").alias("season"), F.month("ts").alias("month"))
    counts = e.filter("event_id % 3 = 0").groupBy("user_id", "season", "month").agg(F.count("*").alias("n"))
    return R.left_join(e, counts, ["user_id", "season", "month"])


@query
def left_join_suffix(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"))
    x = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("status"), "l_linenumber").distinct()
    return R.left_join(o, x, ["o_orderkey"], ["l_orderkey"], ("", "_depth_chart"))


@query
def normalized_name_join(spark, d):
    ending = S.lookup({0: " Jr.", 1: " III", 2: " IV", 3: " V", 4: " Jr"}, F.col("c_custkey") % 6, "")
    a = t(spark, d, "customer").select("c_custkey", F.concat(F.lit(" Odell A. "), F.col("c_name"), ending).alias("nickname"))
    b = t(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("O.dell "), F.col("c_name")).alias("player_name"), "c_acctbal")
    return R.name_join(a, b, "nickname", "player_name").select("c_custkey", "nickname", "player_name", "c_acctbal")


@query
def semi_join_starters(spark, d):
    return R.among(t(spark, d, "customer"), "c_custkey", F.col("o_custkey"), F.col("o_orderkey") % 97, of=t(spark, d, "orders").filter("o_orderstatus = 'F'")).select("c_custkey")


@query
def positional_join(spark, d):
    return R.positional_join(t(spark, d, "nation"), t(spark, d, "region"), ["n_nationkey"], ["r_regionkey"]).select("n_nationkey", "n_name", "r_regionkey", "r_name")


@query
def fallback_lookup(spark, d):
    e = t(spark, d, "conversations").select(F.col("conv_id").alias("player_id"), (F.col("conv_id") % 2 + 2023).alias("season"), F.col("turn").alias("week"), "role")
    wanted = t(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("player_id"))
    return R.fallback_lookup(wanted, e, "player_id", 2024, 3, 2023).select("player_id", "season", "week", "role")


@query
def update_coalesce(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = t(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("c_acctbal"))
    return R.update_from(c, new, ["c_custkey"])


@query
def name_containment_first(spark, d):
    own = t(spark, d, "nation")
    return own.join(predictions.first_containing(own, own, "n_name", "n_name", "n_nationkey", "n_nationkey"), "n_name").select("n_nationkey", "found")


# set operations


@query
def upsert_week(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts", "week", "value")
    last = e.filter(F.month("ts") == 1)
    new = last.filter("event_id % 2 = 0").withColumn("value", F.col("value") + 1000)
    return incremental.upsert(e, new, ["value"], ["user_id"], ["ts", "event_id"], ["week"]).select("event_id", "value", "next_week_value")


@query
def team_schedule(spark, d):
    games = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 32).alias("home_team"), (F.col("o_orderkey") % 32).alias("away_team"))
    return R.team_games(games, 7)


@query
def union_all(spark, d):
    o = t(spark, d, "orders")
    return R.union_all(o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), o.filter("o_orderstatus = 'O'").select("o_orderkey"))


@query
def distinct_rows(spark, d):
    return t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query
def distinct_first_seen(spark, d):
    return R.first_seen(t(spark, d, "orders"), "o_custkey", "o_orderkey")


# filters


@query
def filter_conj(spark, d):
    return R.where_all(t(spark, d, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey")


@query
def filter_isin(spark, d):
    return t(spark, d, "part").filter(F.col("p_size").isin(1, 2, 3)).select("p_partkey")


@query
def filter_not_isin(spark, d):
    o = t(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 5 != 0, F.lower("o_orderstatus")))
    return R.not_listed(o, "s", ["O", "P"]).select("o_orderkey", "s")


@query
def filter_regex(spark, d):
    return R.contains_name(t(spark, d, "part").withColumn("n", F.when(F.col("p_partkey") % 9 != 0, F.col("p_name"))), "n", "B.*RING").select("p_partkey")


@query
def filter_scalar_max(spark, d):
    return R.at_maximum(t(spark, d, "conversations"), "turn").select("conv_id", "turn")


@query
def filter_prior_week(spark, d):
    c = t(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 2 + 2023).alias("season"), F.col("turn").alias("week"))
    return R.prior_week(c, 2024, 1).unionByName(R.prior_week(c, 2024, 4))


@query
def filter_range(spark, d):
    return t(spark, d, "orders").filter((F.year("o_orderdate") == 1995) & (F.month("o_orderdate") < 6)).select("o_orderkey")


@query
def without_period(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate")).alias("season"), F.month("o_orderdate").alias("week"))
    return R.without_period(o, 1995, 6)


@query
def any_null_exclusion(spark, d):
    e = W.lead_targets(events(spark, d), ["stat", "value"], ["user_id"], ["ts"])
    return e.na.drop(how="any", subset=["next_week_stat", "next_week_value"]).select("event_id")


@query
def array_contains_players(spark, d):
    return plays(spark, d).filter(F.array_contains(S.players("defense_players"), "7")).select("play_seq")


# scalars


def _stats():
    return {"passing_yards": F.col("l_extendedprice") / 200, "passing_tds": F.col("l_linenumber"), "interceptions": F.col("l_quantity") % 3, "rushing_yards": F.col("l_quantity") * 3, "rushing_tds": F.col("l_linenumber") % 2, "receptions": F.col("l_quantity") % 5, "receiving_yards": F.when(F.col("l_orderkey") % 6 != 0, F.col("l_extendedprice") / 500), "receiving_tds": F.lit(1), "fumbles": F.col("l_linenumber") % 3}


def _sums(df, points):
    return df.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(points), 7).alias("points"))


@query
def fanduel_points(spark, d):
    return _sums(t(spark, d, "lineitem"), S.slate_points(_stats()))


@query
def standard_points(spark, d):
    s = _stats()
    return _sums(t(spark, d, "lineitem"), S.standard_points({"passing_yards": s["passing_yards"], "interceptions": s["interceptions"], "rushing_yards": s["rushing_yards"], "receiving_yards": s["receiving_yards"], "receptions": s["receptions"], "fumbles_lost": s["fumbles"]}, ppr=True))


@query
def positional_points(spark, d):
    p = t(spark, d, "part").withColumn("position", S.lookup({0: "QB", 1: "RB", 2: "WR"}, F.col("p_partkey") % 4, "TE"))
    return p.select("p_partkey", "position", F.round(S.positional_points("position", "p_size", "p_retailprice", F.col("p_partkey") % 10), 4).alias("points"))


@query
def value_per_dollar(spark, d):
    return t(spark, d, "part").select("p_partkey", E6(S.value_per("p_size", F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).otherwise(0.0), 1000)).alias("value"))


@query
def log1p_features(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", E6(S.log1p_or_zero("s_acctbal")).alias("log_acctbal"))


@query
def ratio_features(spark, d):
    return t(spark, d, "part").select("p_partkey", E6(S.ratio("p_retailprice", F.col("p_size") % 5)).alias("ratio"))


@query
def clip_fill(spark, d):
    c = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 50)
    return t(spark, d, "customer").select("c_custkey", S.clip(c, 0.0, 100.0).alias("clipped"), F.coalesce(S.clip(c, 0.0, 100.0), F.lit(0.0)).alias("filled"), S.floor_at(c).alias("floored"), F.coalesce(S.total([c, "c_custkey"]), F.lit(0.0)).alias("total"))


@query
def normalize_names(spark, d):
    ending = S.lookup({0: " Jr.", 1: " III", 2: " IV", 3: " V", 4: " Jr", 5: "\tSr.", 6: " \n"}, F.col("c_custkey") % 8, "")
    return t(spark, d, "customer").select("c_custkey", S.normalize_name(F.concat(F.lit("A.J. B. "), F.col("c_name"), ending)).alias("name"))


@query
def play_categories(spark, d):
    return plays(spark, d).groupBy(S.play_category("play_type").alias("category"), S.season_of_game("game_id").alias("season")).agg(F.count("*").alias("n"))


@query
def conditional_assign(spark, d):
    s = slate(spark, d).withColumn("points", F.col("predicted"))
    return R.overwrite_where(s, "points", F.col("position") == "DEF", "fppg").select("nickname", "points")


@query
def scoring_weeks(spark, d):
    c = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 8 + 2018).alias("season"), (F.col("o_orderkey") % 20).alias("week"))
    return c.filter(S.is_scoring_week("season", "week"))


@query
def long_stats(spark, d):
    return R.long_form(t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"], ["size", "price"])


# metrics


def _predicted(spark, d):
    e = events(spark, d)
    mean = e.groupBy("user_id").agg(F.avg("value").alias("predicted"))
    return e.join(mean, "user_id")


@query
def mse_by_group(spark, d):
    return M.mse(_predicted(spark, d), "predicted", "stat", "event_type").select("event_type", F.round("mse", 4).alias("mse"))


@query
def mape_accuracy(spark, d):
    return M.accuracy(_predicted(spark, d).withColumn("a", F.round("value")), "predicted", "a", "event_type").select("event_type", F.round("accuracy", 4).alias("accuracy"))


@query
def consistency_cv(spark, d):
    return M.consistency(events(spark, d), "stat", "user_id").select("user_id", E6("consistency").alias("cv"))


@query
def mean_std(spark, d):
    return M.mean_and_std(events(spark, d), "stat", "event_type").select("event_type", E6("mean").alias("mean"), E6("std").alias("std"))


@query
def correlation_long(spark, d):
    return M.correlations(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("a", "b", E6("corr").alias("corr"))


@query
def usage_pct(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("nickname"), F.col("l_orderkey").alias("lineup_id"))
    return M.usage(rows).select("nickname", "count", F.col("usage_percentage").alias("pct"))


@query
def usage_by_position(spark, d):
    return M.usage_by_position(t(spark, d, "lineitem"), "l_returnflag", "l_suppkey")


@query
def lineup_sums(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("lineup_id"), F.col("l_quantity").alias("salary"), F.col("l_linenumber").cast("double").alias("lineup_points"))
    return M.lineup_totals(rows)


@query
def box_stats(spark, d):
    out = M.box_stats(events(spark, d), "value", "event_type")
    return out.select("event_type", *(E6(c).alias(c) for c in out.columns[1:]))


@query
def histogram(spark, d):
    return M.histogram(events(spark, d), "stat", 10.0)


@query
def weekly_mse(spark, d):
    return M.weekly_mse(_predicted(spark, d), "predicted", "stat").select("week", F.round("mse", 4).alias("mse"))


@query
def compare_predictions(spark, d):
    p = events(spark, d).groupBy("user_id").agg(F.max("value").alias("predicted_stat"))
    a = events(spark, d).filter("user_id % 3 != 0").groupBy("user_id").agg(F.min("value").alias("actual_stat"))
    return M.compare(p, a, "user_id", "predicted_stat", "actual_stat").withColumn("difference", E6("difference"))


# features


@query
def standard_scale(spark, d):
    return features.scaled(t(spark, d, "events").select("event_id", "value"), ["value"], F.avg, F.stddev_pop).select("event_id", E6("value").alias("value"))


@query
def zscore(spark, d):
    return features.scaled(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], F.avg, F.stddev_samp).select("c_custkey", E6("c_acctbal").alias("z"))


@query
def robust_scale(spark, d):
    return features.robust_scaled(t(spark, d, "events").select("event_id", "value"), ["value"]).select("event_id", E6("value").alias("value"))


@query
def label_encode(spark, d):
    return features.label_encode(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", F.col("code").cast("long").alias("code"))


@query
def one_hot(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return features.one_hot(c, "c_mktsegment", ["AUTOMOBILE", "BUILDING", "NOWHERE"], "s").drop("c_mktsegment")


# flows that SQL cannot express


@query
def train_predict(spark, d):
    e = events(spark, d).withColumn("hour", F.hour("ts").cast("double"))
    m = models.train(e, ["value"], ["value", "hour"], ["event_type"], ["user_id"], ["ts"])
    last = W.last_n(e, 1, ["user_id"], ["ts"])
    return models.finished(m.predict(last, ["user_id"]), ["value"])


@query
def lineup_search(spark, d):
    return lineups.optimize(slate(spark, d), 9)


@query
def stream_upsert(spark, d):
    """Two deliveries of weeks through a stream, the second of which replaces the first's."""
    root = scratch(spark, "stream")
    e = events(spark, d).select("event_id", "user_id", "ts", F.col("week").cast("string").alias("week"), "value")
    for k, batch in enumerate((e, e.filter(F.col("week") < "2024-02").withColumn("value", F.col("value") + 1))):
        batch.write.parquet(f"{root}/landing/{k}")
        stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(f"{root}/landing")
        incremental.stream_upserts(stream, f"{root}/table", f"{root}/checkpoint", ["week"]).awaitTermination()
    return incremental.with_targets(spark, f"{root}/table", ["value"], ["user_id"], ["ts", "event_id"]).select("event_id", "value", "next_week_value")

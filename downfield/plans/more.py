"""Registered queries of sources, sinks, predictions, models and the rest of the metrics, each checked by SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from downfield.functions import scalars as S
from downfield.operators import features, lineups, metrics as M, models, predictions, relational as R, windows as W
from downfield.plans.queries import E6, events, plays, query, slate, t
from downfield.sources import sinks, tables
from downfield.sources.scratch import scratch
from downfield.streaming import incremental


def _season_tables(spark, d):
    """Orders, plays and weekly stats as tables by season, written by the sink and read through the scans."""
    root = scratch(spark, "tables")
    p = plays(spark, d)
    p.write.partitionBy("season").parquet(f"{root}/pbp")
    return tables.Tables(spark, root)


# sources


@query
def scan_by_years(spark, d):
    """Seasons of a partitioned table, columns pruned."""
    root = scratch(spark, "tables")
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"))
    sinks.dataset(o, f"{root}/results")
    return tables.Tables(spark, root).load("results", tables.seasons(1993, 1996), ["o_orderkey", "season", "week"])


@query
def scan_player_weeks(spark, d):
    """Weekly stats with the sport's own columns, for one player of two seasons."""
    root = scratch(spark, "tables")
    c = t(spark, d, "conversations")
    own = c.select((F.col("conv_id") % 7).cast("string").alias("player_id"), F.concat(F.lit("n"), F.col("conv_id") % 7).alias("player_name"), (F.col("conv_id") % 3 + 2021).cast("int").alias("season"), F.col("turn").cast("int").alias("week"), F.length("text").cast("double").alias("passing_yards"))
    whole = R.with_defaults(own, {f.name: None if f.dataType.simpleString() != "double" else 0.0 for f in tables.SCHEMAS["weekly_stats"].fields})
    whole.select(*(F.col(f.name).cast(f.dataType) for f in tables.SCHEMAS["weekly_stats"].fields)).write.parquet(f"{root}/weekly_stats")
    return tables.Tables(spark, root).player_weeks([2021, 2022], player_id="3", player_name="n3").select("player_id", "season", "week", "passing_yards", "rushing_yards")


@query
def scan_game_plays(spark, d):
    """One game's plays, and a season's without participation."""
    source = _season_tables(spark, d)
    game = source.game_plays("1994_3").select("play_seq", "season", F.length("defense_players").cast("long").alias("listed"))
    bare = source.plays(1995, include_participation=False)
    return game.unionByName(bare.select("play_seq", "season", F.lit(len(bare.columns)).cast("long").alias("listed")))


@query
def scan_or_empty(spark, d):
    """A table that is not there is empty, with its columns; one that is made once is read after that."""
    root = scratch(spark, "tables")
    empty = tables.Tables(spark, root).load_or_empty("snap_counts", 2020)
    made = [tables.cached(spark, f"{root}/kept", lambda: t(spark, d, "region").select("r_regionkey", "r_name")) for _ in range(2)][1]
    return tables.as_frame(spark, made).select("r_regionkey", "r_name", F.lit(len(empty.columns)).cast("long").alias("columns")).unionByName(empty.select(F.col("week").alias("r_regionkey"), F.col("player_id").alias("r_name"), F.lit(0).cast("long").alias("columns")))


@query
def literal_frame(spark, d):
    return tables.literal(spark, {"name": ["a", "b", "c"], "rank": [1, 2, 3]}).withColumn("rank", F.col("rank").cast("long"))


# sinks


@query
def csv_round_trip(spark, d):
    """A numbered CSV, written and read back by its header."""
    path = scratch(spark, "csv")
    sinks.csv(t(spark, d, "nation").select("n_nationkey", "n_name"), path, ["n_nationkey"], one_file=True)
    return tables.csv(spark, path).select(F.col("index").cast("long").alias("index"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query
def predictions_by_week(spark, d):
    """Two deliveries of a week and one of another: a week written again replaces itself alone."""
    path = scratch(spark, "predictions")
    p = t(spark, d, "part").select("p_partkey", S.lookup({0: "QB", 1: "RB"}, F.col("p_partkey") % 3, "TE").alias("position"), "p_retailprice")
    sinks.predictions(p, path, 2024, 3)
    sinks.predictions(p, path, 2024, 4)
    sinks.predictions(p.filter("position <> 'TE'").withColumn("p_retailprice", F.col("p_retailprice") + 1), path, 2024, 3)
    return spark.read.parquet(path).groupBy("season", "week", "position").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query
def lineup_report(spark, d):
    rows = slate(spark, d).filter("nickname in ('P5', 'P6', 'P7', 'P8', 'P9', 'P10')").select(F.lit(1).alias("lineup_id"), F.substring("nickname", 2, 9).cast("int").alias("slot"), "position", "nickname", F.col("salary").cast("double").alias("salary"), F.col("predicted").alias("lineup_points"), "injury")
    return sinks.lineup_report(rows).select(F.col("slot").cast("long").alias("slot"), F.trim("line").alias("line"))


@query
def rows_at_the_edge(spark, d):
    rows = sinks.rows(t(spark, d, "region").select("r_regionkey", "r_name"))
    return spark.createDataFrame(rows, "r_regionkey int, r_name string")


# projections


@query
def projection_defaults(spark, d):
    """Columns that exist, defaults for those that don't, constants and prefixed names."""
    s = R.present(t(spark, d, "supplier"), ["s_suppkey", "s_name", "nothing"])
    out = R.with_defaults(R.stamped(s, season=2024), {"s_suppkey": 0, "s_name": "", "season": 0, "missing": 7})
    return out.withColumnsRenamed(dict(zip(["s_name"], R.target_names(["s_name"]))))


@query
def dynamic_sort_column(spark, d):
    """The ten best by the first metric column, whatever its name."""
    s = t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return R.top_k(s, 10, s.columns[1], "s_suppkey")


# metrics


def _predicted(spark, d):
    e = events(spark, d)
    return e.join(e.groupBy("user_id").agg(F.avg("value").alias("predicted")), "user_id").withColumn("other", F.col("predicted") * 1.1)


@query
def mae_by_group(spark, d):
    return M.mae(_predicted(spark, d), "predicted", "stat", "event_type").select("event_type", F.round("mae", 4).alias("mae"))


@query
def mse_of_targets(spark, d):
    return M.mse_by_target(_predicted(spark, d), {"value": "predicted", "stat": "other"}).select(F.round("value", 3).alias("value"), F.round("stat", 3).alias("stat"))


@query
def strict_mse(spark, d):
    return M.mse(_predicted(spark, d), "predicted", "stat", "event_type", strict=True).select("event_type", F.round("mse", 4).alias("mse"))


@query
def density(spark, d):
    return M.kde(events(spark, d), "value", 25.0, [0.0, 50.0, 100.0, 200.0]).select("x", F.round("density", 9).alias("density"))


@query
def losses(spark, d):
    """Both losses of four targets."""
    p = _predicted(spark, d).withColumns({"t2": F.col("value") * 2, "p2": F.col("predicted") * 2})
    one = M.grouped_loss(p, ["value", "t2"], ["predicted", "p2"]).withColumn("name", F.lit("grouped"))
    two = M.consistency_loss(p, ["value", "t2"], ["predicted", "p2"], [("p2", "t2")]).withColumn("name", F.lit("consistency"))
    return one.unionByName(two).select("name", F.round("loss", 3).alias("loss"))


@query
def player_trend(spark, d):
    c = t(spark, d, "conversations").filter("conv_id % 11 = 0").groupBy(F.col("turn").alias("week")).agg(F.count("*").alias("actual"))
    p = t(spark, d, "conversations").filter("conv_id % 5 = 0 and turn < 4").groupBy(F.col("turn").alias("week")).agg(F.count("*").alias("predicted"))
    return M.trend(c, p)


@query
def shares(spark, d):
    return M.share_of_total(t(spark, d, "events"), "event_type").select("event_type", "count", E6("share").alias("share"))


@query
def category_values(spark, d):
    return spark.createDataFrame([(i, v) for i, v in enumerate(features.vocabulary(t(spark, d, "customer"), "c_mktsegment"))], "place long, value string")


@query
def slate_points_all(spark, d):
    """All fifteen terms of slate scoring, with bonuses on both sides of their limits."""
    k = F.col("l_linenumber") + F.col("l_orderkey") % 5
    stats = {name: (k * (i + 1)) % (400 if name.endswith("yards") else 4) for i, name in enumerate(S.SLATE_POINTS)} | {"passing_yards": F.col("l_quantity") * 8, "rushing_yards": F.col("l_quantity") * 3, "receiving_yards": F.col("l_quantity") * 4}
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.slate_points(stats), 4).alias("points"))


# predictions


def _roster(spark, d):
    p = t(spark, d, "part")
    position = S.lookup({0: "QB", 1: "RB", 2: "WR", 3: "TE", 4: "K"}, F.col("p_partkey") % 5)
    status = S.lookup({0: "ACT", 1: "Active", 2: "RES"}, F.col("p_partkey") % 3)
    return p.select(F.col("p_partkey").alias("player_id"), F.concat(F.lit("N"), "p_partkey").alias("player_name"), position.alias("position"), F.lit("T").alias("team"), status.alias("status"))


def _facts(spark, d):
    li = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("player_id"), F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week")).agg(F.sum("l_quantity").alias("yards"))
    return li


@query
def prediction_candidates(spark, d):
    """Active players of four positions with the row that their prediction starts from."""
    return predictions.candidates(_roster(spark, d), _facts(spark, d), 1996, 5, 1995).select("player_id", "player_name", "position", "season", "week", E6("yards").alias("yards"))


def _predictions(spark, d):
    r = _roster(spark, d).filter("position <> 'K'")
    amounts = {f"predicted_{s}": (F.col("player_id") * (i + 3)) % 97 for i, s in enumerate(sorted({x for v in predictions.POSITION_STATS.values() for x in v}))}
    return r.withColumns(amounts)


@query
def fantasy_points_of_predictions(spark, d):
    return predictions.fantasy(_predictions(spark, d)).withColumn("fantasy_points", E6("fantasy_points"))


@query
def prediction_comparison(spark, d):
    p = _predictions(spark, d)
    a = p.filter("player_id % 4 <> 0").select("player_name", *((F.col("player_id") * (k + 2) % 89).alias(s) for k, s in enumerate(("passing_yards", "rushing_yards", "receiving_yards"))))
    detail, by_position = predictions.comparison(p, a, "player_name")
    out = detail.groupBy("position").agg(F.count("*").alias("n"), F.count("actual_stat").alias("seen"), F.sum("difference").alias("difference"))
    return out.join(by_position.select("position", E6("mse").alias("mse")), "position")


@query
def starters_by_depth(spark, d):
    r = _roster(spark, d).withColumn("depth_team", F.col("player_id") * 7 % 13)
    return predictions.first_by_depth(r, 3).select("position", "player_id", "depth_team")


@query
def final_columns(spark, d):
    """Predictions in the order of the files: targets, then the player; floored and rounded half to even."""
    p = _predictions(spark, d).select("player_id", "player_name", ((F.col("player_id") % 9 - 3) / 8).alias("predicted_yards"), (F.col("player_id") % 7 / 16 - 0.1).alias("predicted_offensive_snap_pct"))
    return models.finished(p, ["yards", "offensive_snap_pct"]).select("predicted_yards", "predicted_offensive_snap_pct", "player_name")


# models


def _training(spark, d):
    return W.training_rows(t(spark, d, "events").select("user_id", "ts", "value"), ["value"], ["user_id"], ["ts"])


@query
def least_squares(spark, d):
    """One feature by linear regression, saved, loaded and applied: the closed form gives the same."""
    path = scratch(spark, "models")
    models.Regressors(["value"], kind="linear", solver="normal").fit(_training(spark, d), ["next_week_value"]).save(path)
    again = models.Regressors.load(path)
    if again.params != {"solver": "normal"}:
        raise ValueError("parameters were lost")
    rows = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("value"))
    return again.predict(rows, ["c_custkey"]).select("c_custkey", F.round("predicted_value", 3).alias("predicted"))


@query
def model_errors(spark, d):
    rows = _training(spark, d)
    m = models.Regressors(["value"], kind="linear", solver="normal").fit(rows, ["next_week_value"])
    return m.evaluate(rows).select("stat", F.round("mse", 3).alias("mse"), F.round("mae", 3).alias("mae"))


@query
def gated_predictions(spark, d):
    rows = t(spark, d, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("gate"), F.col("p_retailprice").alias("a"))
    return models.gated(rows, "gate", ["a"]).select("p_partkey", F.round("a", 5).alias("a"))


@query
def preprocessed(spark, d):
    rows = t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("yards"), (F.col("s_suppkey") % 3).alias("tries"), F.lit(None).cast("double").alias("goal"))
    return models.preprocess(rows, ["yards"], {"rate": ("s_suppkey", "tries")}, ["yards", "rate"], True, ["goal"]).select("s_suppkey", E6("yards").alias("yards"), E6("rate").alias("rate"), "goal")


@query
def weekly_loop(spark, d):
    """A week comes in, replaces what was there, and is set beside what was predicted for it."""
    e = events(spark, d).select("event_id", F.col("user_id").alias("player_id"), F.year("ts").alias("season"), "week", "ts", "value")
    new = e.filter("event_id % 10 = 0").withColumn("value", F.col("value") + 5)
    old = e.filter("event_id % 10 <> 0")
    guess = e.filter("event_id % 20 = 0").select("event_id", (F.col("value") * 2).alias("predicted"))
    _, _, seen = incremental.weekly_round(old, new, ["value"], None, guess, "event_id")
    return seen.select("event_id", E6("predicted").alias("predicted"), E6("actual_value").alias("actual_value"))


# lineups


@query
def lineup_candidates(spark, d):
    out = lineups.candidates(slate(spark, d), exclude=["P7", "P12"])
    return out.select("nickname", "position", E6("lineup_points").alias("lineup_points"), F.col("value_rank").cast("long").alias("value_rank"), F.col("points_rank").cast("long").alias("points_rank"))

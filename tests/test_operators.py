"""Operators on tiny hand-made frames, with the edge cases of the sport's data."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from downfield.functions import scalars as S
from downfield.operators import features, lineups as L, metrics as M, models, participation as P, predictions, relational as R, windows as W
from downfield.sources import sinks, tables as T
from downfield.streaming import incremental as I


def one(spark, column, **values):
    cols = {k: F.lit(v) if v is not None else F.lit(None).cast("double") for k, v in values.items()}
    return spark.range(1).withColumns(cols).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    nan = float("nan")
    for name, want in {"Odell A. Beckham Jr.": "odell beckham", "A.J. Brown": "aj brown", "Kenneth Walker III": "kenneth walker", "Robert Griffin IV": "robert griffin", "Henry V": "henry v", "Some Jr": "some jr", "\tTim \n": "tim"}.items():
        assert one(spark, S.normalize_name("n"), n=name) == want
    assert [one(spark, S.play_category("p"), p=p) for p in ("run", "punt", "timeout")] == ["scrimmage", "special_teams", "other"]
    assert one(spark, S.slate_points({"passing_yards": "y", "fumbles": "f"}), y=300.0, f=1.0) == pytest.approx(13)
    assert one(spark, S.slate_points({"passing_yards": "y"}), y=299.0) == pytest.approx(11.96)
    assert one(spark, S.slate_points({"passing_yards": S.number(F.col("y"))}), y=nan) is None
    assert one(spark, S.standard_points({"receptions": "r", "rushing_yards": "y"}, ppr=True), r=3.0, y=None) == 3
    assert [one(spark, S.log1p_or_zero("x"), x=x) for x in (-1.0, -5.0, None, nan)] == [0, 0, 0, 0]
    assert one(spark, S.ratio("a", "b"), a=1.0, b=0.0) == 0 and one(spark, S.value_per("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, S.clip("a", 0.0, 100.0), a=None) is None and one(spark, S.clip("a", 0.0, 100.0), a=-2.0) == 0
    assert one(spark, S.half_even("a"), a=0.125) == 0.12 and one(spark, S.finite("a"), a=math.inf) is None
    assert one(spark, S.positional_points("p", "a", "b", "c"), p="QB", a=100.0, b=10.0, c=2.0) == pytest.approx(13)
    assert one(spark, S.season_of_game("g"), g="2023_01_A_B") == 2023


STATS = [("a", 2023, 1, 1.0), ("a", 2023, 2, None), ("a", 2023, 4, 4.0), ("a", 2024, 1, 9.0), ("b", 2023, 3, 5.0), ("c", 2024, 1, 1.0), ("c", 2024, 2, 2.0)]


def stats(spark, rows=STATS):
    return spark.createDataFrame(rows, "player_id string, season int, week int, yards double")


def test_targets_and_last_rows(spark):
    got = {(r["player_id"], r["season"], r["week"]): r["next_week_yards"] for r in W.training_rows(stats(spark), ["yards"]).collect()}
    assert got == {("a", 2023, 1): None, ("a", 2023, 2): 4.0, ("c", 2024, 1): 2.0}


def test_upsert_is_idempotent(spark):
    new = stats(spark, [("c", 2024, 2, 7.0), ("d", 2024, 2, 1.0)])
    once = I.upsert(stats(spark), new, ["yards"])
    twice = I.upsert(once, new, ["yards"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    got = {(r["player_id"], r["week"]): r["next_week_yards"] for r in twice.filter("season = 2024").collect()}
    assert got == {("a", 1): None, ("c", 1): 7.0, ("c", 2): None, ("d", 2): None}


def test_stream_of_weeks(spark, tmp_path):
    at = str(tmp_path)
    for k, rows in enumerate(([("a", 2024, 1, 1.0), ("a", 2024, 2, 2.0)], [("a", 2024, 2, 5.0)], [])):
        stats(spark, rows).write.parquet(f"{at}/in/{k}")
        stream = spark.readStream.schema(stats(spark).schema).option("recursiveFileLookup", True).parquet(f"{at}/in")
        I.stream_upserts(stream, f"{at}/out", f"{at}/check").awaitTermination()
    got = I.with_targets(spark, f"{at}/out", ["yards"]).orderBy("week").collect()
    assert [(r["yards"], r["next_week_yards"]) for r in got] == [(1.0, 5.0), (5.0, None)]


PLAYS = [
    (1, "g", 2023, 1, "run", "A", "B", "p1;p2", "q1;q1"), (2, "g", 2023, 1, "punt", None, None, "p1;q9", "p1"), (3, "g", 2023, 1, "punt", "A", None, "p1;;p2", None),
    (4, "g", 2023, 1, "pass", None, None, "p1", "q1"), (5, "g", 2023, 1, "timeout", "A", "B", "z", ""), (6, "g", 2023, 1, "pass", None, "B", None, "q2"),
]


def test_participation(spark):
    plays = spark.createDataFrame(PLAYS, T.SCHEMAS["pbp"].fieldNames() and "play_seq int, game_id string, season int, week int, play_type string, posteam string, defteam string, offense_players string, defense_players string")
    team = {(r["side"], r["team"]): r["snaps"] for r in P.team_counts(plays).collect()}
    assert team == {("offense", "A"): 1, ("defense", "B"): 2, ("special_teams", "UNKNOWN_TEAM"): 2, ("special_teams", "A"): 2, ("offense", "B"): 1}
    got = {r["player_id"]: r for r in P.snap_counts(plays).collect()}
    assert set(got) == {"p1", "p2", "q1", "q2", "q9"}
    assert (got["p1"]["offensive_snaps"], got["p1"]["special_teams_snaps"], got["p1"]["total_snaps"]) == (1, 2, 3)
    assert got["q1"]["defensive_snaps"] == 2 and got["q1"]["defensive_snap_pct"] == 0  # a defender counts for the possessing team
    assert {r["player_id"]: r for r in P.snap_counts(plays, "side").collect()}["q1"]["defensive_snap_pct"] == 100
    assert got["p1"]["offensive_snap_pct"] == 100 and got["p1"]["special_teams_snap_pct"] == 100 and got["q9"]["special_teams_snap_pct"] == 0
    assert {r["player_id"]: r["snaps"] for r in P.simple_counts(plays).collect()} == {"p1": 4, "p2": 2, "q1": 2, "q2": 1, "q9": 1, "z": 1}


def slate(spark, n=14):
    rows = []
    for position, base in (("QB", 7000), ("RB/FLEX", 6000), ("WR/FLEX", 5500), ("TE/FLEX", 4500), ("DEF", 3500)):
        for k in range(n):
            injury = {0: None, 1: "q", 2: "o", 3: "IR"}.get(k % 7)
            rows.append(("main", f"{position[:2]}{k}", position, base + 100.0 * k, 5.0 + k, injury, None if position == "DEF" else 10.0 + (k * 7) % 11))
    rows.append(("main", "broken", "QB", None, 1.0, None, 1.0))
    return spark.createDataFrame(rows, "slate string, nickname string, position string, salary double, fppg double, injury string, predicted double")


@pytest.mark.parametrize("compat", [False, True])
def test_lineups(spark, compat):
    wanted = 12
    rows = L.optimize(slate(spark), wanted, compat=compat).collect()
    made = {}
    for r in rows:
        made.setdefault(r["lineup_id"], []).append(r)
    assert made and (not compat or len(made) <= 9)
    used = Counter()
    for players in made.values():
        names = [r["nickname"] for r in players]
        assert len(set(names)) == len(names) == 9 and sum(r["salary"] for r in players) <= L.SALARY_CAP
        have = Counter(r["position"] for r in players)
        assert have["QB"] == have["DEF"] == 1 and have["RB/FLEX"] >= 2 and have["WR/FLEX"] >= 3 and have["TE/FLEX"] >= 1
        assert not any((r["injury"] or "").upper() in L.OUT for r in players)
        used.update(names)
    assert len({frozenset(r["nickname"] for r in p) for p in made.values()}) == len(made)
    assert max(used.values()) <= wanted / 2
    if not compat:
        assert len(made) > 5
    usage = {r["nickname"]: r["usage_percentage"] for r in M.usage(spark.createDataFrame(rows, L.RESULT)).collect()}
    assert all(abs(usage[k] - 100 * v / len(made)) < 0.01 for k, v in used.items())
    assert sinks.lineup_report(spark.createDataFrame(rows, L.RESULT)).count() == 10 * len(made)


def test_include_and_exclude(spark):
    got = L.optimize(slate(spark), 2, include=["RB0"], exclude=["QB4"]).collect()
    assert sum(r["nickname"] == "RB0" for r in got) == len({r["lineup_id"] for r in got}) > 0 and not any(r["nickname"] == "QB4" for r in got)


def test_joins_and_lookups(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, None, "q")], "id int, k string, position string")
    b = spark.createDataFrame([("x", "d"), ("x", "e"), (None, "f")], "gsis string, position string")
    got = sorted((r["id"], r["position_x"], r["position_y"] or "") for r in R.left_join(a, b, ["k"], ["gsis"]).collect())
    assert got == [(1, "p", "d"), (1, "p", "e"), (2, "q", "")]
    facts = spark.createDataFrame([("a", 2024, 2, 1), ("a", 2023, 9, 2), ("b", 2023, 5, 3), ("b", 2023, 7, 4), ("c", 2022, 1, 5)], "player_id string, season int, week int, v int")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "player_id string")
    assert {r["player_id"]: r["v"] for r in R.fallback_lookup(wanted, facts, "player_id", 2024, 3, 2023).collect()} == {"a": 1, "b": 4}
    assert R.without_period(facts.union(spark.createDataFrame([("d", None, None, 6)], facts.schema)), 2024, 2).count() == 5


def test_scalers_and_encoders(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    s = features.standard_scaler(df, ["x"])
    assert s.centre["x"] == 4 and s.scale["x"] == pytest.approx(12.5**0.5)
    r = features.robust_scaler(df, ["x"])
    assert (r.centre["x"], r.scale["x"]) == (2.5, 3.0)
    hot = features.one_hot(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), "c", ["a", "b"]).collect()
    assert [(h["c_a"], h["c_b"]) for h in hot] == [(1, 0), (0, 0), (0, 0)]


def test_models_round_trip_and_prediction(spark, tmp_path):
    rows = [(f"p{p}", 2023, w, float(p + w), float(p), "QB" if p % 2 else "RB") for p in range(12) for w in range(1, 6)]
    df = spark.createDataFrame(rows, "player_id string, season int, week int, yards double, skill double, position string")
    m = models.train(df, ["yards"], ["yards", "skill"], ["position"])
    m.save(str(tmp_path / "m"))
    again = models.Regressors.load(str(tmp_path / "m"))
    assert models.Regressors.load(str(tmp_path / "none")) is None
    unseen = df.filter("week = 5").withColumn("position", F.lit("K"))
    a, b = (sorted((r["player_id"], round(r["predicted_yards"], 6)) for r in x.predict(unseen, ["player_id"]).collect()) for x in (m, again))
    assert a == b and all(abs(v - (int(k[1:]) + 6)) < 0.5 for k, v in a)
    assert m.evaluate(W.training_rows(df, ["yards"])).first()["mse"] < 0.1
    roster = spark.createDataFrame([("p1", "Al", "QB", "A", "ACT"), ("p1", "Al", "QB", "A", "ACT"), ("p2", "Bo", "RB", "B", "RES"), ("p4", "Alan", "RB", "B", "Active")], "player_id string, player_name string, position string, team string, status string")
    rows = predictions.candidates(roster, df, 2023, 6, 2023)
    assert sorted(r["player_name"] for r in rows.collect()) == ["Al", "Alan"]
    out = predictions.predict_week(m, rows, ["yards"], 2023, 6).collect()
    assert all(r["predicted_yards"] >= 0.01 and r["week"] == 6 for r in out)


def test_sources_and_sinks(spark, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([(2023, 1, "2023_01_A_B", 1.0), (2024, 2, "2024_02_A_B", float("nan"))], "season int, week int, game_id string, yards double")
    df.write.partitionBy("season").parquet(f"{at}/facts")
    t = T.Tables(spark, at)
    assert [r["yards"] for r in t.load("facts", 2024).collect()] == [None] and t.load("facts", [2023, 2024], ["week"]).columns == ["week"]
    assert t.load_or_empty("slate").count() == 0
    sinks.csv(df, f"{at}/c", index_by=["season"], one_file=True)
    assert [r["index"] for r in T.as_frame(spark, f"{at}/c").orderBy("index").collect()] if f"{at}/c".endswith(".csv") else T.csv(spark, f"{at}/c").count() == 2
    with pytest.raises(ValueError):
        T.as_frame(spark, 3)
    p = df.withColumn("position", F.lit("QB")).drop("season", "week")
    for _ in range(2):
        sinks.predictions(p, f"{at}/p", 2024, 3)
    assert spark.read.parquet(f"{at}/p").count() == 2
    assert T.cached(spark, f"{at}/q", lambda: df).count() == T.cached(spark, f"{at}/q", lambda: None).count() == 2
    assert T.seasons(2018, 2021) == [2018, 2019, 2020] and T.literal(spark, {"a": [1, 2], "b": ["x", "y"]}).count() == 2


def test_player_lists_as_arrays(spark):
    from pyspark.sql import functions as F

    from downfield.operators import participation as P

    rows = [(1, "2024_01_A_B", 2024, 1, "run", "A", "B", "a;b;;a", "c"), (2, "2024_01_A_B", 2024, 1, "punt", None, None, "a;d", "d;c"), (3, "2024_01_A_B", 2024, 1, "timeout", "B", None, "e", None), (4, "2024_01_A_B", 2024, 1, "pass", None, None, "f", "a")]
    plays = spark.createDataFrame(rows, "play_seq int, game_id string, season int, week int, play_type string, posteam string, defteam string, offense_players string, defense_players string")
    arrays = plays.withColumns({c: F.split(c, ";") for c in ("offense_players", "defense_players")})
    key = lambda df: sorted(map(str, df.collect()))
    for rule in ("first_posteam", "side"):
        assert key(P.snap_counts(plays, rule)) == key(P.snap_counts(arrays, rule))
        counts = {(r["game_id"], r["player_id"]): r for r in P.player_counts(plays).collect()}
        teams = {(r["game_id"], r["player_id"]): r["team"] for r in P.player_teams(plays, rule).collect()}
        got = {(r["game_id"], r["player_id"]): r for r in P.player_rows(plays, rule).collect()}
        assert got.keys() == counts.keys()
        for k, r in got.items():
            assert r["team"] == teams[k] and all(r[c] == counts[k][c] for c in ("season", "week", "offense_snaps", "defense_snaps", "special_teams_snaps"))


def test_total_orders_by_ranges(spark):
    from downfield.operators import windows as W
    from pyspark.sql import functions as F

    df = spark.range(5000).select("id", F.when(F.col("id") % 97 != 0, (F.col("id") * 7919 % 1000).cast("double")).alias("x"))
    got = {r["id"]: r["rank"] for r in W.ranked(df, "x", "id").collect()}
    want = sorted(df.collect(), key=lambda r: (r["x"] is None, -(r["x"] or 0), r["id"]))
    assert got == {r["id"]: i + 1 for i, r in enumerate(want)}
    up = {r["id"]: r["n"] for r in W.numbered(df, ["x", "id"], "n").collect()}
    want = sorted(df.collect(), key=lambda r: (r["x"] is not None, r["x"] or 0, r["id"]))
    assert up == {r["id"]: i + 1 for i, r in enumerate(want)} and W.numbered(df.limit(0), ["x"], "n").count() == 0


def test_small_results_only(spark):
    import pytest

    from downfield.sources import sinks, tables

    assert len(sinks.rows(spark.range(5))) == 5
    with pytest.raises(ValueError):
        sinks.rows(spark.range(11), most=10)
    with pytest.raises(Exception):
        tables.Tables(spark, "/nowhere").load_or_empty("unknown_table")


def test_exact_quantiles(spark):
    import numpy as np
    from downfield.operators import features as X, windows as W
    from pyspark.sql import functions as F

    df = spark.range(3001).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 2 == 0, 7.5).otherwise(F.col("id") * 31 % 997 / 3)).alias("x"))
    rows = [(r["g"], r["x"]) for r in df.collect() if r["x"] is not None]
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    for g, got in [(None, W.quantiles(df, "x", shares).first())] + [(r["g"], r) for r in W.quantiles(df, "x", shares, "g").collect()]:
        want = np.percentile([x for h, x in rows if g is None or g == h], [100 * p for p in shares])
        assert np.allclose([got[f"q{i}"] for i in range(len(shares))], want)
    assert W.quantiles(df.limit(0), "x", shares).count() == 0 and X.robust_scaler(df.limit(0), ["x"]).scale == {"x": 1.0}

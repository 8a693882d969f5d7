"""Participation counts from plays with delimited player lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from downfield.functions import scalars as S

SIDES = ("offense", "defense", "special_teams")


def prepared(plays: DataFrame) -> DataFrame:
    """Plays with category, resolved teams and player arrays; scrimmage and other plays without any team are skipped."""
    cat = S.play_category("play_type")
    out = plays.withColumn("category", cat)
    out = out.withColumns({
        "pos": S.resolved_team("posteam", "defteam", "category"), "def": S.resolved_team("defteam", "posteam", "category"),
        "off_list": S.without_empty(S.players("offense_players", of=plays)), "def_list": S.without_empty(S.players("defense_players", of=plays)),
    })
    return out.filter((F.col("category") == "special_teams") | F.col("posteam").isNotNull() | F.col("defteam").isNotNull())


def team_counts(plays: DataFrame) -> DataFrame:
    """game_id, side, team, snaps: a special-teams play counts once for each side, so twice for a team that stands for both."""
    cell = lambda side, team: F.struct(F.lit(side).alias("side"), F.col(team).alias("team"))
    cells = F.when(F.col("category") == "special_teams", F.array(cell("special_teams", "pos"), cell("special_teams", "def"))).when(F.col("category") == "scrimmage", F.array(cell("offense", "pos"), cell("defense", "def")))
    return prepared(plays).select("game_id", F.explode(cells).alias("c")).groupBy("game_id", "c.side", "c.team").agg(F.count("*").alias("snaps"))


def player_counts(plays: DataFrame) -> DataFrame:
    """game_id, player_id, week, season and snaps by side; on special teams a player counts once a play, else as often as listed."""
    tag = lambda arr, side: F.transform(arr, lambda p: F.struct(p.alias("player_id"), F.lit(side).alias("side")))
    both = F.array_union("off_list", "def_list")
    seen = F.when(F.col("category") == "special_teams", tag(both, "special_teams")).when(F.col("category") == "scrimmage", F.concat(tag(F.col("off_list"), "offense"), tag(F.col("def_list"), "defense")))
    rows = prepared(plays).select("game_id", "season", "week", F.explode(seen).alias("p"))
    counted = {f"{s}_snaps": F.count_if(F.col("p.side") == s) for s in SIDES}
    return rows.groupBy("game_id", F.col("p.player_id").alias("player_id")).agg(F.min("season").alias("season"), F.min("week").alias("week"), *(c.cast("long").alias(k) for k, c in counted.items()))


def player_teams(plays: DataFrame, team_rule: str = "first_posteam") -> DataFrame:
    """game_id, player_id, team: by default the possessing team of the first play that lists the player, of any category.

    ``team_rule='side'`` takes the team of the side that lists the player, in the first play with one.
    """
    lists = {"offense_players": "posteam", "defense_players": "defteam" if team_rule == "side" else "posteam"}
    rows = plays.select("game_id", "play_seq", F.explode(F.concat(*(F.transform(S.without_empty(S.players(c, of=plays)), _with_team(F.col(t), k)) for k, (c, t) in enumerate(lists.items())))).alias("p"))
    order = F.struct("play_seq", "p.k")  # of both sides of one play the offence comes first
    chosen = F.min_by("p.team", order if team_rule != "side" else F.when(F.col("p.team").isNotNull(), order))
    return rows.groupBy("game_id", F.col("p.player_id").alias("player_id")).agg(chosen.alias("team"))


def _with_team(team: Column, k: int):
    return lambda x: F.struct(x.alias("player_id"), team.alias("team"), F.lit(k).alias("k"))


def player_rows(plays: DataFrame, team_rule: str = "first_posteam") -> DataFrame:
    """What ``player_counts`` and ``player_teams`` tell, by one explode and one aggregate over the plays."""
    off, dfn = (S.without_empty(S.players(c, of=plays)) for c in ("offense_players", "defense_players"))
    cat = S.play_category("play_type")
    out = plays.select("game_id", "season", "week", "play_seq", "posteam", F.col("defteam" if team_rule == "side" else "posteam").alias("other"), cat.alias("category"), ((cat == "special_teams") | F.col("posteam").isNotNull() | F.col("defteam").isNotNull()).alias("counts"), off.alias("off"), dfn.alias("dfn"))
    entry = lambda p, side, k, team: F.struct(p.alias("player_id"), F.when(F.col("counts"), side).alias("side"), F.lit(k).alias("k") if isinstance(k, int) else k.alias("k"), team.alias("team"))
    both = F.concat(F.transform("off", lambda p: entry(p, F.lit("offense"), 0, F.col("posteam"))), F.transform("dfn", lambda p: entry(p, F.lit("defense"), 1, F.col("other"))))
    mine = lambda p: F.array_contains("off", p)
    # off scrimmage a player comes once a play, on the offence's side if listed there
    side = F.when(F.col("category") == "special_teams", F.lit("special_teams"))
    once = F.transform(F.array_union("off", "dfn"), lambda p: entry(p, side, F.when(mine(p), 0).otherwise(1), F.when(mine(p), F.col("posteam")).otherwise(F.col("other"))))
    rows = out.select("game_id", "season", "week", "play_seq", F.explode(F.when(F.col("category") == "scrimmage", both).otherwise(once)).alias("p"))
    order = F.struct("play_seq", "p.k")
    chosen = F.min_by("p.team", order if team_rule != "side" else F.when(F.col("p.team").isNotNull(), order))
    counted = {f"{s}_snaps": F.count_if(F.col("p.side") == s).cast("long") for s in SIDES}
    seen = F.col("p.side").isNotNull()
    out = rows.groupBy("game_id", F.col("p.player_id").alias("player_id")).agg(F.min(F.when(seen, F.col("season"))).alias("season"), F.min(F.when(seen, F.col("week"))).alias("week"), chosen.alias("team"), *(c.alias(k) for k, c in counted.items()))
    return out.filter(" + ".join(counted) + " > 0")


def snap_counts(plays: DataFrame, team_rule: str = "first_posteam") -> DataFrame:
    """Player counts with totals and percentages of the team's counts (0 where that count is missing)."""
    teams = team_counts(plays).groupBy("game_id", "team").agg(*(F.sum(F.when(F.col("side") == s, F.col("snaps")).otherwise(0)).alias(f"team_{s}") for s in SIDES))
    out = player_rows(plays, team_rule).join(teams, ["game_id", "team"], "left")
    share = lambda s: F.when(F.col(f"team_{s}") > 0, F.col(f"{s}_snaps") / F.col(f"team_{s}") * 100).otherwise(0.0)
    names = {"offense": "offensive", "defense": "defensive", "special_teams": "special_teams"}
    return out.select(
        "player_id", "game_id", "week", "season", *(F.col(f"{s}_snaps").alias(f"{names[s]}_snaps") for s in SIDES),
        S.total([f"{s}_snaps" for s in SIDES]).alias("total_snaps"), *(share(s).alias(f"{names[s]}_snap_pct") for s in SIDES),
    )


def simple_counts(plays: DataFrame) -> DataFrame:
    """player_id, season, week, snaps: plays of any kind that list the player, each once."""
    everyone = S.without_empty(F.array_distinct(F.concat(S.players("offense_players", of=plays), S.players("defense_players", of=plays))))
    return plays.select("season", "week", F.explode(everyone).alias("player_id")).groupBy("player_id", "season", "week").agg(F.count("*").alias("snaps"))

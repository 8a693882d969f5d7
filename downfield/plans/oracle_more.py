"""DuckDB SQL for the queries of ``more``."""

from __future__ import annotations

from downfield.plans.oracle import _EVENTS, _PLAYS, _PREDICTED

SQL: dict[str, str] = {}
_PREDICTED_TWO = f"(select *, predicted * 1.1 other, value * 2 t2, predicted * 2 p2 from {_PREDICTED})"
_SLATE = """(select concat('P', p_partkey) nickname, case p_partkey % 5 when 0 then 'QB' when 1 then 'RB/FLEX' when 2 then 'WR/FLEX' when 3 then 'TE/FLEX' else 'DEF' end "position",
  p_retailprice * 4 + 2000 salary, p_size::double fppg, case p_partkey % 23 when 1 then 'O' when 2 then 'q' when 3 then 'ir' end injury, (p_size + p_partkey % 7)::double predicted from part)"""
_ROSTER = """(select p_partkey player_id, concat('N', p_partkey) player_name, case p_partkey % 5 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' when 3 then 'TE' else 'K' end "position",
  case p_partkey % 3 when 0 then 'ACT' when 1 then 'Active' else 'RES' end status from part)"""
#: The stats of the four positions in alphabetical order, as the generated predictions number them.
_STATS = ("attempts", "carries", "completions", "passing_yards", "receiving_yards", "receptions", "rushing_yards", "targets")
_P = {s: f"(player_id * {i + 3}) % 97" for i, s in enumerate(_STATS)}
_TRAINING = "(select value x, lead(value) over (partition by user_id order by ts) y from events qualify y is not null)"
_FIT = f"(select regr_slope(y, x) a, regr_intercept(y, x) b from {_TRAINING})"
_TERMS = ("passing_yards", "passing_tds", "interceptions", "rushing_yards", "rushing_tds", "receptions", "receiving_yards", "receiving_tds", "fumbles", "return_tds", "two_point_conversions", "field_goals_0_39", "field_goals_40_49", "field_goals_50_plus", "extra_points")
_POINTS = (0.04, 4.0, -1.0, 0.1, 6.0, 0.5, 0.1, 6.0, -2.0, 6.0, 2.0, 3.0, 4.0, 5.0, 1.0)
_YARDS = {"passing_yards": ("l_quantity * 8", 300), "rushing_yards": ("l_quantity * 3", 100), "receiving_yards": ("l_quantity * 4", 100)}


def _slate_points() -> str:
    parts = []
    for i, (name, points) in enumerate(zip(_TERMS, _POINTS)):
        value = _YARDS[name][0] if name in _YARDS else f"((l_linenumber + l_orderkey % 5) * {i + 1}) % 4"
        parts.append(f"({value}) * {points}::double")
        if name in _YARDS:
            parts.append(f"case when {value} >= {_YARDS[name][1]} then 3.0::double else 0 end")
    return " + ".join(parts)


SQL |= {
    "scan_by_years": "select o_orderkey, year(o_orderdate)::int season, month(o_orderdate)::int as week from orders where year(o_orderdate) between 1993 and 1995",
    "scan_player_weeks": "select '3' player_id, (conv_id % 3 + 2021)::int season, turn::int as week, length(text)::double passing_yards, 0.0::double rushing_yards from conversations where conv_id % 7 = 3 and conv_id % 3 in (0, 1)",
    "scan_game_plays": f"with {_PLAYS} select play_seq, season, length(defense_players) listed from plays where game_id = '1994_3' union all select play_seq, season, 7 from plays where season = 1995",
    "scan_or_empty": "select r_regionkey, r_name, 11::bigint columns from region",
    "literal_frame": "select * from (values ('a', 1::bigint), ('b', 2), ('c', 3)) t(name, rank)",
    "csv_round_trip": "select row_number() over (order by n_nationkey) - 1 as index, n_nationkey::bigint n_nationkey, n_name from nation",
    "predictions_by_week": """with p as (select case p_partkey % 3 when 0 then 'QB' when 1 then 'RB' else 'TE' end "position", p_retailprice x from part)
        select 2024 season, w as week, "position", count(*) n, round(sum(x + case when w = 3 and "position" <> 'TE' then 1 else 0 end), 2) total from p, (select unnest([3, 4]) w) group by all""",
    "lineup_report": f"""with r as (select *, substr(nickname, 2)::int slot from {_SLATE} where nickname in ('P5', 'P6', 'P7', 'P8', 'P9', 'P10'))
        select slot::bigint slot, trim(format('{{:<8s}} {{:<24s}} {{:8.0f}} {{:8.2f}} {{}}', "position", nickname, salary, predicted, coalesce(injury, ''))) line from r
        union all select 1000, format('Total salary {{:.0f}}, points {{:.2f}}', sum(salary), sum(predicted)) from r""",
    "rows_at_the_edge": "select r_regionkey, r_name from region",
    "projection_defaults": "select s_suppkey, s_name next_week_s_name, 2024 season, 7 missing from supplier",
    "dynamic_sort_column": "select s_suppkey, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 10",
    "mae_by_group": f"select event_type, round(avg(abs(predicted - stat)), 4) mae from {_PREDICTED} group by 1",
    "mse_of_targets": f"select round(avg((predicted - value) ** 2), 3) as value, round(avg((other - stat) ** 2), 3) stat from {_PREDICTED_TWO}",
    "strict_mse": f"select event_type, case when count(*) = count(stat) then round(avg((predicted - stat) ** 2), 4) end mse from {_PREDICTED} group by 1",
    "density": f"select x, round(avg(exp(-(((value - x) / 25.0) ** 2) / 2) / (25.0 * sqrt(2 * 3.141592653589793))), 9) density from {_EVENTS}, (select unnest([0.0, 50.0, 100.0, 200.0])::double x) group by x",
    "losses": f"""select 'grouped' as name, round((avg((predicted - value) ** 2) + avg((p2 - t2) ** 2)) / 2, 3) loss from {_PREDICTED_TWO}
        union all select 'consistency', round((avg((predicted - value) ** 2) + avg((p2 - t2) ** 2)) / 2 + 0.1 * avg(greatest(p2 - t2, 0)) + 0.01 * (avg(abs(predicted)) + avg(abs(p2))) / 2, 3) from {_PREDICTED_TWO}""",
    "player_trend": "select week, actual, predicted from (select turn as week, count(*) actual from conversations where conv_id % 11 = 0 group by 1) left join (select turn as week, count(*) predicted from conversations where conv_id % 5 = 0 and turn < 4 group by 1) using (week)",
    "shares": "select event_type, count(*) as count, round(count(*) / (select count(*) from events), 6) share from events group by 1",
    "category_values": "select row_number() over (order by v) - 1 place, v as value from (select distinct c_mktsegment v from customer)",
    "slate_points_all": f"select l_orderkey, l_linenumber, l_partkey, round({_slate_points()}, 4) points from lineitem",
    "prediction_candidates": f"""with f as (select l_partkey player_id, year(l_shipdate)::int season, month(l_shipdate)::int as week, sum(l_quantity) yards from lineitem group by all),
        b as (select * from f where (season = 1996 and week = 4) or season = 1995 qualify row_number() over (partition by player_id order by case when season = 1996 then 0 else 1 end, week desc) = 1)
        select player_id, player_name, "position", season, week, round(yards, 6) yards from {_ROSTER} join b using (player_id) where status in ('ACT', 'Active') and "position" <> 'K'""",
    "fantasy_points_of_predictions": f"""select player_name, "position", round(case "position" when 'QB' then {_P["passing_yards"]} * 0.04 + {_P["completions"]} * 4 + {_P["attempts"]} * 0.1
        when 'RB' then {_P["rushing_yards"]} * 0.1 + {_P["carries"]} * 0.5 + {_P["receiving_yards"]} * 0.1 else {_P["receiving_yards"]} * 0.1 + {_P["receptions"]} * 0.5 end, 6)::double fantasy_points from {_ROSTER} where "position" <> 'K'""",
    "prediction_comparison": f"""with p as (select *, case "position" when 'QB' then {_P["passing_yards"]} when 'RB' then {_P["rushing_yards"]} else {_P["receiving_yards"]} end predicted,
          case when player_id % 4 <> 0 then case "position" when 'QB' then player_id * 2 % 89 when 'RB' then player_id * 3 % 89 else player_id * 4 % 89 end end actual from {_ROSTER} where "position" <> 'K')
        select "position", count(*) n, count(actual) seen, sum(predicted - actual) difference, round(avg((predicted - actual) ** 2), 6) mse from p group by 1""",
    "starters_by_depth": f"""select "position", player_id, player_id * 7 % 13 depth_team from {_ROSTER} qualify row_number() over (partition by "position" order by player_id * 7 % 13, player_id) <= 3""",
    "final_columns": f"""select round_even(greatest((player_id % 9 - 3) / 8, 0.01), 2) predicted_yards, round_even(player_id % 7 / 16 - 0.1::double, 2) predicted_offensive_snap_pct, player_name from {_ROSTER} where "position" <> 'K'""",
    "least_squares": f"select c_custkey, round(a * c_acctbal + b, 3) predicted from customer, {_FIT}",
    "model_errors": f"select 'value' stat, round(avg((a * x + b - y) ** 2), 3) mse, round(avg(abs(a * x + b - y)), 3) mae from {_TRAINING}, {_FIT}",
    "gated_predictions": "select p_partkey, round(p_retailprice / (1 + exp(-(p_size / 10.0::double))), 5) a from part",
    "preprocessed": "select s_suppkey, round(case when s_suppkey % 4 <> 0 and s_acctbal > -1 then ln(1 + s_acctbal) else 0 end, 6)::double yards, round(case when s_suppkey % 3 > 0 then s_suppkey / (s_suppkey % 3) else 0 end, 6)::double rate, 0.0::double goal from supplier",
    "weekly_loop": "select event_id, round(value * 2, 6) predicted, round(value + 5, 6) actual_value from events where event_id % 20 = 0",
    "lineup_candidates": f"""with c as (select *, case when "position" = 'DEF' then fppg else predicted end lineup_points from {_SLATE} where coalesce(upper(injury), '') not in ('IR', 'O', 'D') and nickname not in ('P7', 'P12'))
        select nickname, "position", round(lineup_points, 6) lineup_points, row_number() over (partition by "position" order by lineup_points / salary desc, nickname) value_rank, row_number() over (partition by "position" order by lineup_points desc, nickname) points_rank from c""",
}

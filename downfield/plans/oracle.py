"""DuckDB SQL for the registered queries."""

from __future__ import annotations

SQL: dict[str, str] = {}
_EVENTS = "(select *, date_trunc('week', ts)::timestamp as week, case when event_id % 7 <> 0 then value end as stat from events)"
_PREDICTED = f"(select e.*, avg(value) over (partition by user_id) as predicted from {_EVENTS} e)"
_PLAYS = """plays as (
  select o_orderkey::int play_seq, concat(year(o_orderdate), '_', o_custkey % 20) game_id, year(o_orderdate)::int season, 1 as week,
    case o_orderpriority when '1-URGENT' then 'run' when '2-HIGH' then 'pass' when '3-MEDIUM' then 'kickoff' when '4-NOT SPECIFIED' then 'punt' else 'timeout' end play_type,
    case when o_orderkey % 11 <> 0 then concat('T', o_custkey % 4) end posteam,
    case when o_orderkey % 13 <> 0 and o_orderkey % 22 <> 0 then concat('T', (o_custkey + 1) % 4) end defteam,
    case when o_orderkey % 17 <> 0 then concat(array_to_string(list_sort(p), ';'), ';') end offense_players, array_to_string(list_sort(s), ';') defense_players
  from orders join (select l_orderkey, list(l_partkey) p, list(l_suppkey) s from lineitem group by 1) on o_orderkey = l_orderkey),
lists as (
  select *, list_filter(string_split(coalesce(offense_players, ''), ';'), lambda x: x <> '') o, list_filter(string_split(coalesce(defense_players, ''), ';'), lambda x: x <> '') d,
    case when play_type in ('run', 'pass', 'no_play') then 'scrimmage' when play_type in ('kickoff', 'punt', 'field_goal', 'extra_point') then 'special_teams' else 'other' end category from plays),
ready as (
  select *, coalesce(posteam, defteam, case when category = 'special_teams' then 'UNKNOWN_TEAM' end) pos, coalesce(defteam, posteam, case when category = 'special_teams' then 'UNKNOWN_TEAM' end) def
  from lists where category = 'special_teams' or posteam is not null or defteam is not null),
team_counts as (
  select game_id, side, team, count(*) snaps from (
    select game_id, 'special_teams' side, unnest([pos, def]) team from ready where category = 'special_teams'
    union all select game_id, 'offense', pos from ready where category = 'scrimmage' union all select game_id, 'defense', def from ready where category = 'scrimmage') group by all),
player_counts as (
  select game_id, player_id, min(season) season, count(*) filter (side = 'offense') offense_snaps, count(*) filter (side = 'defense') defense_snaps, count(*) filter (side = 'special_teams') special_teams_snaps from (
    select game_id, season, 'special_teams' side, unnest(list_distinct(o || d)) player_id from ready where category = 'special_teams'
    union all select game_id, season, 'offense', unnest(o) from ready where category = 'scrimmage' union all select game_id, season, 'defense', unnest(d) from ready where category = 'scrimmage') group by game_id, player_id)"""


def _pct(team: str) -> str:
    cell = lambda side: f"round(coalesce({side}_snaps * 100.0 / (select snaps from team_counts c where c.game_id = p.game_id and c.team = t.team and c.side = '{side}'), 0), 6)"
    return f"{cell('offense')} offensive_snap_pct, {cell('defense')} defensive_snap_pct, {cell('special_teams')} special_teams_snap_pct"


_W = "(partition by user_id order by ts)"
SQL |= {
    "lead_targets": f"select event_id, user_id, value, lead(value) over {_W} next_week_value from events",
    "training_rows": f"select event_id, c_mktsegment, next_week_stat, next_week_value from (select event_id, user_id, lead(stat) over {_W} next_week_stat, lead(value) over {_W} next_week_value, row_number() over (partition by user_id order by ts desc) r from {_EVENTS}) left join customer on user_id = c_custkey where r > 1",
    "drop_last_week": "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) > 1",
    "last_row_per_key": "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc) = 1",
    "first_row_per_key": "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts) = 1",
    "tail_16": "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc) <= 16",
    "head_per_position": "select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part qualify rank <= 3",
    "topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "sleepers": "select c_custkey, predicted_rank, c_custkey::int adp_rank from (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) predicted_rank from customer) where c_custkey % 3 <> 0 and c_custkey - predicted_rank > 20",
    "value_over_replacement": "with p as (select *, case when p_size % 2 = 0 then 'QB' else p_brand end as position from part) select p_partkey, position, round(p_retailprice - nth_value(p_retailprice, case when position = 'QB' then 13 else 25 end) over (partition by position order by p_retailprice desc, p_partkey rows between unbounded preceding and unbounded following), 6) vorp from p",
    "latest_depth_chart": f"select user_id, event_type, arg_max(stat, event_id) filter (stat is not null) stat, arg_max(props, event_id) filter (props is not null) props from {_EVENTS} group by all",
    "split_80_20": "select c_custkey, case when row_number() over (order by c_custkey) <= floor(0.8 * count(*) over ()) then 'train' else 'test' end part from customer",
    "team_snap_counts": f"with {_PLAYS} select * from team_counts",
    "player_snap_counts": f"with {_PLAYS} select * from player_counts",
    "snap_pct": f"with {_PLAYS}, t as (select game_id, player_id, arg_min_null(posteam, play_seq) team from (select game_id, play_seq, posteam, unnest(o || d) player_id from lists) group by all) select player_id, game_id, offense_snaps + defense_snaps + special_teams_snaps total_snaps, {_pct('team')} from player_counts p join t using (game_id, player_id)",
    "snap_pct_by_side": f"with {_PLAYS}, t as (select game_id, player_id, arg_min(team, 2 * play_seq + k) team from (select game_id, play_seq, posteam team, unnest(o) player_id, 0 k from lists union all select game_id, play_seq, defteam, unnest(d), 1 from lists) group by all) select player_id, game_id, {_pct('team')} from player_counts p join t using (game_id, player_id)",
    "simple_snap_count": f"with {_PLAYS} select player_id, season, count(*) snaps from (select season, unnest(list_distinct(o || d)) player_id from lists) group by all",
    "left_join_dim": "select c_custkey, c_nationkey as key, c_name name_x, n_nationkey, n_name name_y from customer left join (select * from nation where n_nationkey % 2 = 0) on c_nationkey = n_nationkey",
    "left_join_3key": "with e as (select event_id, user_id, year(ts)::int season, month(ts)::int as month from events) select e.*, n from e left join (select user_id, season, month, count(*) n from e where event_id % 3 = 0 group by all) using (user_id, season, month)",
    "left_join_suffix": "select o_orderkey, o_custkey k, o_orderstatus status, l_orderkey, l_linestatus status_depth_chart, l_linenumber from orders left join (select distinct l_orderkey, l_linestatus, l_linenumber from lineitem) on o_orderkey = l_orderkey",
    "semi_join_starters": "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F' union select o_orderkey % 97 from orders where o_orderstatus = 'F')",
    "positional_join": "select n_nationkey, n_name, r_regionkey, r_name from (select *, row_number() over (order by n_nationkey) i from nation) a full join (select *, row_number() over (order by r_regionkey) i from region) b on a.i = b.i",
    "fallback_lookup": "with e as (select conv_id player_id, conv_id % 2 + 2023 season, turn as week, role from conversations) select * from e where player_id in (select conv_id from conversations where turn = 0) and ((season = 2024 and week = 2) or season = 2023) qualify row_number() over (partition by player_id order by case when season = 2024 and week = 2 then 0 else 1 end, week desc) = 1",
    "update_coalesce": "select c_custkey, coalesce(case when s_suppkey % 2 = 0 then s_acctbal end, c_acctbal) c_acctbal, c_mktsegment from customer left join supplier on c_custkey = s_suppkey",
    "name_containment_first": "select a.n_nationkey, min(b.n_nationkey) found from nation a join nation b on regexp_matches(b.n_name, '(?i)' || a.n_name) group by 1",
    "upsert_week": f"with e as (select event_id, user_id, ts, week, value from {_EVENTS}), n as (select * replace (value + 1000 as value) from e where month(ts) = 1 and event_id % 2 = 0), w as (select * from e where week not in (select week from n) union all select * from n) select event_id, value, lead(value) over (partition by user_id order by ts, event_id) next_week_value from w",
    "team_schedule": "with g as (select o_orderkey, o_custkey % 32 home_team, o_orderkey % 32 away_team from orders) select * from g where home_team = 7 union all select * from g where away_team = 7",
    "union_all": "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' union all select o_orderkey, null from orders where o_orderstatus = 'O'",
    "distinct_rows": "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem",
    "distinct_first_seen": "select o_custkey, min(o_orderkey) first_position from orders group by 1",
    "filter_conj": "select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'",
    "filter_isin": "select p_partkey from part where p_size in (1, 2, 3)",
    "filter_not_isin": "select o_orderkey, s from (select o_orderkey, case when o_orderkey % 5 <> 0 then lower(o_orderstatus) end s from orders) where upper(coalesce(s, '')) not in ('O', 'P')",
    "filter_regex": "select p_partkey from part where p_partkey % 9 <> 0 and regexp_matches(p_name, '(?i)B.*RING')",
    "filter_scalar_max": "select conv_id, turn from conversations where turn = (select max(turn) from conversations)",
    "filter_prior_week": "with c as (select conv_id, conv_id % 2 + 2023 season, turn as week from conversations) select * from c where season = 2023 and week = (select max(week) from c where season = 2023) union all select * from c where season = 2024 and week = 3",
    "filter_range": "select o_orderkey from orders where year(o_orderdate) = 1995 and month(o_orderdate) < 6",
    "without_period": "select * from (select o_orderkey, case when o_orderkey % 7 <> 0 then year(o_orderdate)::int end season, month(o_orderdate)::int as week from orders) where not coalesce(season = 1995 and week = 6, false)",
    "any_null_exclusion": f"select event_id from (select event_id, lead(stat) over {_W} a, lead(value) over {_W} b from {_EVENTS}) where a is not null and b is not null",
    "array_contains_players": f"with {_PLAYS} select play_seq from plays where list_contains(string_split(defense_players, ';'), '7')",
    "value_per_dollar": "select p_partkey, round(p_size / case when p_partkey % 10 <> 0 then p_retailprice end * 1000, 6) as value from part",
    "log1p_features": "select s_suppkey, round(case when s_acctbal > -1 then ln(1 + s_acctbal) else 0 end, 6) log_acctbal from supplier",
    "ratio_features": "select p_partkey, round(case when p_size % 5 > 0 then p_retailprice / (p_size % 5) else 0 end, 6) ratio from part",
    "clip_fill": "with c as (select c_custkey, case when c_custkey % 5 <> 0 then c_acctbal / 50 end x from customer) select c_custkey, case when x is not null then least(greatest(x, 0), 100) end clipped, coalesce(case when x is not null then least(greatest(x, 0), 100) end, 0) filled, case when x is not null then greatest(x, 0.01) end floored, coalesce(x + c_custkey, 0) total from c",
    "play_categories": f"with {_PLAYS} select category, season, count(*) n from lists group by all",
    "conditional_assign": "select concat('P', p_partkey) nickname, (case when p_partkey % 5 = 4 then p_size else p_size + p_partkey % 7 end)::double points from part",
    "scoring_weeks": "select * from (select o_orderkey, o_custkey % 8 + 2018 season, o_orderkey % 20 as week from orders) where week between 1 and case when season >= 2021 then 18 else 17 end",
    "long_stats": "select p_partkey, 'size' stat, p_size::double as value from part union all select p_partkey, 'price', p_retailprice from part",
    "mse_by_group": f"select event_type, round(avg((predicted - stat) * (predicted - stat)), 4) mse from {_PREDICTED} group by 1",
    "mape_accuracy": f"select event_type, round(1 - avg(abs((a - predicted) / nullif(a, 0))), 4) accuracy from (select *, round(value) a from {_PREDICTED}) group by 1",
    "consistency_cv": f"select user_id, round(stddev_pop(stat) / nullif(avg(stat), 0), 6) cv from {_EVENTS} group by 1",
    "mean_std": f"select event_type, round(avg(stat), 6) mean, round(stddev_pop(stat), 6) std from {_EVENTS} group by 1",
    "usage_pct": "select l_suppkey nickname, count(*) count, round_even(count(*) * 100.0 / (select count(distinct l_orderkey) from lineitem), 2) pct from lineitem group by 1",
    "usage_by_position": "select l_returnflag, l_suppkey, count(*) count from lineitem group by all",
    "lineup_sums": "select l_orderkey lineup_id, sum(l_quantity) salary, sum(l_linenumber)::double points, concat(sum(l_linenumber), '.00') report from lineitem group by 1",
    "box_stats": "select event_type, round(min(value), 6) low, round(quantile_cont(value, 0.25), 6) q1, round(quantile_cont(value, 0.5), 6) median, round(quantile_cont(value, 0.75), 6) q3, round(max(value), 6) high from events group by 1",
    "histogram": f"select floor(stat / 10.0)::bigint bucket, count(*) n from {_EVENTS} where stat is not null group by 1",
    "weekly_mse": f"select week, round(avg((predicted - stat) * (predicted - stat)), 4) mse from {_PREDICTED} group by 1",
    "compare_predictions": "select user_id, max(value) predicted_stat, case when user_id % 3 <> 0 then min(value) end actual_stat, round(max(value) - case when user_id % 3 <> 0 then min(value) end, 6) difference from events group by 1",
    "standard_scale": "select event_id, round((value - (select avg(value) from events)) / (select stddev_pop(value) from events), 6) as value from events",
    "zscore": "select c_custkey, round((c_acctbal - (select avg(c_acctbal) from customer)) / (select stddev_samp(c_acctbal) from customer), 6) z from customer",
    "robust_scale": "select event_id, round((value - (select quantile_cont(value, 0.5) from events)) / (select quantile_cont(value, 0.75) - quantile_cont(value, 0.25) from events), 6) as value from events",
    "label_encode": "select c_custkey, dense_rank() over (order by c_mktsegment) - 1 code from customer",
    "one_hot": "select c_custkey, (c_mktsegment = 'AUTOMOBILE')::int::double \"s_AUTOMOBILE\", (c_mktsegment = 'BUILDING')::int::double \"s_BUILDING\", 0::double \"s_NOWHERE\" from customer",
}
_NAME = r"trim(lower(replace(regexp_replace(regexp_replace({0}, '\s+(Jr\.|Sr\.|I{{2,}}|IV)$', '', 'g'), '\s+[A-Z]\.\s+', ' ', 'g'), '.', '')), E' \t\n\r')"
_ENDING = "case c_custkey % {0} when 0 then ' Jr.' when 1 then ' III' when 2 then ' IV' when 3 then ' V' when 4 then ' Jr' {1} else '' end"
SQL["normalize_names"] = "select c_custkey, " + _NAME.format("concat('A.J. B. ', c_name, " + _ENDING.format(8, r"when 5 then E'\tSr.' when 6 then E' \n'") + ")") + " as name from customer"
SQL["normalized_name_join"] = f"""with a as (select c_custkey, concat(' Odell A. ', c_name, {_ENDING.format(6, "")}) nickname from customer),
b as (select concat('O.dell ', c_name) player_name, c_acctbal from customer where c_custkey % 2 = 0)
select c_custkey, nickname, player_name, c_acctbal from a left join b on {_NAME.format("nickname")} = {_NAME.format("player_name")}"""
_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SQL["correlation_long"] = " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) as corr from lineitem" for i, a in enumerate(_MEASURES) for b in _MEASURES[i:])
_LINES = "(select *, l_extendedprice / 200 py, l_quantity % 3 ic, l_quantity * 3 ry, l_linenumber % 2 rt, l_quantity % 5 rc, case when l_orderkey % 6 <> 0 then l_extendedprice / 500 end cy, l_linenumber % 3 fu from lineitem)"
SQL["fanduel_points"] = f"select l_orderkey, l_linenumber, count(*) n, round(sum(py * 0.04 + l_linenumber * 4 - ic + case when py >= 300 then 3 else 0 end + ry * 0.1 + rt * 6 + case when ry >= 100 then 3 else 0 end + rc * 0.5 + cy * 0.1 + 6 + case when cy >= 100 then 3 else 0 end - fu * 2), 7) points from {_LINES} group by 1, 2"
SQL["standard_points"] = f"select l_orderkey, l_linenumber, count(*) n, round(sum(py * 0.04 - ic * 2 + ry * 0.1 + coalesce(cy, 0) * 0.1 - fu * 2 + rc), 7) points from {_LINES} group by 1, 2"
SQL["positional_points"] = "select p_partkey, position, round(case position when 'QB' then p_size * 0.04 + p_partkey % 10 * 4 + p_retailprice * 0.1 when 'RB' then p_size * 0.1 + p_retailprice * 0.5 + p_partkey % 10 * 0.1 else p_size * 0.1 + p_partkey % 10 * 0.5 end, 4) points from (select *, case p_partkey % 4 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' else 'TE' end as position from part)"
SQL["stream_upsert"] = f"with e as (select event_id, user_id, ts, case when week < '2024-02-01'::timestamp then value + 1 else value end as value from {_EVENTS}) select event_id, value, lead(value) over (partition by user_id order by ts, event_id) next_week_value from e"

"""Shared oracle inputs, written as independent SQL over the same parquet tables."""

from __future__ import annotations

from contestry.sources.adapter import CHARTING_SQL, PBP_SQL, SCHEDULE_SQL

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def shared(name: str, deps: str, sql: str) -> None:
    CTES[name] = (tuple(deps.split()), sql)


def modern(col: str) -> str:
    return f"case {col} when 'SD' then 'LAC' when 'OAK' then 'LV' when 'STL' then 'LA' else {col} end"


shared("pbp", "", PBP_SQL.format(lineitem="lineitem"))
shared("schedule", "pbp", SCHEDULE_SQL.format(pbp="pbp"))
shared("charting", "pbp", CHARTING_SQL.format(pbp="pbp"))
_TEAMS = ("posteam", "defteam", "home_team", "away_team", "return_team",
          "fumble_recovery_1_team", "fumble_recovery_2_team", "td_team")
shared("plays", "pbp", "select * replace (" + ", ".join(f"{modern(c)} as {c}" for c in _TEAMS) + """)
  from pbp where play_type in ('pass','run') and epa is not null and posteam is not null
  and defteam is not null and two_point_attempt = 0 and season_type = 'REG'""")
shared("games", "schedule", "select *, cast(home_score - away_score as double) as margin, cast(home_score - away_score as double) as result from schedule")
shared("scores", "schedule", f"""select game_id, season, week, {modern('home_team')} as home, {modern('away_team')} as away,
  home_score, away_score from schedule where game_type = 'REG' and home_score is not null""")
shared("offense", "plays", """
  select season, week, game_id, posteam, defteam, count(*) as plays, avg(success) as success_rate,
    avg(case when down in (1, 2) then epa end) as early_down_epa,
    avg(epa) filter (where not (interception = 1 or fumble_lost = 1
      or (play_type = 'pass' and yards_gained > 20) or (play_type = 'run' and yards_gained > 12))) as non_explosive_epa,
    case when sum(third_down_converted) + sum(third_down_failed) > 0
      then cast(sum(third_down_converted) as double) / (sum(third_down_converted) + sum(third_down_failed)) end as third_down_rate
  from plays group by all""")
shared("own", "plays", """select game_id, posteam, sum(yards_gained) as yards, count(*) as n,
  sum(coalesce(success, 0)) as k, coalesce(stddev_samp(yards_gained), 0) as y_sd, avg(yards_gained) as y_mean from plays group by all""")
CREDIT = """case when interception = 1 then coalesce(return_yards, 0)
  when fumble_lost = 1 then case when coalesce(fumble_recovery_1_team = defteam, false) then coalesce(fumble_recovery_1_yards, 0)
     when coalesce(fumble_recovery_2_team = defteam, false) then coalesce(fumble_recovery_2_yards, 0) else 0 end else 0 end"""
shared("credit", "plays", f"""select game_id, defteam as posteam, count(*) as t, sum({CREDIT}) as r,
  count(*) filter (where epa < 0) as ts from plays where interception = 1 or fumble_lost = 1 group by all""")
_OFF = ("plays", "success_rate", "early_down_epa", "non_explosive_epa", "third_down_rate")
shared("sides", "offense scores", "select o.season, o.week, o.game_id, o.posteam, o.defteam, "
  + ", ".join(f"o.{c} as {c}_for" for c in _OFF) + ", " + ", ".join(f"d.{c} as {c}_against" for c in _OFF)
  + """, case when o.posteam = s.home then 1 else 0 end as home,
  cast(case when o.posteam = s.home then home_score else away_score end as double) as points_for,
  cast(case when o.posteam = s.home then away_score else home_score end as double) as points_against
  from offense o left join offense d on o.season = d.season and o.week = d.week and o.game_id = d.game_id
    and o.posteam = d.defteam and o.defteam = d.posteam
  join scores s on s.game_id = o.game_id""")
shared("frame", "sides own credit", """
  select f.*, a.yards as yards_for, b.yards as yards_against, a.y_sd,
    coalesce(c.t, 0) as fold_takeaways_for, coalesce(c.r, 0) as fold_return_yards_for,
    coalesce(c.t, 0) as srtake_takeaways_for, coalesce(c.ts, 0) as srtake_successes_for,
    a.n + coalesce(c.t, 0) as own_n_for, a.k + coalesce(c.ts, 0) as own_k_for,
    case when coalesce(c.t, 0) > 0 then cast(a.k + c.ts as double) / (a.n + c.t) else f.success_rate_for end as own_success_rate_for,
    (a.yards + coalesce(c.r, 0)) / a.n as own_ypp_for
  from sides f join own a on a.game_id = f.game_id and a.posteam = f.posteam
  left join own b on b.game_id = f.game_id and b.posteam = f.defteam
  left join credit c on c.game_id = f.game_id and c.posteam = f.posteam""")
WEIGHTS = "-16.82928858521862 + 35.126158542744385 * own_success_rate_for + 4.17779695298846 * own_ypp_for"
shared("deserved", "frame scores", f"""
  select s.*, h.p as home_deserved, a.p as away_deserved, h.p - a.p as deserved_margin,
    h.k as home_k, h.n as home_n, h.ypp as home_y_mean, h.y_sd as home_y_sd, h.plays as home_n_y, h.rate as home_success_rate, h.yards as home_yards,
    a.k as away_k, a.n as away_n, a.ypp as away_y_mean, a.y_sd as away_y_sd, a.plays as away_n_y, a.rate as away_success_rate, a.yards as away_yards
  from scores s
  join (select game_id, {WEIGHTS} as p, own_k_for as k, own_n_for as n, own_ypp_for as ypp, y_sd, plays_for as plays, own_success_rate_for as rate, yards_for as yards from frame where home = 1) h on h.game_id = s.game_id
  join (select game_id, {WEIGHTS} as p, own_k_for as k, own_n_for as n, own_ypp_for as ypp, y_sd, plays_for as plays, own_success_rate_for as rate, yards_for as yards from frame where home = 0) a on a.game_id = s.game_id""")


def phi(x: str) -> str:
    """Normal distribution function through the rational error function, as SQL text."""
    z = f"(abs({x}) / sqrt(2e0))"
    t = f"(1e0 / (1e0 + 0.3275911e0 * {z}))"
    poly = f"({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))))"
    return f"(0.5e0 * (1e0 + sign({x}) * (1e0 - {poly} * exp(-{z} * {z}))))"

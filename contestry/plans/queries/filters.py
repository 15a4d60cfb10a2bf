"""Predicates, projections and play-level tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions import plays as P
from contestry.functions.columns import era_code, floor_bin, flag, modern_code
from contestry.operators import kicks as K
from contestry.plans.catalogue import query
from contestry.plans.oracle_tables import CREDIT, modern, shared

PK = "game_id:s play_id:d"

FUMBLES = """select *, case when fumbled_1_team = posteam then epa else -epa end as epa_fumbler,
  fumble_out_of_bounds = 1 as out_of_bounds,
  case when fumble_recovery_1_team is not null then case when fumble_recovery_1_team = fumbled_1_team then 1 else 0 end
       when fumble_out_of_bounds = 1 then 1 end as retained,
  concat(coalesce(play_type, 'other'), '/', case when aborted_play = 1 then 'aborted' else 'live' end) as fumble_class
  from pbp where fumble = 1 and fumbled_1_team is not null"""
shared("fumbles", "pbp", f"select * from ({FUMBLES}) where retained is not null")
shared("live_fumbles", "fumbles", "select * from fumbles where fumble_recovery_1_team is not null")
shared("onside", "pbp", """select *, own_kickoff_recovery as recovered, defteam as kicking_team, -epa as epa_kicker,
  -score_differential as kicker_deficit, case when -score_differential < 0 and game_seconds_remaining <= 300 then 'expected' else 'surprise' end as onside_class
  from pbp where play_type = 'kickoff' and lower(desc_text) like '%kicks onside%' and defteam is not null""")
shared("muffs", "pbp", """select *, posteam as muffing_team, epa as epa_fumbler,
   case when disposition in ('touchback','recovered_by_receiving','self_recovers','out_of_bounds') then 1 else 0 end as retained from (
 select *, case when contains(tail, 'ouchback') then 'touchback' when team <> '' and team = posteam then 'recovered_by_receiving'
   when team <> '' then 'recovered_by_kicking' when contains(tail, 'and recovers') then 'self_recovers'
   when contains(tail, 'out of bounds') then 'out_of_bounds' else 'unresolved' end as disposition from (
 select *, regexp_extract(tail, 'RECOVERED by ([A-Z]{2,3})', 1) as team from (
 select *, case when contains(desc_text, 'MUFFS') then substr(desc_text, instr(desc_text, 'MUFFS')) else desc_text end as tail
  from pbp where play_type = 'kickoff' and not contains(desc_text, 'kicks onside')
  and (contains(desc_text, 'MUFFS') or own_kickoff_recovery = 1 or own_kickoff_recovery_td = 1))))""")
shared("blocked", "pbp", r"""select *, case when recovering_team is null or recovering_team = posteam then 1 else 0 end as retained,
   posteam as kicking_team, epa as epa_kicker from (
 select *, case when field_goal_result = 'blocked' then 'field_goal' when extra_point_result = 'blocked' then 'extra_point' else 'punt' end as kick_class,
   case when team <> '' then team when contains(tail, 'recovered the blocked kick') then defteam end as recovering_team,
   case when team <> '' and regexp_full_match(split_part(fell, '-', 2), '[0-9]+') and position('.' in whole) in (2, 3) then whole end as recoverer,
   case when regexp_full_match(split_part(hit, '-', 1), '[0-9]+') and position('.' in struck) in (2, 3) then struck end as blocker from (
 select *, case when length(split_part(fell, '-', 1)) in (2, 3) then split_part(fell, '-', 1) else '' end as team,
   regexp_replace(array_to_string(string_split(fell, '-')[3:], '-'), '[^A-Za-z.''-].*', '') as whole,
   regexp_replace(array_to_string(string_split(hit, '-')[2:], '-'), '[^A-Za-z.''-].*', '') as struck from (
 select *, regexp_extract(tail, '(?i)recovered by ([a-z]+-[^ ]*)', 1) as fell, ltrim(regexp_extract(desc_text, '(?i)blocked (?:by )?([^ ]+)', 1), '(') as hit from (
 select *, substr(desc_text, greatest(instr(lower(desc_text), 'blocked'), 1)) as tail from pbp
  where field_goal_result = 'blocked' or extra_point_result = 'blocked' or punt_blocked = 1))))""")
_CLEAN = """case when roof in ('dome','closed') then null else temp end as ctemp,
  case when roof in ('dome','closed') then null when wind is null then null else least(wind, 30e0) end as cwind"""
shared("kicks", "pbp", f"""select *, cwind is not null and ctemp is not null as has_weather, kick_distance as distance,
  concat(cast(season as varchar), '_', kicker_player_id) as kicker_season,
  case when is_xp = 1 then cast(extra_point_result = 'good' as int) else coalesce(cast(field_goal_result = 'made' as int), 0) end as made from (
 select *, {_CLEAN}, case when extra_point_attempt = 1 then 1 else 0 end as is_xp from pbp
 where kick_distance is not null and kicker_player_id is not null
   and (play_type = 'field_goal' or (extra_point_attempt = 1 and extra_point_result is not null)))""")
shared("punts", "pbp", f"""select *, cwind is not null and ctemp is not null as has_weather, yardline_100 as spot,
  case when touchback = 1 then yardline_100 - 20 else kick_distance - ry end as net,
  case when touchback = 1 then 'touchback' when punt_fair_catch = 1 then 'fair catch' when punt_downed = 1 then 'downed'
    when punt_out_of_bounds = 1 then 'out of bounds' when ry > 0 then 'returned' else 'other' end as outcome,
  concat(cast(season as varchar), '_', punter_player_id) as punter_season, concat(cast(season as varchar), '_', defteam) as return_unit_season
  from (select *, coalesce(return_yards, 0) as ry, {_CLEAN} from pbp where punt_attempt = 1 and punt_blocked <> 1 and kick_distance > 0
  and punter_player_id is not null and yardline_100 is not null)""")
shared("charted", "charting pbp", """select c.nflverse_game_id as game_id, cast(c.nflverse_play_id as double) as play_id, c.is_interception_worthy,
  c.is_catchable_ball, c.is_drop, c.n_pass_rushers, p.* exclude (game_id, play_id)
  from charting c join pbp p on p.game_id = c.nflverse_game_id and p.play_id = cast(c.nflverse_play_id as double)""")


@query("p01_play_filter", f"{PK} epa:d posteam:s", "select * from plays", "plays")
def p01(t):
    return t.plays


@query("p02_relocation_remap", "home_team:s n:i", f"select {modern('home_team')} as home_team, count(*) as n from schedule group by 1", "schedule")
def p02(t):
    return t.schedule.groupBy(modern_code("home_team").alias("home_team")).agg(F.count(F.lit(1)).alias("n"))


@query("p03_era_code", "season:i modern:s era:s n:i", f"""select season, m as modern, case when m = 'LV' and season <= 2019 then 'OAK'
   when m = 'LAC' and season <= 2016 then 'SD' when m = 'LA' and season <= 2015 then 'STL' else m end as era, count(*) as n
   from (select season, {modern('home_team')} as m from schedule) group by all""", "schedule")
def p03(t):
    games = t.schedule.select("season", modern_code("home_team").alias("modern"))
    return games.groupBy("season", "modern", era_code("modern").alias("era")).agg(F.count(F.lit(1)).alias("n"))


@query("p04_takeaway_mask", f"{PK} picked:i taken:i", "select game_id, play_id, coalesce(interception, 0) as picked, greatest(coalesce(interception, 0), coalesce(fumble_lost, 0)) as taken from plays", "plays")
def p04(t):
    return t.plays.withColumns({"picked": P.took_ball("int").cast("int"), "taken": P.took_ball("take").cast("int")})


@query("p05_credited_yards", f"{PK} credited:d", f"select game_id, play_id, {CREDIT} as credited from plays where interception = 1 or fumble_lost = 1", "plays")
def p05(t):
    return t.plays.filter(P.took_ball("take")).withColumn("credited", P.credited_yards())


@query("p06_touchdown_return", PK, "select * from plays where (interception = 1 or fumble_lost = 1) and touchdown = 1 and td_team = defteam", "plays")
def p06(t):
    return t.plays.filter(P.scored_on_return())


@query("p07_garbage_filter", f"{PK} wp:d", "select * from plays where wp >= 0.05 and wp <= 0.95", "plays")
def p07(t):
    return P.garbage(t.plays, "wp05_95")


@query("p08_scrimmage_with_down", f"{PK} down:i epa:d", "select * from pbp where posteam is not null and play_type in ('pass','run') and epa is not null and down is not null", "pbp")
def p08(t):
    return P.scrimmage_with_down(t.pbp)


@query("p09_valued_plays", "close_only:i n:i epa:d wpa:d", """select 0 as close_only, count(*) as n, sum(epa) as epa, sum(wpa) as wpa from pbp where posteam is not null and epa is not null and wpa is not null
   union all select 1, count(*), sum(epa), sum(wpa) from pbp where posteam is not null and epa is not null and wpa is not null and abs(score_differential) <= 8""", "pbp")
def p09(t):
    close = F.abs("score_differential") <= C.CLOSE_SCORE
    both = P.valued(t.pbp).withColumn("close_only", F.explode(
        F.when(close, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return both.groupBy("close_only").agg(F.count(F.lit(1)).alias("n"), F.sum("epa").alias("epa"), F.sum("wpa").alias("wpa"))


@query("p10_fumble_frame", f"{PK} fumbled_1_team:s retained:i fumble_class:s epa_fumbler:d out_of_bounds:i", "select * replace (cast(out_of_bounds as int) as out_of_bounds) from fumbles", "fumbles")
def p10(t):
    return P.fumble_frame(t.pbp).withColumn("out_of_bounds", F.col("out_of_bounds").cast("int"))


@query("p11_kick_attempts", "kind:s blocked_in:i n:i", """select 'field_goal' as kind, 1 as blocked_in, count(*) as n from pbp where play_type = 'field_goal' and kick_distance is not null
   union all select 'field_goal', 0, count(*) from pbp where play_type = 'field_goal' and kick_distance is not null and field_goal_result <> 'blocked'
   union all select 'extra_point', 1, count(*) from pbp where extra_point_attempt = 1 and extra_point_result is not null and kick_distance is not null
   union all select 'extra_point', 0, count(*) from pbp where extra_point_attempt = 1 and extra_point_result <> 'blocked' and kick_distance is not null""", "pbp")
def p11(t):
    specs = [(k, b, f(not b)) for k, f in (("field_goal", P.field_goal_attempt), ("extra_point", P.extra_point_attempt)) for b in (1, 0)]
    row = t.pbp.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, _, c) in enumerate(specs)])
    cells = [F.struct(F.lit(k).alias("kind"), F.lit(b).alias("blocked_in"), F.col(f"c{i}").alias("n")) for i, (k, b, _) in enumerate(specs)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


@query("p12_weather_sanitize", "roof:s n:i with_weather:i max_wind:d mean_temp:d", "select roof, count(*) as n, count_if(has_weather) as with_weather, max(cwind) as max_wind, avg(ctemp) as mean_temp from kicks group by roof", "kicks")
def p12(t):
    return K.kick_table(t.pbp).groupBy("roof").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_weather").alias("with_weather"),
                                                   F.max("wind").alias("max_wind"), F.avg("temp").alias("mean_temp"))


@query("p13_placement_cell", "cell:s n:i epa:d", """select case when yardline_100 <= 20 then 'red_zone' when down in (3,4) then 'late_down' else 'other' end as cell, count(*) as n, sum(epa) as epa
   from pbp where posteam is not null and play_type in ('pass','run') and epa is not null and down is not null group by 1""", "pbp")
def p13(t):
    return P.scrimmage_with_down(t.pbp).groupBy(P.placement_cell().alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("epa").alias("epa"))


CELL_SQL = """case when yardline_100 is null or down is null then null else concat(case when yardline_100 <= 33 then '1-33' when yardline_100 <= 66 then '34-66' else '67-99' end,
   '|', case when down <= 2 then '1-2' else '3-4' end) end"""


@query("p14_swing_cell", "cell:s n:i", f"select coalesce({CELL_SQL}, 'none') as cell, count(*) as n from pbp group by 1", "pbp")
def p14(t):
    return t.pbp.groupBy(F.coalesce(P.swing_cell(), F.lit("none")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("p15_fixed_width_bin", "bin:i n:i", "select cast(floor(yardline_100 / 5) * 5 as int) as bin, count(*) as n from pbp where yardline_100 is not null group by 1", "pbp")
def p15(t):
    return t.pbp.filter("yardline_100 is not null").groupBy(floor_bin("yardline_100", 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("p16_standardised_design", f"{PK} yardline_100_z:d air_epa_z:d air_epa_z_squared:d down_2:d down_3:d down_4:d",
       """select game_id, play_id, (yardline_100 - my) / sy as yardline_100_z, (air_epa - ma) / sa as air_epa_z, power((air_epa - ma) / sa, 2) as air_epa_z_squared,
          cast(down = 2 as int) as down_2, cast(down = 3 as int) as down_3, cast(down = 4 as int) as down_4
          from (select * from charted where is_interception_worthy), (select avg(yardline_100) my, stddev_samp(yardline_100) sy, avg(air_epa) ma, stddev_samp(air_epa) sa from charted)""", "charted")
def p16(t):
    charted = charted_passes(t)
    return K.standardised_design(charted.filter("is_interception_worthy"), charted, ["yardline_100", "air_epa"],
                                 ["air_epa"], [("down", (2, 3, 4))])


def charted_passes(t):
    """Charting rows joined to their plays, the integer key cast to the play key's type."""
    keys = t.charting.select(
        F.col("nflverse_game_id").alias("game_id"), F.col("nflverse_play_id").cast("double").alias("play_id"),
        "is_interception_worthy", "is_catchable_ball", "is_drop", "n_pass_rushers")
    return keys.join(t.pbp, ["game_id", "play_id"])


@query("p17_kick_design", f"{PK} d1:d d2:d d3:d roof_dome:d roof_closed:d roof_open:d wind_term:d temp_term:d elev_term:d",
       """select game_id, play_id, distance - 35 as d1, power(distance - 35, 2) / 100 as d2, power(distance - 35, 3) / 1000 as d3,
          cast(roof = 'dome' as int) as roof_dome, cast(roof = 'closed' as int) as roof_closed, cast(roof = 'open' as int) as roof_open,
          case when has_weather then cwind - w else 0 end as wind_term, case when has_weather then ctemp - m else 0 end as temp_term, elev - e as elev_term
          from (select *, (cast(substr(stadium_id, 2) as int) * cast(substr(stadium_id, 2) as int) % 53) / 10.0 as elev from kicks),
          (select avg(cwind) filter (where has_weather) as w, avg(ctemp) filter (where has_weather) as m,
             avg((cast(substr(stadium_id, 2) as int) * cast(substr(stadium_id, 2) as int) % 53) / 10.0) as e from kicks)""", "kicks")
def p17(t):
    kicks = K.with_elevation(K.kick_table(t.pbp), t.spark.sql(K.ELEVATION_SQL))
    return K.kick_design(kicks, elevation=True)


@query("p18_onside_frame", f"{PK} kicking_team:s onside_class:s recovered:i epa_kicker:d kicker_deficit:d", "select * from onside", "onside")
def p18(t):
    return P.onside_frame(t.pbp)


@query("p19_muff_dispositions", f"{PK} disposition:s retained:i muffing_team:s epa_fumbler:d", "select * from muffs", "muffs")
def p19(t):
    return P.muff_frame(t.pbp)


@query("p20_blocked_frame", f"{PK} kick_class:s recovering_team:s recoverer:s blocker:s retained:i", "select * from blocked", "blocked")
def p20(t):
    return P.blocked_frame(t.pbp)


@query("p21_deflected_flag", f"{PK} deflected:i", "select game_id, play_id, cast(pass_defense_1_player_id <> interception_player_id as int) as deflected from pbp where interception = 1", "pbp")
def p21(t):
    return P.deflected_picks(t.pbp).withColumn("deflected", F.col("deflected").cast("int"))


@query("p22_punt_table", f"{PK} net:d spot:d punter_season:s return_unit_season:s has_weather:i", "select * replace (cast(has_weather as int) as has_weather) from punts", "punts")
def p22(t):
    return P.punt_table(t.pbp).withColumn("has_weather", F.col("has_weather").cast("int"))


@query("p23_punt_outcome", "outcome:s punts:i mean_net:d", "select outcome, count(*) as punts, avg(net) as mean_net from punts group by 1", "punts")
def p23(t):
    return P.punt_table(t.pbp).groupBy(P.punt_outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("punts"), F.avg("net").alias("mean_net"))


@query("p24_return_table", f"kind:s era:s {PK} returner:s yards:d", """select 'kickoff' as kind, case when season >= 2024 then 'new' else 'old' end as era, game_id, play_id, kickoff_returner_player_id as returner, return_yards as yards
    from pbp where kickoff_attempt = 1 and kickoff_returner_player_id is not null and return_yards is not null
   union all select 'punt', case when season >= 2024 then 'new' else 'old' end, game_id, play_id, punt_returner_player_id, return_yards
    from pbp where punt_attempt = 1 and punt_returner_player_id is not null and return_yards is not null""", "pbp")
def p24(t):
    era = F.when(F.col("season") >= 2024, "new").otherwise("old")
    cols = ["game_id", "play_id", "season", "returner", "yards"]
    parts = [P.return_table(t.pbp, k).select(F.lit(k).alias("kind"), era.alias("era"), *cols) for k in ("kickoff", "punt")]
    return parts[0].unionByName(parts[1])


@query("p25_audit_screens", "screen:s population:i flagged:i",
       """select 'kick blocked' as screen, count(*) as population, count_if(field_goal_result = 'blocked') as flagged from pbp where play_type = 'field_goal' and kick_distance is not null
          union all select 'kick penalty', count(*), count_if(penalty = 1) from pbp where play_type = 'field_goal' and kick_distance is not null
          union all select 'fumble without value', count(*), count_if(epa is null) from pbp where fumble = 1 and fumbled_1_team is not null
          union all select 'fumble unresolved', count(*), count_if(fumble_recovery_1_team is null and fumble_out_of_bounds = 0) from pbp where fumble = 1 and fumbled_1_team is not null
          union all select 'pick without return', count(*), count_if(return_yards is null) from pbp where interception = 1
          union all select 'try negated', count(*), count_if(penalty = 1) from pbp where extra_point_attempt = 1 and extra_point_result is not null and kick_distance is not null""", "pbp")
def p25(t):
    fg, xp, fum = P.field_goal_attempt(), P.extra_point_attempt(), P.any_fumble()
    return K.screens(t.pbp, [
        ("kick blocked", fg, F.col("field_goal_result") == "blocked"),
        ("kick penalty", fg, flag("penalty")),
        ("fumble without value", fum, F.col("epa").isNull()),
        ("fumble unresolved", fum, F.col("fumble_recovery_1_team").isNull() & ~flag("fumble_out_of_bounds")),
        ("pick without return", flag("interception"), F.col("return_yards").isNull()),
        ("try negated", xp, flag("penalty")),
    ])


@query("p25_flagged_rows", f"{PK} desc_text:s", """select game_id, play_id, desc_text from pbp where play_type = 'field_goal' and kick_distance is not null and field_goal_result = 'blocked'
   order by game_id, play_id limit 50""", "pbp")
def p25_rows(t):
    return K.flagged_sample(t.pbp, P.field_goal_attempt(), F.col("field_goal_result") == "blocked").withColumn("desc_text", F.col("desc"))


@query("p26_column_scan", "column_name:s non_null:i", """select column_name, non_null from (select count(fumble) as fumble, count(fumble_lost) as fumble_lost, count(fumbled_1_team) as fumbled_1_team,
    count(fumble_recovery_1_team) as fumble_recovery_1_team, count(fumble_recovery_1_yards) as fumble_recovery_1_yards, count(fumble_recovery_2_team) as fumble_recovery_2_team,
    count(fumble_recovery_2_yards) as fumble_recovery_2_yards, count(fumble_out_of_bounds) as fumble_out_of_bounds from pbp)
    unpivot (non_null for column_name in (fumble, fumble_lost, fumbled_1_team, fumble_recovery_1_team, fumble_recovery_1_yards, fumble_recovery_2_team, fumble_recovery_2_yards, fumble_out_of_bounds))""", "pbp")
def p26(t):
    names = K.columns_like(t.pbp, ["fumble"])
    row = t.pbp.agg(*[F.count(c).alias(c) for c in names])
    return row.unpivot([], names, "column_name", "non_null")


@query("p27_complete_cases", "rows:i kept:i dropped:i", """select count(*) as rows, count_if(yardline_100 is not null and down is not null and passer_player_id is not null and air_epa is not null) as kept,
   count_if(not (yardline_100 is not null and down is not null and passer_player_id is not null and air_epa is not null)) as dropped from charted""", "charted")
def p27(t):
    return K.complete_cases(charted_passes(t), ["yardline_100", "down", "passer_player_id", "air_epa"])[1]

"""Feature tables: seasons, drives, punts, returns, kicks, overtime, placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions import plays as P
from contestry.functions.columns import count_where, flag, floor_bin, guarded, keyed, logistic, mean_where, ratio
from contestry.operators import drives as DR
from contestry.operators import joins as J
from contestry.operators import kicks as K
from contestry.operators import ledger as L
from contestry.operators import placement as PL
from contestry.operators import stats as ST
from contestry.operators.ranking import quantile_row
from contestry.plans.catalogue import query
from contestry.plans.oracle_tables import shared
from contestry.plans.queries.filters import charted_passes



@query("f01_season_audit", "season:i plays:i games:i epa_nulls:i fumbles:i interceptions:i fg_attempts:i penalties:i", """select season, count(*) as plays, count(distinct game_id) as games, count_if(epa is null) as epa_nulls, count_if(fumble = 1) as fumbles,
   count_if(interception = 1) as interceptions, count_if(play_type = 'field_goal') as fg_attempts, count_if(penalty = 1) as penalties from pbp group by season""", "pbp")
def f01(t):
    per_game = t.pbp.groupBy("season", "game_id").agg(
        F.count(F.lit(1)).alias("plays"), F.count_if(F.col("epa").isNull()).alias("epa_nulls"), count_where(flag("fumble")).alias("fumbles"),
        count_where(flag("interception")).alias("interceptions"), count_where(F.col("play_type") == "field_goal").alias("fg_attempts"),
        count_where(flag("penalty")).alias("penalties"))
    cols = ("plays", "epa_nulls", "fumbles", "interceptions", "fg_attempts", "penalties")
    return per_game.groupBy("season").agg(F.count(F.lit(1)).alias("games"), *[F.sum(c).alias(c) for c in cols])


shared("components", "pbp games strict", """select g.game_id, g.season, g.home_team, g.away_team, g.margin, e.epa_diff, e.picks, e.pens, coalesce(l.fum, 0) as fumble_luck, coalesce(l.fg, 0) as fg_luck,
   e.epa_diff - e.picks - e.pens - coalesce(l.fum, 0) - coalesce(l.fg, 0) as core from games g
   join (select game_id, sum(case when posteam = home_team then epa else -epa end) as epa_diff, coalesce(sum(case when posteam = home_team then epa else -epa end) filter (where interception = 1), 0) as picks,
     coalesce(sum(case when posteam = home_team then epa else -epa end) filter (where penalty = 1 and interception = 0), 0) as pens from pbp where posteam is not null and epa is not null group by game_id) e on e.game_id = g.game_id
   left join (select game_id, sum(case when component = 'fumble' then luck_epa else 0 end) as fum, sum(case when component = 'field_goal' then luck_epa else 0 end) as fg from strict group by game_id) l on l.game_id = g.game_id
   where g.margin is not null""")


def components(t):
    """Home-signed value per contest split into parts; ``core`` is the remainder, so they sum exactly."""
    signed = F.when(F.col("posteam") == F.col("home_team"), F.col("epa")).otherwise(-F.col("epa"))
    pick, pen = flag("interception"), flag("penalty")
    per = t.pbp.filter("posteam is not null and epa is not null").withColumn("v", signed).groupBy("game_id").agg(
        F.sum("v").alias("epa_diff"), F.coalesce(F.sum(F.when(pick, F.col("v"))), F.lit(0.0)).alias("picks"),
        F.coalesce(F.sum(F.when(pen & ~pick, F.col("v"))), F.lit(0.0)).alias("pens"))
    part = lambda c: F.sum(F.when(F.col("component") == c, F.col("luck_epa")).otherwise(0.0))
    luck = t.strict.groupBy("game_id").agg(part("fumble").alias("fumble_luck"), part("field_goal").alias("fg_luck"))
    out = t.games.filter("margin is not null").join(per, "game_id").join(luck, "game_id", "left").fillna(0.0, ["fumble_luck", "fg_luck"])
    return out.withColumn("core", F.col("epa_diff") - F.col("picks") - F.col("pens") - F.col("fumble_luck") - F.col("fg_luck"))


_LEAD = "select *, cast((epa_diff > 0) = (margin > 0) as int) as lead_won from components where margin <> 0"


@query("f02_leader_wins", "grouping:s key:s n:i win_rate:d", f"""select 'overall' as "grouping", 'all' as "key", count(*) as n, avg(lead_won) as win_rate from ({_LEAD})
   union all select 'venue', case when epa_diff > 0 then 'home team led' else 'away team led' end, count(*), avg(lead_won) from ({_LEAD}) group by 2
   union all select 'season', cast(season as varchar), count(*), avg(lead_won) from ({_LEAD}) group by 2
   union all select 'home', 'all', count(*), avg(cast(margin > 0 as int)) from ({_LEAD})""", "components")
def f02(t):
    """All four cuts from one pass: each contest is tagged with the groups it belongs to.

    Compared after rounding: the values of a level contest add up to nothing, whatever the order of the sum leaves.
    """
    d = components(t).filter("margin <> 0").withColumn("epa_diff", F.round("epa_diff", 9))
    won = ((F.col("epa_diff") > 0) == (F.col("margin") > 0)).cast("double")
    tag = lambda g, k, w: F.struct(F.lit(g).alias("grouping"), k.alias("key"), w.alias("won"))
    tags = F.array(tag("overall", F.lit("all"), won), tag("venue", F.when(F.col("epa_diff") > 0, "home team led").otherwise("away team led"), won),
                   tag("season", F.col("season").cast("string"), won), tag("home", F.lit("all"), (F.col("margin") > 0).cast("double")))
    return d.select(F.explode(tags).alias("x")).groupBy("x.grouping", "x.key").agg(F.count(F.lit(1)).alias("n"), F.avg("x.won").alias("win_rate"))


@query("f03_component_table", "game_id:s epa_diff:d core:d picks:d pens:d fumble_luck:d fg_luck:d margin:d", "select * from components", "components")
def f03(t):
    return components(t)


_PARTS = ("core", "picks", "pens", "fumble_luck", "fg_luck")


@query("f04_covariance_shares", "component:s share:d sd:d r:d", " union all ".join(
    f"select '{c}' as component, covar_samp({c}, epa_diff) / var_samp(epa_diff) as share, stddev_samp({c}) as sd, corr({c}, epa_diff) as r from components" for c in _PARTS), "components")
def f04(t):
    return ST.covariance_shares(components(t), "epa_diff", list(_PARTS))


shared("scrim", "pbp", "select * from pbp where posteam is not null and play_type in ('pass','run') and epa is not null and down is not null")
shared("valued", "pbp", "select * from pbp where posteam is not null and epa is not null and wpa is not null")
shared("sequencing", "scrim valued", """select s.*, n_valued, epa_valued, wpa_valued, concat(cast(s.season as varchar), '_', s.posteam) as team_season from (
   select season, posteam, game_id, count(*) as n_all, sum(epa) as epa_all, sum(success) as succ_all, count_if(yardline_100 <= 20) as n_rz, coalesce(sum(epa) filter (where yardline_100 <= 20), 0) as epa_rz,
     count_if(down in (3,4)) as n_ld, coalesce(sum(success) filter (where down in (3,4)), 0) as succ_ld from scrim group by all) s
   join (select season, posteam, game_id, count(*) as n_valued, sum(epa) as epa_valued, sum(wpa) as wpa_valued from valued group by all) v on v.season = s.season and v.posteam = s.posteam and v.game_id = s.game_id""")


def sequencing(t):
    """Both populations' sums per side-contest in one aggregate; sides missing either one drop."""
    snap = P.is_scrimmage() & F.col("down").isNotNull()
    val = F.col("wpa").isNotNull()
    rz, ld = F.col("yardline_100") <= C.RED_ZONE_YARDS, F.col("down").isin(*C.LATE_DOWNS)
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0))
    snap = F.coalesce(snap, F.lit(False))
    out = t.pbp.filter("posteam is not null and epa is not null").groupBy("season", "posteam", "game_id").agg(
        F.count_if(snap).alias("n_all"), total("epa", snap).alias("epa_all"), total("success", snap).alias("succ_all"),
        count_where(snap & rz).alias("n_rz"), total("epa", snap & rz).alias("epa_rz"), count_where(snap & ld).alias("n_ld"),
        total("success", snap & ld).alias("succ_ld"), F.count_if(val).alias("n_valued"), total("epa", val).alias("epa_valued"), total("wpa", val).alias("wpa_valued"))
    return out.filter("n_all > 0 and n_valued > 0").withColumn("team_season", keyed("season", "posteam"))


@query("f17_sequencing_sums", "season:i posteam:s game_id:s n_all:i epa_all:d succ_all:d n_rz:i epa_rz:d n_ld:i succ_ld:d n_valued:i epa_valued:d wpa_valued:d", "select * from sequencing", "sequencing")
def f17(t):
    return sequencing(t)


@query("f17_design_constants", "slope:d r:d mean_epa:d mean_rz:d mean_rest:d var_epa:d var_rz:d p_all:d p_late:d p_early:d n_scrimmage:i", """select (select covar_samp(epa, wpa) / var_samp(epa) from valued) as slope, (select corr(epa, wpa) from valued) as r, avg(epa) as mean_epa,
   avg(epa) filter (where yardline_100 <= 20) as mean_rz, avg(epa) filter (where yardline_100 > 20) as mean_rest, var_samp(epa) as var_epa, var_samp(epa) filter (where yardline_100 <= 20) as var_rz, avg(success) as p_all,
   avg(success) filter (where down in (3,4)) as p_late, avg(success) filter (where down not in (3,4)) as p_early, count(*) as n_scrimmage from scrim""", "scrim valued")
def f17_design(t):
    snap = F.coalesce(P.is_scrimmage() & F.col("down").isNotNull(), F.lit(False))
    rz, ld = F.col("yardline_100") <= C.RED_ZONE_YARDS, F.col("down").isin(*C.LATE_DOWNS)
    e, w = F.when(F.col("wpa").isNotNull(), F.col("epa")), F.col("wpa")
    return t.pbp.filter("posteam is not null and epa is not null").agg(
        ratio(F.covar_samp(e, w), F.var_samp(e)).alias("slope"), F.corr(e, w).alias("r"), mean_where("epa", snap).alias("mean_epa"),
        mean_where("epa", snap & rz).alias("mean_rz"), mean_where("epa", snap & ~rz).alias("mean_rest"), F.var_samp(F.when(snap, F.col("epa"))).alias("var_epa"),
        F.var_samp(F.when(snap & rz, F.col("epa"))).alias("var_rz"), mean_where("success", snap).alias("p_all"), mean_where("success", snap & ld).alias("p_late"),
        mean_where("success", snap & ~ld).alias("p_early"), F.count_if(snap).alias("n_scrimmage"))


def epa_slope(t):
    return P.valued(t.pbp).agg(ratio(F.covar_samp("epa", "wpa"), F.var_samp("epa"))).scalar()


@query("f18_sequencing_measures", "team_season:s games:i s0:d s1:d s2:d s3:d", """select team_season, count(*) as games, sum(epa_all) / sum(n_all) as s0, sum(epa_rz) / sum(n_rz) - sum(epa_all) / sum(n_all) as s1, sum(succ_ld) / sum(n_ld) - sum(succ_all) / sum(n_all) as s2,
   (sum(wpa_valued) - (select covar_samp(epa, wpa) / var_samp(epa) from valued) * sum(epa_valued)) / count(*) as s3 from sequencing group by team_season""", "sequencing valued")
def f18(t):
    sums = sequencing(t).groupBy("team_season").agg(F.count(F.lit(1)).alias("games"), *[F.sum(c).alias(c) for c in (
        "n_all", "epa_all", "succ_all", "n_rz", "epa_rz", "n_ld", "succ_ld", "epa_valued", "wpa_valued")])
    s0 = ratio("epa_all", "n_all")
    return sums.withColumns({"s0": s0, "s1": ratio("epa_rz", "n_rz") - s0, "s2": ratio("succ_ld", "n_ld") - ratio("succ_all", "n_all"),
                             "s3": ratio(F.col("wpa_valued") - epa_slope(t) * F.col("epa_valued"), "games")})


shared("drives", "pbp", """select a.*, c.result, c.home_team, c.season, c.week, coalesce(aid, 0) as penalty_aid_yards,
   cast(case when result = 'Touchdown' then 6 + xp + 2 * two when result = 'Field goal' then 3 else 0 end as double) as points, cast(posteam = home_team as int) as is_home,
   cast(floor(depth / 5) * 5 as int) as depth_bin, coalesce(cast(result in ('Touchdown','Field goal','Punt','Turnover','Turnover on downs','Missed field goal') as int), 0) as resampled, concat(cast(season as varchar), '_', posteam) as team_season
   from (select game_id, fixed_drive, arg_min(posteam, play_id) as posteam, arg_min(yardline_100, play_id) as start_yardline_100, min(yardline_100) as depth, count(*) as scrimmage_plays, sum(yards_gained) as net_yards, max(yards_gained) as max_gain,
     count_if((play_type = 'run' and yards_gained >= 12) or (play_type = 'pass' and yards_gained >= 16)) as explosive_plays, sum(coalesce(first_down, 0)) as first_downs, max(cast(yardline_100 <= 20 as int)) as reached_red_zone
     from pbp where posteam is not null and fixed_drive is not null and play_type in ('pass','run') and yardline_100 is not null group by all) a
   join (select game_id, fixed_drive, arg_min(fixed_drive_result, play_id) filter (where fixed_drive_result is not null) as result, max(coalesce(cast(extra_point_result = 'good' as int), 0)) as xp,
     max(coalesce(cast(two_point_conv_result = 'success' as int), 0)) as two, max(home_team) as home_team, max(season) as season, max(week) as week from pbp where fixed_drive is not null group by all) c on c.game_id = a.game_id and c.fixed_drive = a.fixed_drive
   left join (select game_id, fixed_drive, sum(case when penalty_team = defteam then penalty_yards else 0 end) as aid from pbp where fixed_drive is not null and penalty = 1 group by all) p on p.game_id = a.game_id and p.fixed_drive = a.fixed_drive""")


@query("f19_drive_table", "game_id:s fixed_drive:d posteam:s depth:d scrimmage_plays:i result:s points:d is_home:i depth_bin:i resampled:i", "select * from drives", "drives")
def f19(t):
    return t.drives


@query("f20_drive_summary_rows", "game_id:s fixed_drive:d team_season:s start_yardline_100:d net_yards:d max_gain:d explosive_plays:i first_downs:i reached_red_zone:i penalty_aid_yards:d", "select * from drives", "drives")
def f20(t):
    return t.drives


@query("f21_drive_results", "result:s n:i share:d", "select result, count(*) as n, cast(count(*) as double) / sum(count(*)) over () as share from drives group by result", "drives")
def f21(t):
    per = t.drives.groupBy("result").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", ratio("n", per.agg(F.sum("n")).scalar()))


@query("f21_feature_summary", "feature:s mean:d median:d", " union all ".join(f"select '{c}' as feature, avg({c}) as mean, median({c}) as median from drives" for c in DR.FEATURES), "drives")
def f21_features(t):
    d = t.drives
    means = d.agg(*[F.avg(c).alias(c) for c in DR.FEATURES]).unpivot([], list(DR.FEATURES), "feature", "mean")
    med = quantile_row(d, {c: (c, 0.5) for c in DR.FEATURES}).unpivot([], list(DR.FEATURES), "feature", "median")
    return means.join(med, "feature")


@query("f21_entanglement", "touchdowns:i share_close:d r_net:d r_depth:d", """select count_if(result = 'Touchdown') as touchdowns, avg(cast(abs(net_yards - start_yardline_100) <= 5 as int)) filter (where result = 'Touchdown') as share_close,
   corr(net_yards, points) as r_net, corr(depth, points) as r_depth from drives""", "drives")
def f21_tangle(t):
    td = F.col("result") == "Touchdown"
    return t.drives.agg(count_where(td).alias("touchdowns"), F.avg(F.when(td, (F.abs(F.col("net_yards") - F.col("start_yardline_100")) <= 5).cast("double"))).alias("share_close"),
                        F.corr("net_yards", "points").alias("r_net"), F.corr("depth", "points").alias("r_depth"))


shared("donors", "drives", """with b as (select depth_bin, count(*) as n, avg(points) as mean_points from drives where resampled = 1 group by 1)
   select b.*, (select arg_min(o.depth_bin, abs(o.depth_bin - b.depth_bin) * 1000 + o.depth_bin) from b o where o.n >= 400) as donor_bin from b""")


@query("f22_conditional_points", "depth_bin:i n:i mean_points:d donor_bin:i", "select * from donors", "donors")
def f22(t):
    return DR.conditional_points(t.drives, minimum=400)


@query("f23_spread_retention", "sd_observed:d sd_modelled:d retention:d quality_residual_r:d", """select stddev_samp(o) as sd_observed, stddev_samp(m) as sd_modelled, stddev_samp(m) / stddev_samp(o) as retention, corr(o, o - m) as quality_residual_r
   from (select team_season, avg(points) as o, avg(mean_points) as m from drives d join donors x on x.depth_bin = d.depth_bin where resampled = 1 group by 1)""", "drives donors")
def f23(t):
    rows = t.drives.filter("resampled = 1").join(DR.conditional_points(t.drives, 400), "depth_bin")
    return DR.spread_retention(rows, "mean_points")


@query("f23_retention_per_game", "sd_observed:d sd_adjusted:d retention:d", """select stddev_samp(o) as sd_observed, stddev_samp(m) as sd_adjusted, stddev_samp(m) / stddev_samp(o) as retention
   from (select team_season, sum(points) / count(distinct game_id) as o, sum(mean_points) / count(distinct game_id) as m from drives d join donors x on x.depth_bin = d.depth_bin where resampled = 1 group by 1)""", "drives donors")
def f23_game(t):
    rows = t.drives.filter("resampled = 1").join(DR.conditional_points(t.drives, 400), "depth_bin")
    return DR.retention_per_game(rows, "mean_points")


shared("passers", "pbp", """select season, posteam, game_id, passer from (select season, posteam, game_id, passer_player_id as passer, row_number() over (partition by season, posteam, game_id order by count(*) desc, passer_player_id) as rn
   from pbp where passer_player_id is not null and posteam is not null group by season, posteam, game_id, passer_player_id) where rn = 1""")


def primary_passer(t):
    """Most attempts, then the smaller id: a maximum over per-passer counts, no window."""
    per = t.pbp.filter("passer_player_id is not null and posteam is not null").groupBy("season", "posteam", "game_id", "passer_player_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("season", "posteam", "game_id").agg(F.min_by("passer_player_id", F.struct(-F.col("n"), "passer_player_id")).alias("passer"))


@query("f24_primary_passer", "season:i posteam:s game_id:s passer:s", "select * from passers", "passers")
def f24(t):
    return primary_passer(t)


_S3 = """select v.season, v.posteam, v.game_id, plays, passer, coach, wpa_sum - (select covar_samp(epa, wpa) / var_samp(epa) from close_) * epa_sum as s3 from (select season, posteam, game_id, count(*) as plays, sum(epa) as epa_sum, sum(wpa) as wpa_sum from close_ group by all) v
   join passers p on p.season = v.season and p.posteam = v.posteam and p.game_id = v.game_id
   join (select game_id, home_team as posteam, home_coach as coach from schedule union all select game_id, away_team, away_coach from schedule) c on c.game_id = v.game_id and c.posteam = v.posteam"""


@query("f25_leverage_gap", "season:i posteam:s game_id:s plays:i passer:s coach:s s3:d", f"with close_ as (select * from valued where abs(score_differential) <= 8) {_S3}", "valued passers schedule")
def f25(t):
    close = P.valued(t.pbp, close_only=True)
    slope = close.agg(ratio(F.covar_samp("epa", "wpa"), F.var_samp("epa"))).scalar()
    per = close.groupBy("season", "posteam", "game_id").agg(F.count(F.lit(1)).alias("plays"), F.sum("epa").alias("e"), F.sum("wpa").alias("w"))
    coaches = J.unpivot_sides(t.schedule, "home_team", "away_team", "home_coach", "away_coach", "posteam", "coach")
    return per.join(primary_passer(t), ["season", "posteam", "game_id"]).join(coaches, ["game_id", "posteam"]).withColumn("s3", F.col("w") - slope * F.col("e"))


@query("f26_team_closeness", "team_season:s closeness:d", "select concat(cast(season as varchar), '_', posteam) as team_season, avg(abs(score_differential)) as closeness from pbp where posteam is not null group by 1", "pbp")
def f26(t):
    return t.pbp.filter("posteam is not null").groupBy(keyed("season", "posteam").alias("team_season")).agg(F.avg(F.abs("score_differential")).alias("closeness"))


def _nk(name, rows, key, success, where):
    return f"select '{name}' as candidate, season, {key} as entity, count(*) as n, count_if({success}) as k from {rows} where {where} and {key} is not null group by season, {key}"


@query("f27_candidate_counts", "candidate:s season:i entity:s n:i k:i", " union all ".join([
    _nk("drops_team", "charted", "posteam", "is_drop", "is_catchable_ball"), f"select * from ({_nk('drops_receiver', 'charted', 'receiver_player_id', 'is_drop', 'is_catchable_ball')}) where n >= 5",
    _nk("fourth_down", "pbp", "posteam", "fourth_down_converted = 1", "(fourth_down_converted = 1 or fourth_down_failed = 1)"),
    _nk("two_point", "pbp", "posteam", "two_point_conv_result = 'success'", "two_point_attempt = 1 and two_point_conv_result is not null"),
    _nk("onside_recovery", "pbp", "posteam", "own_kickoff_recovery = 1", "kickoff_attempt = 1 and lower(desc_text) like '%onside%'"),
    _nk("extra_point_kicker", "pbp", "kicker_player_id", "extra_point_result = 'good'", "extra_point_attempt = 1 and extra_point_result is not null")]), "charted pbp")
def f27(t):
    catch = charted_passes(t).filter("is_catchable_ball")
    pbp = t.pbp
    specs = [
        ("drops_team", catch, "posteam", F.col("is_drop"), 0), ("drops_receiver", catch, "receiver_player_id", F.col("is_drop"), 5),
        ("fourth_down", pbp.filter(flag("fourth_down_converted") | flag("fourth_down_failed")), "posteam", flag("fourth_down_converted"), 0),
        ("two_point", pbp.filter(flag("two_point_attempt") & F.col("two_point_conv_result").isNotNull()), "posteam", F.col("two_point_conv_result") == "success", 0),
        ("onside_recovery", pbp.filter(flag("kickoff_attempt") & F.lower("desc").contains("onside")), "posteam", flag("own_kickoff_recovery"), 0),
        ("extra_point_kicker", pbp.filter(flag("extra_point_attempt") & F.col("extra_point_result").isNotNull()), "kicker_player_id", F.col("extra_point_result") == "good", 0)]
    return J.union_strict([ST.counts(rows, ["season", key], ok).filter(F.col("n") >= low).select(F.lit(name).alias("candidate"), "season", F.col(key).alias("entity"), "n", "k")
                           for name, rows, key, ok, low in specs])


@query("f28_fumble_retention", "season:i team:s game_id:s fumbles:i kept:i", "select season, fumbled_1_team as team, game_id, count(*) as fumbles, count_if(fumble_recovery_1_team = fumbled_1_team) as kept from pbp where fumble = 1 and fumbled_1_team is not null and fumble_recovery_1_team is not null group by all", "pbp")
def f28(t):
    return t.pbp.filter(P.live_fumble()).groupBy("season", F.col("fumbled_1_team").alias("team"), "game_id").agg(
        F.count(F.lit(1)).alias("fumbles"), F.count_if(F.col("fumble_recovery_1_team") == F.col("fumbled_1_team")).alias("kept"))


@query("f29_penalty_subtypes", "team_season:s n:i k:i", """select o.team_season, n, coalesce(k, 0) as k from (select team_season, count(*) as n from (select concat(cast(season as varchar), '_', posteam) as team_season from pbp where posteam is not null and defteam is not null
   union all select concat(cast(season as varchar), '_', defteam) from pbp where posteam is not null and defteam is not null) group by 1) o
   left join (select concat(cast(season as varchar), '_', penalty_team) as team_season, count(*) as k from pbp where penalty = 1 and penalty_type = 'Offensive Holding' group by 1) f on f.team_season = o.team_season""", "pbp")
def f29(t):
    """Both exposures and the flags come from one scan: each play is counted for its sides."""
    held = flag("penalty") & (F.col("penalty_type") == "Offensive Holding") & F.col("penalty_team").isNotNull()
    side = lambda who, n, k: F.struct(keyed(F.col("season"), F.col(who)).alias("team_season"), F.lit(n).alias("n"), F.lit(k).alias("k"))
    both = F.col("posteam").isNotNull() & F.col("defteam").isNotNull()
    parts = F.concat(F.when(both, F.array(side("posteam", 1, 0), side("defteam", 1, 0))).otherwise(F.array()),
                     F.when(held, F.array(side("penalty_team", 0, 1))).otherwise(F.array()))
    out = t.pbp.select(F.explode(parts).alias("x")).groupBy("x.team_season").agg(F.sum("x.n").alias("n"), F.sum("x.k").alias("k"))
    return out.filter("n > 0")


shared("overtime", "pbp games", """select o.game_id, first_pos, g.season, o.season_type, g.home_team, g.away_team, g.result, cast(first_pos = g.home_team as int) as home_received, case when first_pos = g.home_team then result else -result end as fp_margin
   from (select game_id, arg_min(posteam, play_id) filter (where posteam is not null) as first_pos, max(season_type) as season_type from pbp where qtr = 5 group by 1) o join games g on g.game_id = o.game_id where result is not null""")


def overtime(t):
    first = t.pbp.filter("qtr = 5").groupBy("game_id").agg(
        F.min(F.when(F.col("posteam").isNotNull(), F.struct("play_id", "posteam")))["posteam"].alias("first_pos"), F.max("season_type").alias("season_type"))
    home = F.col("first_pos") == F.col("home_team")
    return first.join(t.results.filter("result is not null"), "game_id").withColumns({
        "home_received": home.cast("int"), "fp_margin": F.when(home, F.col("result")).otherwise(-F.col("result"))})


@query("f34_overtime_frame", "game_id:s first_pos:s home_received:i fp_margin:d season_type:s", "select * from overtime", "overtime")
def f34(t):
    return overtime(t)


@query("f35_first_possession", "era:s season_type:s games:i ties:i decided:i win_rate:d", """select case when season <= 2024 then 'to 2024' else '2025 on' end as era, season_type, count(*) as games, count_if(result = 0) as ties, count_if(result <> 0) as decided,
   avg(cast(fp_margin > 0 as int)) filter (where result <> 0) as win_rate from overtime group by all""", "overtime")
def f35(t):
    live = F.col("result") != 0
    return overtime(t).groupBy(F.when(F.col("season") <= 2024, "to 2024").otherwise("2025 on").alias("era"), "season_type").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(~live).alias("ties"), F.count_if(live).alias("decided"), F.avg(F.when(live, (F.col("fp_margin") > 0).cast("double"))).alias("win_rate"))


@query("f36_channel_cross_tab", "deflected:i worthy:i n:i mean_epa:d share_of_worthy:d", """select d as deflected, w as worthy, count(*) as n, avg(epa) as mean_epa, cast(count(*) as double) / sum(count(*)) over (partition by w) as share_of_worthy from (
   select cast(pass_defense_1_player_id <> interception_player_id as int) as d, cast(is_interception_worthy as int) as w, epa from charted where interception = 1) where d is not null group by d, w""", "charted")
def f36(t):
    rows = P.deflected_picks(charted_passes(t)).filter("deflected is not null").select(F.col("deflected").cast("int").alias("deflected"), F.col("is_interception_worthy").cast("int").alias("worthy"), "epa")
    cells = rows.groupBy("deflected", "worthy").agg(F.count(F.lit(1)).alias("n"), F.avg("epa").alias("mean_epa"))
    sides = cells.groupBy("worthy").agg(F.sum("n").alias("_t"))
    return cells.join(sides, "worthy").withColumn("share_of_worthy", ratio("n", "_t"))


@query("f37_result_census", "kind:s result:s n:i mean_epa:d", """select 'field_goal' as kind, field_goal_result as result, count(*) as n, avg(epa) as mean_epa from pbp where play_type = 'field_goal' group by all
   union all select 'extra_point', extra_point_result, count(*), avg(epa) from pbp where extra_point_attempt = 1 group by all
   union all select 'unaccounted', 'touchdowns less tries', count_if(touchdown = 1) - count_if(extra_point_attempt = 1) - count_if(two_point_attempt = 1), null from pbp""", "pbp")
def f37(t):
    def census(kind, cond):
        return t.pbp.filter(cond).groupBy(F.col(f"{kind}_result").alias("result")).agg(F.count(F.lit(1)).alias("n"), F.avg("epa").alias("mean_epa")).select(F.lit(kind).alias("kind"), "result", "n", "mean_epa")
    gap = t.pbp.agg((F.count_if(flag("touchdown")) - F.count_if(flag("extra_point_attempt")) - F.count_if(flag("two_point_attempt"))).alias("n")).select(
        F.lit("unaccounted").alias("kind"), F.lit("touchdowns less tries").alias("result"), "n", F.lit(None).cast("double").alias("mean_epa"))
    return J.union_strict([census("field_goal", F.col("play_type") == "field_goal"), census("extra_point", flag("extra_point_attempt")), gap])


@query("f38_text_census", "play_type:s in_population:i n:i kept:i", """select play_type, cast(fumble = 1 and fumbled_1_team is not null as int) as in_population, count(*) as n,
   count_if(contains(desc_text, concat('RECOVERED by ', posteam)) or contains(desc_text, 'and recovers')) as kept from pbp where contains(desc_text, 'MUFFS') group by all""", "pbp")
def f38(t):
    kept = F.col("desc").contains(F.concat(F.lit("RECOVERED by "), F.col("posteam"))) | F.col("desc").contains("and recovers")
    return t.pbp.filter(F.col("desc").contains("MUFFS")).groupBy("play_type", P.any_fumble().cast("int").alias("in_population")).agg(F.count(F.lit(1)).alias("n"), count_where(kept).alias("kept"))


@query("f39_replay_outcomes", "outcome:s n:i mean_epa:d games:i", "select replay_or_challenge_result as outcome, count(*) as n, avg(epa) as mean_epa, count(distinct game_id) as games from pbp where replay_or_challenge = 1 group by 1", "pbp")
def f39(t):
    per = t.pbp.filter(flag("replay_or_challenge")).groupBy(F.col("replay_or_challenge_result").alias("outcome"), "game_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("epa").alias("s"), F.count("epa").alias("c"))
    return per.groupBy("outcome").agg(F.sum("n").alias("n"), ratio(F.sum("s"), F.sum("c")).alias("mean_epa"), F.count(F.lit(1)).alias("games"))


shared("priced", "scrim ledger games", """select s.*, epa - case when posteam = home_team then coalesce(l, 0) else -coalesce(l, 0) end as epa_priced, case when posteam = home_team then coalesce(l, 0) else -coalesce(l, 0) end as luck_pos,
   case when yardline_100 <= 20 then 'red_zone' when down in (3,4) then 'late_down' else 'other' end as cell, cast(posteam = home_team as int) as is_home, concat(cast(season as varchar), '_', posteam) as team_season
   from scrim s left join (select game_id, play_id, sum(luck_epa) as l from ledger group by all) x on x.game_id = s.game_id and x.play_id = s.play_id where s.game_id in (select game_id from games where margin is not null)""")
shared("cells", "priced", """select *, n_all - n_rz - n_ld as n_other, epa_all - epa_rz - epa_ld as epa_other from (select game_id, posteam, season, team_season, max(is_home) as is_home, count(*) as n_all, sum(epa_priced) as epa_all, count_if(cell = 'red_zone') as n_rz, count_if(cell = 'late_down') as n_ld,
   coalesce(sum(epa_priced) filter (where cell = 'red_zone'), 0) as epa_rz, coalesce(sum(epa_priced) filter (where cell = 'late_down'), 0) as epa_ld from priced group by game_id, posteam, season, team_season)""")
shared("placed", "cells", """select *, score_rz + score_ld as score from (select *, (epa_rz - n_rz * epa_all / n_all) * 0.8389 as score_rz, (epa_ld - n_ld * epa_all / n_all) * 0.8389 as score_ld, (epa_other - n_other * epa_all / n_all) * 0.8389 as score_other from cells)""")


@query("f40_priced_plays", "plays:i priced:i mean_abs:d total:d", "select count(*) as plays, count_if(luck_pos <> 0) as priced, avg(abs(luck_pos)) as mean_abs, sum(luck_pos) as total from priced", "priced")
def f40(t):
    return PL.reconciliation(t.priced)


@query("f41_cell_table", "game_id:s posteam:s n_all:i epa_all:d n_rz:i n_ld:i epa_rz:d epa_ld:d", "select * from cells", "cells")
def f41(t):
    return t.cells


@query("f42_placement_scores", "game_id:s posteam:s score_rz:d score_ld:d score_other:d score:d", "select * from placed", "placed")
def f42(t):
    return PL.placement_scores(t.cells)


_SEASONS = """select s.*, epa_sum / plays as s0_quality, case when fn > plays then (fe - epa_sum) / (fn - plays) end as s0_other_seasons, sd_score / sqrt(games) as mean_sampling_sd from (
   select team_season, posteam as team, season, count(*) as games, avg(score) as mean_score, stddev_samp(score) as sd_score, sum(epa_all) as epa_sum, sum(n_all) as plays, avg(score_rz) as mean_rz, avg(score_ld) as mean_ld, sum(n_rz) as n_rz, sum(n_ld) as n_ld from placed group by team_season, posteam, season) s
   join (select posteam, sum(epa_all) as fe, sum(n_all) as fn from placed group by 1) f on f.posteam = s.team"""
shared("placement_seasons", "placed", _SEASONS)


@query("f43_placement_seasons", "team_season:s games:i mean_score:d sd_score:d s0_quality:d s0_other_seasons:d mean_sampling_sd:d", "select * from placement_seasons", "placement_seasons")
def f43(t):
    return PL.season_table(PL.placement_scores(t.cells))


@query("f44_differentials", "game_id:s home_score:d away_score:d differential:d", "select h.game_id, h.score as home_score, a.score as away_score, h.score - a.score as differential from placed h join placed a on a.game_id = h.game_id and h.is_home = 1 and a.is_home = 0", "placed")
def f44(t):
    return PL.differentials(PL.placement_scores(t.cells))


@query("f45_within_season_spread", "n_team_seasons:i observed_var:d sampling_var:d true_var:d true_sd:d", """with v as (select var_samp(epa_priced) filter (where cell = 'red_zone') as vr, var_samp(epa_priced) filter (where cell = 'late_down') as vl, var_samp(epa_priced) filter (where cell = 'other') as vo from priced),
   r as (select c.team_season, power(epa_all / n_all - m, 2) * g / greatest(g - 1, 1) as dev, (n_rz * vr + n_ld * vl + n_other * vo) / (n_all * n_all) as samp from v, cells c join (select team_season, sum(epa_all) / sum(n_all) as m, count(*) as g from cells group by 1) s on s.team_season = c.team_season)
   select count(distinct team_season) as n_team_seasons, avg(dev) as observed_var, avg(samp) as sampling_var, avg(dev) - avg(samp) as true_var, sqrt(greatest(avg(dev) - avg(samp), 0)) as true_sd from r""", "priced cells")
def f45(t):
    return PL.within_season_spread(t.cells, t.priced)


@query("f46_kick_table", "game_id:s play_id:d kicker_season:s distance:d made:i is_xp:i roof:s wind:d temp:d has_weather:i stadium_id:s", "select * exclude (wind, temp, has_weather), cwind as wind, ctemp as temp, cast(has_weather as int) as has_weather from kicks", "kicks")
def f46(t):
    return K.kick_table(t.pbp).withColumn("has_weather", F.col("has_weather").cast("int"))


@query("f47_matched_bin_gap", "bins:i weight:i weighted_gap:d", """select count(*) as bins, sum(nr) as weight, sum((mr - ml) * nr) / sum(nr) as weighted_gap from (select floor(spot / 5) * 5 as b, count_if(outcome in ('fair catch','returned')) as nl, count_if(outcome in ('downed','out of bounds')) as nr,
   avg(kick_distance) filter (where outcome in ('fair catch','returned')) as ml, avg(kick_distance) filter (where outcome in ('downed','out of bounds')) as mr from punts group by 1) where nl >= 10 and nr >= 10""", "punts")
def f47(t):
    rows = P.punt_table(t.pbp).withColumns({"bin": floor_bin("spot", 5), "outcome": P.punt_outcome()})
    group = F.when(F.col("outcome").isin("fair catch", "returned"), "left").when(F.col("outcome").isin("downed", "out of bounds"), "right")
    return ST.matched_bin_gap(rows, "bin", group, "kick_distance", 10)


@query("f48_return_entity_games", "kind:s entity_season:s game_id:s returns:i yards:d", """select * from (select *, count(*) over (partition by kind, entity_season) as g from (
   select 'kickoff' as kind, concat(cast(season as varchar), '_', kickoff_returner_player_id) as entity_season, game_id, count(*) as returns, sum(return_yards) as yards from pbp where kickoff_attempt = 1 and kickoff_returner_player_id is not null and return_yards is not null group by all
   union all select 'punt', concat(cast(season as varchar), '_', punt_returner_player_id), game_id, count(*), sum(return_yards) from pbp where punt_attempt = 1 and punt_returner_player_id is not null and return_yards is not null group by all)) where g >= 3""", "pbp")
def f48(t):
    parts = []
    for kind in ("kickoff", "punt"):
        per = P.return_table(t.pbp, kind).groupBy(keyed("season", "returner").alias("entity_season"), "game_id").agg(F.count(F.lit(1)).alias("returns"), F.sum("yards").alias("yards"))
        enough = per.groupBy("entity_season").agg(F.count(F.lit(1)).alias("g")).filter("g >= 3")
        parts.append(per.join(enough, "entity_season", "left_semi").withColumn("kind", F.lit(kind)))
    return J.union_strict(parts)


# two make-probability curves, so a shift has something to compare
_OLD = "1 / (1 + exp(-(2.2 - 0.085 * (distance - 35) - 0.1 * power(distance - 35, 2) / 100)))"
_NEW = "1 / (1 + exp(-(2.3 - 0.090 * (distance - 35) - 0.2 * power(distance - 35, 2) / 100 + 0.05 * power(distance - 35, 3) / 1000)))"
shared("shifts", "kicks", f"select *, ({_NEW} - {_OLD}) * 100 as delta_pp, {_OLD} as p_old, {_NEW} as p_new from kicks")


def shifts(t):
    c = F.col("distance") - 35.0
    old = logistic(F.lit(2.2) - F.lit(0.085) * c - F.lit(0.1) * c * c / 100.0)
    new = logistic(F.lit(2.3) - F.lit(0.090) * c - F.lit(0.2) * c * c / 100.0 + F.lit(0.05) * c * c * c / 1000.0)
    return K.kick_table(t.pbp).withColumns({"p_old": old, "p_new": new, "delta_pp": (new - old) * 100.0})


@query("f49_probability_shift", "grouping:s key:s n:i mean_shift:d median_shift:d max_shift:d", " union all ".join(
    f"""select '{g}' as "grouping", {k} as "key", count(*) as n, avg(delta_pp) as mean_shift, median(delta_pp) as median_shift, max(abs(delta_pp)) as max_shift from shifts group by 2"""
    for g, k in (("kind", "case when is_xp = 1 then 'extra_point' else 'field_goal' end"), ("roof", "roof"), ("bin", "cast(cast(floor(distance / 5) * 5 as int) as varchar)"))), "shifts")
def f49(t):
    tag = lambda g, k: F.struct(F.lit(g).alias("grouping"), k.alias("key"))
    tags = F.array(tag("kind", F.when(F.col("is_xp") == 1, "extra_point").otherwise("field_goal")), tag("roof", F.col("roof")), tag("bin", floor_bin("distance", 5).cast("string")))
    long = shifts(t).select(F.explode(tags).alias("x"), "delta_pp").select("x.*", "delta_pp")
    one = long.groupBy("grouping", "key").agg(F.count(F.lit(1)).alias("n"), F.avg("delta_pp").alias("mean_shift"), F.max(F.abs("delta_pp")).alias("max_shift"))
    return one.join(quantile_row(long, {"median_shift": ("delta_pp", 0.5)}, ["grouping", "key"]), ["grouping", "key"])


@query("f50_entity_movement", "status:s n:i mean_abs_move:d", """select case when a.k is not null and b.k is not null then 'shared' when a.k is not null then 'dropped' else 'added' end as status, count(*) as n, avg(abs(b.m - a.m)) as mean_abs_move
   from (select kicker_season as k, avg(made) as m from kicks group by 1) a full join (select kicker_season as k, avg(made) as m from kicks where distance >= 40 and is_xp = 0 group by 1) b on a.k = b.k group by 1""", "kicks")
def f50(t):
    kicks = K.kick_table(t.pbp)
    a = kicks.groupBy("kicker_season").agg(F.avg("made").alias("before"))
    b = kicks.filter("distance >= 40 and is_xp = 0").groupBy("kicker_season").agg(F.avg("made").alias("after"))
    status = F.when(F.col("after").isNull(), "dropped").when(F.col("before").isNull(), "added").otherwise("shared")
    return J.side_by_side(a, b, ["kicker_season"]).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("after") - F.col("before"))).alias("mean_abs_move"))


@query("f50_largest_movers", "kicker_season:s move:d", """select a.k as kicker_season, b.m - a.m as move from (select kicker_season as k, avg(made) as m from kicks group by 1) a join (select kicker_season as k, avg(made) as m from kicks where distance >= 40 and is_xp = 0 group by 1) b on a.k = b.k
   order by round(abs(b.m - a.m), 9) desc, a.k limit 5""", "kicks")
def f50_top(t):
    kicks = K.kick_table(t.pbp)
    a = kicks.groupBy("kicker_season").agg(F.avg("made").alias("before"))
    b = kicks.filter("distance >= 40 and is_xp = 0").groupBy("kicker_season").agg(F.avg("made").alias("after"))
    return a.join(b, "kicker_season").withColumn("move", F.col("after") - F.col("before")).orderBy(F.round(F.abs("move"), 9).desc(), "kicker_season").limit(5)


_BAND = "case when elev <= 1 then 'low' when elev <= 3 then 'mid' else 'high' end"
_ELEV = "(select *, (cast(substr(stadium_id, 2) as int) * cast(substr(stadium_id, 2) as int) % 53) / 10.0 as elev from shifts)"


@query("f53_elevation_cells", "cell:s kicks:i make_rate:d mean_shift:d moved_1pp:i", f"""select cell, count(*) as kicks, avg(made) as make_rate, avg(delta_pp) as mean_shift, count_if(abs(delta_pp) >= 1) as moved_1pp from (select *, concat({_BAND}, '|', cast(cast(floor(distance / 10) * 10 as int) as varchar)) as cell from {_ELEV}) group by cell having count(*) >= 100""", "shifts")
def f53(t):
    rows = K.with_elevation(shifts(t), t.spark.sql(K.ELEVATION_SQL))
    band = F.when(F.col("elev_kft") <= 1, "low").when(F.col("elev_kft") <= 3, "mid").otherwise("high")
    cell = F.concat_ws("|", band, floor_bin("distance", 10).cast("string"))
    return rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("kicks"), F.avg("made").alias("make_rate"), F.avg("delta_pp").alias("mean_shift"),
                                                F.count_if(F.abs("delta_pp") >= 1).alias("moved_1pp")).filter("kicks >= 100")


@query("f54_observability_census", "attempts:i completions_defended:i incompletions_defended:i narrated:i observable:i", """select count(*) as attempts, count_if(complete_pass = 1 and pass_defense_1_player_id is not null) as completions_defended, count_if(complete_pass <> 1 and interception <> 1 and pass_defense_1_player_id is not null) as incompletions_defended,
   count_if(regexp_matches(lower(desc_text), 'tipped|deflect|batted')) as narrated, cast(count_if(complete_pass = 1 and pass_defense_1_player_id is not null) > 0 and count_if(regexp_matches(lower(desc_text), 'tipped|deflect|batted')) > count_if(complete_pass <> 1 and interception <> 1 and pass_defense_1_player_id is not null) as int) as observable
   from pbp where pass_attempt = 1 and sack <> 1""", "pbp")
def f54(t):
    pd = F.col("pass_defense_1_player_id").isNotNull()
    one = t.pbp.filter("pass_attempt = 1 and sack <> 1").agg(
        F.count(F.lit(1)).alias("attempts"), count_where((F.col("complete_pass") == 1) & pd).alias("completions_defended"),
        count_where((F.col("complete_pass") != 1) & (F.col("interception") != 1) & pd).alias("incompletions_defended"), count_where(F.col("desc").rlike("(?i)tipped|deflect|batted")).alias("narrated"))
    return one.withColumn("observable", ((F.col("completions_defended") > 0) & (F.col("narrated") > F.col("incompletions_defended"))).cast("int"))


@query("f55_quality_channels", "team_seasons:i r_score:d r_spread:d r_red_zone:d r_late_down:d r_rz_share:d r_ld_share:d between_sd:d within_sd:d implied_split_half:d", """select *, sig / (sig + within_sd * within_sd / (g / 2)) as implied_split_half from (select *, greatest(between_sd * between_sd - within_sd * within_sd / g, 0) as sig from (
   select count(*) as team_seasons, corr(mean_score, s0_quality) as r_score, corr(sd_score, s0_quality) as r_spread, corr(mean_rz, s0_quality) as r_red_zone, corr(mean_ld, s0_quality) as r_late_down, corr(n_rz / plays, s0_quality) as r_rz_share, corr(n_ld / plays, s0_quality) as r_ld_share,
   stddev_samp(mean_score) as between_sd, avg(sd_score) as within_sd, avg(games) as g from placement_seasons where games >= 3))""", "placement_seasons")
def f55(t):
    return PL.quality_channels(PL.season_table(PL.placement_scores(t.cells)), min_games=3)


shared("rest", "cells", "select *, sum(epa_all) over w - epa_all as epa_rest, sum(n_all) over w - n_all as n_rest, case when sum(n_all) over w > n_all then (sum(epa_all) over w - epa_all) / (sum(n_all) over w - n_all) end as s0_loo from cells window w as (partition by team_season)")


def _loto(rows: str, y: str, w: str, name: str) -> str:
    return f"""select r.game_id, r.posteam, (q.wy - q.b * q.wx) / q.w + q.b * r.s0_loo as {name} from {rows} r join (
     select g, w, wx, wy, (w * wxy - wx * wy) / (w * wxx - wx * wx) as b from (select a.posteam as g, t.w - a.w as w, t.wx - a.wx as wx, t.wxx - a.wxx as wxx, t.wy - a.wy as wy, t.wxy - a.wxy as wxy from
       (select posteam, sum({w}) as w, sum({w} * s0_loo) as wx, sum({w} * s0_loo * s0_loo) as wxx, sum({w} * {y}) as wy, sum({w} * {y} * s0_loo) as wxy from {rows} group by posteam) a,
       (select sum({w}) as w, sum({w} * s0_loo) as wx, sum({w} * s0_loo * s0_loo) as wxx, sum({w} * {y}) as wy, sum({w} * {y} * s0_loo) as wxy from {rows}) t)) q on q.g = r.posteam"""


def _mean_sql(c: str) -> str:
    return f"(case when n_{c} > 0 then epa_{c} / n_{c} else 0 end)"


shared("rested", "rest", "select * from rest where s0_loo is not null")
shared("profile", "rested", f"""select r.*, a.mu_rz, b.mu_ld, c.mu_other from rested r join ({_loto('rested', _mean_sql('rz'), 'n_rz', 'mu_rz')}) a on a.game_id = r.game_id and a.posteam = r.posteam
   join ({_loto('rested', _mean_sql('ld'), 'n_ld', 'mu_ld')}) b on b.game_id = r.game_id and b.posteam = r.posteam join ({_loto('rested', _mean_sql('other'), 'n_other', 'mu_other')}) c on c.game_id = r.game_id and c.posteam = r.posteam""")
_CEN = {c: f"(case when n_{c} > 0 then epa_{c} - n_{c} * mu_{c} else 0 end)" for c in ("rz", "ld", "other")}
_BASE = f"(({_CEN['rz']} + {_CEN['ld']} + {_CEN['other']}) / n_all)"
shared("redesigned", "profile", f"""select *, points_rz + points_ld as score from (select *, ({_CEN['rz']} - n_rz * {_BASE}) * 0.8389 as points_rz, ({_CEN['ld']} - n_ld * {_BASE}) * 0.8389 as points_ld, ({_CEN['other']} - n_other * {_BASE}) * 0.8389 as points_other,
   (n_rz * mu_rz + n_ld * mu_ld - (n_rz + n_ld) * (n_rz * mu_rz + n_ld * mu_ld + n_other * mu_other) / n_all) * 0.8389 as profile_shift from profile)""")


def rested(t):
    return PL.with_rest_of_season(t.cells).filter("s0_loo is not null")


@query("a23_leave_group_out_fit", "game_id:s posteam:s mu_rz:d", _loto("rested", _mean_sql("rz"), "n_rz", "mu_rz"), "rested")
def a23(t):
    return PL.leave_group_out_fit(rested(t), "posteam", {"mu_rz": (PL.cell_mean("rz"), F.col("n_rz"))}, "s0_loo")


@query("a24_redesigned_scores", "game_id:s posteam:s mu_rz:d mu_ld:d mu_other:d points_rz:d points_ld:d points_other:d score:d profile_shift:d", "select * from redesigned", "redesigned")
def a24(t):
    return PL.redesigned_scores(rested(t))


@query("a25_rest_rates", "game_id:s posteam:s s0_loo:d", "select * from rest", "rest")
def a25(t):
    return ST.leave_one_out_rate(t.cells, "team_season", "epa_all", "n_all", "s0_loo")


@query("f56_expected_mix", "game_id:s posteam:s q_rz:d q_ld:d q_other:d mix_rz:d mix_ld:d", f"""with q as (select r.*, a.q_rz, b.q_ld, c.q_other from redesigned r join ({_loto('rested', '(n_rz / cast(n_all as double))', 'n_all', 'q_rz')}) a on a.game_id = r.game_id and a.posteam = r.posteam
   join ({_loto('rested', '(n_ld / cast(n_all as double))', 'n_all', 'q_ld')}) b on b.game_id = r.game_id and b.posteam = r.posteam join ({_loto('rested', '(n_other / cast(n_all as double))', 'n_all', 'q_other')}) c on c.game_id = r.game_id and c.posteam = r.posteam),
   w as (select *, """ + ", ".join(f"case when n_{c} > 0 then n_all * q_{c} else 0 end as w_{c}, case when n_{c} > 0 then n_all * q_{c} * (epa_{c} - n_{c} * mu_{c}) / n_{c} else 0 end as k_{c}" for c in ("rz", "ld", "other")) + """ from q)
   select *, (k_rz - w_rz * (k_rz + k_ld + k_other) / (w_rz + w_ld + w_other)) * 0.8389 as mix_rz, (k_ld - w_ld * (k_rz + k_ld + k_other) / (w_rz + w_ld + w_other)) * 0.8389 as mix_ld from w""", "redesigned rested")
def f56(t):
    return PL.expected_mix_points(PL.redesigned_scores(rested(t)))


@query("f57_compose_folds", "game_id:s part:s total_luck_epa:d", """select game_id, case when season % 2 = 0 then 'even' else 'odd' end as part, total_luck_epa from edition_b""", "edition_b")
def f57(t):
    """Each contest from the part that never saw it; a contest scored twice is an error."""
    parts = [t.edition_b.filter(F.col("season") % 2 == i).withColumn("part", F.lit(n)) for i, n in ((0, "even"), (1, "odd"))]
    whole = J.union_strict(parts).groupBy("game_id").agg(F.count(F.lit(1)).alias("c"), F.max("part").alias("part"), F.max("total_luck_epa").alias("total_luck_epa"))
    return guarded(whole, F.col("c") > 1, F.concat(F.lit("scored by two parts: "), F.col("game_id")))


@query("f58_resampling_universe", "result:s n:i points:d", "select result, count(*) as n, sum(points) as points from drives where result in ('Touchdown','Field goal','Punt','Turnover','Turnover on downs','Missed field goal') group by 1", "drives")
def f58(t):
    return t.drives.filter(F.col("result").isin(*C.RESAMPLED_RESULTS)).groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


_DRAWS = "select kicker_season, 2.0 + avg(made) as alpha, -0.08 - 0.01 * avg(made) as beta, 0.1 + 0.1 * avg(made) as elev from kicks group by 1"


@query("f59_rate_curves", "distance:i site:d make_at_centre:d make_at_site:d shift_pp:d shift_low:d shift_high:d", f"""with g as (select d.distance, s.site, 1 / (1 + exp(-(alpha + beta * (distance - 35)))) as pc, 1 / (1 + exp(-(alpha + beta * (distance - 35) + elev * (site - 1.0)))) as ps
   from ({_DRAWS}), (values (25), (35), (45), (55)) d(distance), (values (0.0), (5.2)) s(site))
   select distance, site, avg(pc) * 100 as make_at_centre, avg(ps) * 100 as make_at_site, avg(ps - pc) * 100 as shift_pp, quantile_cont((ps - pc) * 100, 0.055) as shift_low, quantile_cont((ps - pc) * 100, 0.945) as shift_high from g group by all""", "kicks")
def f59(t):
    draws = K.kick_table(t.pbp).groupBy("kicker_season").agg(F.avg("made").alias("m")).select(
        (F.lit(2.0) + F.col("m")).alias("alpha"), (F.lit(-0.08) - F.lit(0.01) * F.col("m")).alias("beta"), (F.lit(0.1) + F.lit(0.1) * F.col("m")).alias("elev"))
    grid = draws.withColumn("distance", F.explode(F.array(*[F.lit(d) for d in (25, 35, 45, 55)]))).withColumn("site", F.explode(F.array(F.lit(0.0), F.lit(5.2))))
    lin = F.col("alpha") + F.col("beta") * (F.col("distance") - 35)
    grid = grid.withColumns({"pc": logistic(lin), "ps": logistic(lin + F.col("elev") * (F.col("site") - 1.0))}).withColumn("shift", (F.col("ps") - F.col("pc")) * 100.0)
    one = grid.groupBy("distance", "site").agg((F.avg("pc") * 100).alias("make_at_centre"), (F.avg("ps") * 100).alias("make_at_site"), F.avg("shift").alias("shift_pp"))
    q = quantile_row(grid, {"shift_low": ("shift", 0.055), "shift_high": ("shift", 0.945)}, ["distance", "site"])
    return one.join(q, ["distance", "site"])


__all__ = ["L", "components", "overtime", "sequencing", "shifts"]

"""Joins, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.functions import plays as P
from contestry.functions.columns import flag, modern_code
from contestry.operators import features as FE
from contestry.operators import joins as J
from contestry.operators import kicks as K
from contestry.operators import posterior as B
from contestry.operators import windows as WN
from contestry.operators.ranking import equal_count_bins, with_positions
from contestry.plans.catalogue import query
from contestry.plans.oracle_tables import shared
from contestry.plans.queries.filters import charted_passes

TG = "game_id:s posteam:s"


@query("j01_opponent_self_join", f"{TG} success_rate_for:d success_rate_against:d",
       """select a.game_id, a.posteam, a.success_rate as success_rate_for, b.success_rate as success_rate_against from offense a left join offense b
          on a.season = b.season and a.week = b.week and a.game_id = b.game_id and a.posteam = b.defteam and a.defteam = b.posteam""", "offense")
def j01(t):
    off = FE.offense(t.plays)
    other = off.select("season", "week", "game_id", F.col("posteam").alias("defteam"), F.col("defteam").alias("posteam"),
                       F.col("success_rate").alias("success_rate_against"))
    return off.join(other, FE.KEYS, "left").withColumn("success_rate_for", F.col("success_rate"))


@query("j02_scores_inner", f"{TG} home_score:i away_score:i", "select o.game_id, o.posteam, s.home_score, s.away_score from offense o join scores s on s.game_id = o.game_id", "offense scores")
def j02(t):
    return FE.offense(t.plays).join(t.scores.drop("season", "week"), "game_id")


@query("j03_credit_left_fill", f"{TG} takeaways:i return_yards:d", """select o.game_id, o.posteam, coalesce(c.t, 0) as takeaways, coalesce(c.r, 0) as return_yards
   from offense o left join credit c on c.game_id = o.game_id and c.posteam = o.posteam""", "offense credit")
def j03(t):
    credit = FE.fold_credit(t.plays, "take").withColumnRenamed("team", "posteam")
    return FE.offense(t.plays).join(credit, FE.TEAM_GAME, "left").withColumns({
        "takeaways": F.coalesce("fold_takeaways", F.lit(0)), "return_yards": F.coalesce("fold_return_yards", F.lit(0.0))})


@query("j04_one_to_one", f"{TG} k:i n:i own_success_rate_for:d", "select f.game_id, f.posteam, o.k, o.n, f.own_success_rate_for from frame f join own o on o.game_id = f.game_id and o.posteam = f.posteam", "frame own")
def j04(t):
    left = t.frame.select("own_success_rate_for", *FE.TEAM_GAME)
    right = B.production(t.plays).select("k", "n", *FE.TEAM_GAME)
    return J.one_to_one(left, right, FE.TEAM_GAME)


@query("j05_home_away_pairs", "game_id:s home:s away:s result:d own_ypp_for_h:d own_ypp_for_a:d", """select h.game_id, h.posteam as home, a.posteam as away, h.points_for - a.points_for as result,
   h.own_ypp_for as own_ypp_for_h, a.own_ypp_for as own_ypp_for_a from frame h join frame a on a.game_id = h.game_id and h.home = 1 and a.home = 0""", "frame")
def j05(t):
    return B.game_pairs(t.frame)


@query("j06_plays_in_frame", "season:i n:i", "select season, count(*) as n from plays p where exists (select 1 from frame f where f.game_id = p.game_id and f.posteam = p.posteam) group by season", "plays frame")
def j06(t):
    return t.plays.join(t.frame.select(*FE.TEAM_GAME), FE.TEAM_GAME, "left_semi").groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query("j07_population_overlap", "pair:s shared:i", """select 'onside/fumble' as pair, count(*) as shared from onside o where exists (select 1 from live_fumbles f where f.game_id = o.game_id and f.play_id = o.play_id)
   union all select 'blocked/fumble', count(*) from blocked o where exists (select 1 from live_fumbles f where f.game_id = o.game_id and f.play_id = o.play_id)
   union all select 'muff/fumble', count(*) from muffs o where exists (select 1 from live_fumbles f where f.game_id = o.game_id and f.play_id = o.play_id)""", "onside blocked muffs live_fumbles")
def j07(t):
    key = ["game_id", "play_id"]
    fumbles = P.fumble_frame(t.pbp, widened=False).select(*key)
    parts = [f.join(fumbles, key, "left_semi").agg(F.count(F.lit(1)).alias("shared")).select(F.lit(n).alias("pair"), "shared")
             for n, f in (("onside/fumble", P.onside_frame(t.pbp)), ("blocked/fumble", P.blocked_frame(t.pbp)), ("muff/fumble", P.muff_frame(t.pbp)))]
    return J.union_strict(parts)


@query("j08_blocked_not_fumble", "game_id:s play_id:d kick_class:s retained:i", "select * from blocked o where not exists (select 1 from live_fumbles f where f.game_id = o.game_id and f.play_id = o.play_id)", "blocked live_fumbles")
def j08(t):
    return P.blocked_frame(t.pbp).join(P.fumble_frame(t.pbp, widened=False).select("game_id", "play_id"), ["game_id", "play_id"], "left_anti")


@query("j09_class_tables_full", "fumble_class:s n_live:i p_live:d n_all:i p_all:d", """with l as (select fumble_class, count(*) as n_live, avg(retained) as p_live from live_fumbles group by 1),
   w as (select fumble_class, count(*) as n_all, avg(retained) as p_all from fumbles group by 1)
   select coalesce(l.fumble_class, w.fumble_class) as fumble_class, n_live, p_live, n_all, p_all from l full join w on l.fumble_class = w.fumble_class""", "live_fumbles fumbles")
def j09(t):
    def table(widened, tag):
        return P.fumble_frame(t.pbp, widened).groupBy("fumble_class").agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), F.avg("retained").alias(f"p_{tag}"))
    return J.side_by_side(table(False, "live"), table(True, "all"), ["fumble_class"])


@query("j10_charting_to_plays", "game_id:s play_id:d is_drop:i receiver_player_id:s", "select game_id, play_id, cast(is_drop as int) as is_drop, receiver_player_id from charted", "charted")
def j10(t):
    return charted_passes(t).withColumn("is_drop", F.col("is_drop").cast("int"))


@query("j11_row_count_guard", "rows_before:i added_rows:i unchanged:i", "select count(*) as rows_before, 0 as added_rows, 1 as unchanged from fumbles", "fumbles")
def j11(t):
    drives = t.pbp.select("game_id", "play_id", "fixed_drive", "qtr")
    return J.checked_left(P.fumble_frame(t.pbp).select("game_id", "play_id"), drives, ["game_id", "play_id"])[1]


@query("j12_stadium_elevation", "stadium_id:s n:i elev_kft:d", """select stadium_id, count(*) as n, max((cast(substr(stadium_id, 2) as int) * cast(substr(stadium_id, 2) as int) % 53) / 10.0) as elev_kft from kicks group by 1""", "kicks")
def j12(t):
    kicks = K.with_elevation(K.kick_table(t.pbp), t.spark.sql(K.ELEVATION_SQL))
    return kicks.groupBy("stadium_id").agg(F.count(F.lit(1)).alias("n"), F.max("elev_kft").alias("elev_kft"))


shared("all_fumbles", "fumbles muffs", """select game_id, play_id, season, week, home_team, posteam, fumbled_1_team, epa_fumbler, retained, out_of_bounds, fumble_class from fumbles f
   where not exists (select 1 from muffs m where m.game_id = f.game_id and m.play_id = f.play_id)
   union all select game_id, play_id, season, week, home_team, posteam, muffing_team, epa_fumbler, retained, false, 'kickoff/muff' from muffs""")


def all_fumbles(pbp):
    """Fumbles with the kickoff muffs put in their own class, each play once."""
    muffs = P.muff_frame(pbp).select(
        "game_id", "play_id", "season", "week", "home_team", "posteam", F.col("muffing_team").alias("fumbled_1_team"),
        "epa_fumbler", "retained", F.lit(False).alias("out_of_bounds"), F.lit("kickoff/muff").alias("fumble_class"))
    return J.override(P.fumble_frame(pbp), muffs, ["game_id", "play_id"])


@query("j13_override_union", "game_id:s play_id:d fumble_class:s retained:i", "select * from all_fumbles", "all_fumbles")
def j13(t):
    return all_fumbles(t.pbp)


shared("pairs", "games", """select pair, season, game_id, week, home_team, away_team, margin, row_number() over (partition by pair order by week, game_id) - 1 as meeting
   from (select *, concat(cast(season as varchar), '_', least(home_team, away_team), '_', greatest(home_team, away_team)) as pair from games where margin is not null)""")
shared("rematches", "pairs", """select a.pair, a.season, a.game_id, a.home_team as team_a, a.away_team as team_b, a.margin as margin_g1_a,
   case when b.home_team = a.home_team then b.margin else -b.margin end as margin_g2_a, cast(b.home_team = a.home_team as int) as a_home_g2
   from pairs a join pairs b on a.pair = b.pair and a.meeting = 0 and b.meeting = 1 where b.margin <> 0""")


@query("j14_rematch_pairs", "pair:s season:i team_a:s team_b:s margin_g1_a:d margin_g2_a:d a_home_g2:i", "select * from rematches", "rematches")
def j14(t):
    return WN.rematches(t.games)


@query("j18_rematch_predictors", "pair:s game_id:s margin_g1_a:d margin_g2_a:d deserved_margin:d", "select r.*, d.deserved_margin from rematches r join deserved d on d.game_id = r.game_id", "rematches deserved")
def j18(t):
    return WN.rematches(t.games).join(t.deserved.select("game_id", "deserved_margin"), "game_id")


_TRY = """select *, case when (extra_point_attempt = 1 and extra_point_result is not null and kick_distance is not null) or two_point_attempt = 1 then 1 else 0 end as is_try from pbp"""
_NEXT = f"select *, coalesce(max(is_try) over (partition by game_id order by play_id, mix rows between 1 following and 15 following), 0) as try_follows from ({_TRY})"


def _tries(t):
    is_try = F.coalesce(P.extra_point_attempt(), F.lit(False)) | flag("two_point_attempt")
    rows = t.pbp.select("game_id", "play_id", "mix", "qtr", "touchdown", is_try.cast("int").alias("is_try"))
    return WN.next_try(rows, "is_try")


@query("j15_touchdown_to_try", "qtr:i touchdowns:i unmatched:i", f"select qtr, count(*) as touchdowns, count_if(try_follows = 0) as unmatched from ({_NEXT}) where touchdown = 1 group by qtr", "pbp")
def j15(t):
    return _tries(t).filter("touchdown = 1").groupBy("qtr").agg(
        F.count(F.lit(1)).alias("touchdowns"), F.count_if(F.col("try_follows") == 0).alias("unmatched"))


@query("j16_head_coach", "game_id:s posteam:s coach:s", "select game_id, home_team as posteam, home_coach as coach from schedule union all select game_id, away_team, away_coach from schedule", "schedule")
def j16(t):
    return J.unpivot_sides(t.schedule, "home_team", "away_team", "home_coach", "away_coach", "posteam", "coach")


@query("j17_small_grid", "rep:i season:i n:i", "select rep, season, count(*) as n from games, (select unnest(generate_series(0, 19)) as rep) group by all", "games")
def j17(t):
    per = t.games.groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))


# --- windows -----------------------------------------------------------------------------

shared("team_margins", "games", """select game_id, season, week, home_team as team, margin from games
   union all select game_id, season, week, away_team, -margin from games""")


def team_margins(t):
    both = F.array(F.struct(F.col("home_team").alias("team"), F.col("margin").alias("margin")),
                   F.struct(F.col("away_team").alias("team"), (-F.col("margin")).alias("margin")))
    return t.games.select("game_id", "season", "week", F.explode(both).alias("s")).select("game_id", "season", "week", "s.*")


_ROLL = """select game_id, team, row_number() over w - 1 as games_played,
   case when count(margin) over p >= 8 then avg(margin) over p end as strength from team_margins
   window w as (partition by team order by season, week, game_id), p as (partition by team order by season, week, game_id rows between 17 preceding and 1 preceding)"""
shared("strength", "team_margins", _ROLL)


@query("w01_rolling_strength", "game_id:s team:s strength:d games_played:i", "select * from strength", "strength")
def w01(t):
    return WN.rolling_strength(team_margins(t), "margin")


@query("w02_meeting_index", "pair:s game_id:s meeting:i", "select * from pairs", "pairs")
def w02(t):
    return WN.meetings(t.games)


@query("w03_total_minus_own", f"{TG} season:i yards_rest:d plays_rest:i", """select game_id, posteam, season, sum(yards_for) over w - yards_for as yards_rest, sum(plays_for) over w - plays_for as plays_rest
   from frame window w as (partition by season, posteam)""", "frame")
def w03(t):
    keys = ["season", "posteam"]
    totals = t.frame.groupBy(*keys).agg(F.sum("yards_for").alias("ty"), F.sum("plays_for").alias("tp"))
    return t.frame.join(totals, keys).withColumns({
        "yards_rest": F.col("ty") - F.col("yards_for"), "plays_rest": F.col("tp") - F.col("plays_for")})


@query("w04_equal_count_bins", "bin:i n:i low:d high:d", """select bin, count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high from (select *, floor((row_number() over (order by o_totalprice, o_orderkey) - 1) * 7 / count(*) over ()) as bin from orders) group by bin""")
def w04(t):
    return equal_count_bins(t.raw("orders").select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey", 7).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("w05_first_and_last", "game_id:s first_posteam:s last_posteam:s", """select game_id, arg_min(posteam, play_id) as first_posteam, arg_max(posteam, play_id) as last_posteam from pbp where posteam is not null group by game_id""", "pbp")
def w05(t):
    return t.pbp.filter("posteam is not null").groupBy("game_id").agg(
        F.min_by("posteam", "play_id").alias("first_posteam"), F.max_by("posteam", "play_id").alias("last_posteam"))


@query("w06_forward_frame", "try_follows:i n:i", f"select try_follows, count(*) as n from ({_NEXT}) group by 1", "pbp")
def w06(t):
    return _tries(t).groupBy("try_follows").agg(F.count(F.lit(1)).alias("n"))


@query("w07_run_boundaries", "posteam:s runs:i games:i", """select posteam, count(*) as runs, count(distinct game_id) as games from (select *, lag(posteam) over (partition by game_id order by play_id, mix) as prev, row_number() over (partition by game_id order by play_id, mix) as rn
   from pbp where posteam is not null) where rn = 1 or prev <> posteam group by posteam""", "pbp")
def w07(t):
    """Possession runs: a row starts a run when the row before it belongs to the other side."""
    from contestry.operators.ranking import bounded_frame, drop_copies

    placed = with_positions(t.pbp.filter("posteam is not null").select("game_id", "play_id", "mix", "posteam"),
                            ["game_id"], ["play_id", "mix"], "pos")
    laid, over = bounded_frame(placed, ["game_id"], "pos", 1, 0)
    starts = drop_copies(laid.withColumn("prev", F.lag("posteam").over(over))).filter(
        "pos = 0 or prev <> posteam")
    per_game = starts.groupBy("posteam", "game_id").agg(F.count(F.lit(1)).alias("r"))
    return per_game.groupBy("posteam").agg(F.sum("r").alias("runs"), F.count(F.lit(1)).alias("games"))


@query("w08_weighted_step_quantile", "season:i q25:d q50:d q95:d", """with c as (select season, yards_for, sum(plays_for) over (partition by season order by yards_for, game_id, posteam rows unbounded preceding) as cum,
   sum(plays_for) over (partition by season) as total from frame) select season, min(case when cum >= 0.25 * total then yards_for end) as q25, min(case when cum >= 0.5 * total then yards_for end) as q50,
   min(case when cum >= 0.95 * total then yards_for end) as q95 from c group by season""", "frame")
def w08(t):
    rows = t.frame.select("season", "yards_for", "plays_for", F.concat_ws("|", "game_id", "posteam").alias("tie"))
    return WN.weighted_step_quantiles(rows, ["season"], "yards_for", "plays_for", "tie", {"q25": 0.25, "q50": 0.5, "q95": 0.95})


@query("w09_weighted_linear_quantile", "q05:d q50:d q95:d", """with c as (select yards_for, sum(plays_for) over (order by yards_for, game_id, posteam rows unbounded preceding) / sum(plays_for) over () as share, row_number() over (order by yards_for, game_id, posteam) rn from frame),
   l as (select *, lead(share) over (order by rn) as s2, lead(yards_for) over (order by rn) as y2 from c)
   select max(case when share <= 0.055 and s2 > 0.055 then yards_for + (0.055 - share) / (s2 - share) * (y2 - yards_for) end) as q05,
     max(case when share <= 0.5 and s2 > 0.5 then yards_for + (0.5 - share) / (s2 - share) * (y2 - yards_for) end) as q50,
     max(case when share <= 0.945 and s2 > 0.945 then yards_for + (0.945 - share) / (s2 - share) * (y2 - yards_for) end) as q95 from l""", "frame")
def w09(t):
    rows = t.frame.select("yards_for", "plays_for", F.concat_ws("|", "game_id", "posteam").alias("tie"))
    return WN.weighted_linear_quantiles(rows, "yards_for", "plays_for", "tie", {"q05": 0.055, "q50": 0.5, "q95": 0.945})


# --- sorts and sets ------------------------------------------------------------------------


@query("k02_worst_short_games", "game_id:s n_plays:i", "select game_id, count(*) as n_plays from pbp group by 1 having count(*) < 120 order by n_plays, game_id limit 3", "pbp")
def k02(t):
    per = t.pbp.groupBy("game_id").agg(F.count(F.lit(1)).alias("n_plays"))
    return per.filter("n_plays < 120").orderBy("n_plays", "game_id").limit(3)


@query("k03_largest_movers", "game_id:s gap:d", "select game_id, deserved_margin - (home_score - away_score) as gap from deserved order by abs(deserved_margin - (home_score - away_score)) desc, game_id limit 10", "deserved")
def k03(t):
    gap = F.col("deserved_margin") - (F.col("home_score") - F.col("away_score"))
    return t.deserved.withColumn("gap", gap).orderBy(F.abs("gap").desc(), "game_id").limit(10)


@query("k04_top_with_reasons", "game_id:s reasons:s", """select game_id, string_agg(reason, ',' order by reason) as reasons from (
   (select game_id, 'largest margin' as reason from deserved order by abs(deserved_margin) desc, game_id limit 8)
   union all (select game_id, 'closest' from deserved order by abs(deserved_margin), game_id limit 8)
   union all (select game_id, 'most yards' from deserved order by home_yards + away_yards desc, game_id limit 8)) group by game_id""", "deserved")
def k04(t):
    return J.top_by(t.deserved, {
        "largest margin": (F.abs("deserved_margin").desc(), "game_id"), "closest": (F.abs("deserved_margin"), "game_id"),
        "most yards": ((F.col("home_yards") + F.col("away_yards")).desc(), "game_id")}, 8, "game_id")


@query("k05_top_and_bottom", "end:s game_id:s deserved_margin:d", """(select 'low' as "end", game_id, deserved_margin from deserved order by deserved_margin, game_id limit 5)
   union all (select 'high', game_id, deserved_margin from deserved order by deserved_margin desc, game_id limit 5)""", "deserved")
def k05(t):
    return J.extremes(t.deserved.select("game_id", "deserved_margin"), "deserved_margin", 5, "game_id")


@query("k06_ordered_distinct_ids", "game_id:s pos:i", "select game_id, min(play_id) as pos from pbp where fumble_lost = 1 group by game_id", "pbp")
def k06(t):
    asked = t.pbp.filter("fumble_lost = 1").groupBy("game_id").agg(F.min("play_id").alias("pos"))
    return asked


@query("u01_union_missing_columns", "season:i game_id:s home_score:i spread:d", """select season, game_id, home_score, null as spread from schedule where season < 2020
   union all select s.season, s.game_id, s.home_score, p.spread from schedule s join (select game_id, max(spread_line) as spread from pbp group by 1) p on p.game_id = s.game_id where s.season >= 2020""", "schedule pbp")
def u01(t):
    old = t.schedule.filter("season < 2020").select("season", "game_id", "home_score")
    line = t.pbp.groupBy("game_id").agg(F.max("spread_line").alias("spread"))
    new = t.schedule.filter("season >= 2020").select(F.col("season").cast("long").alias("season"), "game_id", "home_score").join(line, "game_id")
    return J.union_loose([old, new])


@query("u02_strict_union", "kind:s n:i yards:d", "select kind, count(*) as n, sum(y) as yards from (select 'kickoff' as kind, return_yards as y from pbp where kickoff_attempt = 1 union all select 'punt', return_yards from pbp where punt_attempt = 1) group by kind", "pbp")
def u02(t):
    parts = [t.pbp.filter(F.col(f"{k}_attempt") == 1).select(F.lit(k).alias("kind"), F.col("return_yards").alias("y")) for k in ("kickoff", "punt")]
    return J.union_strict(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("yards"))


@query("u03_key_membership", "where:s n:i", """select "where", count(*) as n from (select case when l.k is not null and r.k is not null then 'both' when l.k is not null then 'left' else 'right' end as "where"
   from (select distinct game_id as k from onside) l full join (select distinct game_id as k from muffs) r on l.k = r.k) group by 1""", "onside muffs")
def u03(t):
    m = J.membership(P.onside_frame(t.pbp).select("game_id"), P.muff_frame(t.pbp).select("game_id"), ["game_id"])
    return m.groupBy("where").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["all_fumbles", "modern_code", "team_margins"]

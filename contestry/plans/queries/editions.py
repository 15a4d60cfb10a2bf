"""Comparison of two scored editions of the same contests."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions.columns import digest, guarded, uniform
from contestry.operators import compare as CM
from contestry.operators import ledger as L
from contestry.operators.ranking import quantile_row
from contestry.plans.catalogue import query
from contestry.plans.oracle_tables import shared
from contestry.plans.queries.ledger import edition_sql


def _b(share: str, margin: str) -> str:
    return f"case when {share} between 0.4 and 0.6 then 'too close to call' when ({share} > 0.5) = ({margin} > 0) then 'scoreboard holds' else 'clear flip' end"


_FLIP = "(actual_margin <> 0 and {d} <> 0 and ({d} > 0) <> (actual_margin > 0))"
_SIGN, _SHARE = _FLIP.format(d="deserved_margin"), "(actual_margin <> 0 and (dtw_home > 0.5) <> (actual_margin > 0))"
shared("pairs_ab", "edition_a edition_b", f"""select a.game_id, a.season, a.actual_margin, a.deserved_margin as deserved_margin_a, b.deserved_margin as deserved_margin_b, a.dtw_home as dtw_home_a, b.dtw_home as dtw_home_b, a.dtw_low as dtw_low_a, b.dtw_low as dtw_low_b,
   a.dtw_high as dtw_high_a, b.dtw_high as dtw_high_b, b.n_luck_events - a.n_luck_events as extra, {_b('a.dtw_home', 'a.actual_margin')} as bucket_a, {_b('b.dtw_home', 'a.actual_margin')} as bucket_b, b.dtw_home - a.dtw_home as delta from edition_a a join edition_b b on b.game_id = a.game_id""")


def pairs(t):
    return CM.paired(t.edition_a, t.edition_b).withColumn("extra", F.col("n_luck_events_b") - F.col("n_luck_events_a"))


@query("c01_verdict_buckets", "game_id:s bucket:s", f"select game_id, {_b('dtw_home', 'actual_margin')} as bucket from edition_b", "edition_b")
def c01(t):
    return t.edition_b.withColumn("bucket", CM.bucket("dtw_home", "actual_margin"))


@query("c02_headline_audit", "games:i sign_flips:i ties:i degenerate:i too_close:i clear_flip:i holds:i movers:i largest_swing:d largest_game:s median_shift:d sign_flip_share:d", f"""select count(*) as games, count_if({_SIGN}) as sign_flips, count_if(actual_margin = 0) as ties, count_if(dtw_home <= 0.001 or dtw_home >= 0.999) as degenerate,
   count_if(b = 'too close to call') as too_close, count_if(b = 'clear flip') as clear_flip, count_if(b = 'scoreboard holds') as holds, count_if(shift > 3) as movers, max(shift) as largest_swing, (select game_id from edition_b order by round(abs(deserved_margin - actual_margin), 9) desc, game_id desc limit 1) as largest_game,
   median(shift) as median_shift, count_if({_SIGN}) / cast(count(*) as double) as sign_flip_share from (select *, abs(deserved_margin - actual_margin) as shift, {_b('dtw_home', 'actual_margin')} as b from edition_b)""", "edition_b")
def c02(t):
    return CM.headline(t.edition_b)


@query("c03_bucket_transitions", "bucket_a:s bucket_b:s games:i", "select bucket_a, bucket_b, count(*) as games from pairs_ab group by all", "pairs_ab")
def c03(t):
    return CM.transitions(pairs(t))


@query("c03_flip_comparison", "games:i bucket_moved:i sign_flips_a:i sign_flips_b:i sign_moved:i net_difference:i", f"""select count(*) as games, count_if(bucket_a <> bucket_b) as bucket_moved, count_if({_FLIP.format(d='deserved_margin_a')}) as sign_flips_a, count_if({_FLIP.format(d='deserved_margin_b')}) as sign_flips_b,
   count_if({_FLIP.format(d='deserved_margin_a')} <> {_FLIP.format(d='deserved_margin_b')}) as sign_moved, count_if({_FLIP.format(d='deserved_margin_b')}) - count_if({_FLIP.format(d='deserved_margin_a')}) as net_difference from pairs_ab""", "pairs_ab")
def c03_flips(t):
    return CM.flip_comparison(pairs(t))


_MOVE = """select '{0}' as scope, count(*) as games, avg(delta) as mean_delta, avg(abs(delta)) as mean_move, max(abs(delta)) as max_move, avg((dtw_high_b - dtw_low_b) - (dtw_high_a - dtw_low_a)) as mean_widening, median(abs(delta)) as median_move,
   quantile_cont(abs(delta), 0.89) as p89_move, median((dtw_high_b - dtw_low_b) - (dtw_high_a - dtw_low_a)) as median_widening from pairs_ab where {1}"""


@query("c04_movement_report", "scope:s games:i mean_delta:d mean_move:d max_move:d mean_widening:d median_move:d p89_move:d median_widening:d", _MOVE.format("all", "true") + " union all " + _MOVE.format("affected", "extra > 0"), "pairs_ab")
def c04(t):
    return CM.movement(pairs(t), F.col("extra") > 0)


@query("c05_flip_definitions", "games:i sign_flips:i share_flips:i both:i sign_only:i share_only:i in_band:i disagree_in_band:i disagree_outside:i", f"""select count(*) as games, count_if(s) as sign_flips, count_if(d) as share_flips, count_if(s and d) as both, count_if(s and not d) as sign_only, count_if(d and not s) as share_only, count_if(band) as in_band,
   count_if(band and s <> d) as disagree_in_band, count_if(not band and s <> d) as disagree_outside from (select {_SIGN} as s, {_SHARE} as d, dtw_home between 0.4 and 0.6 as band from edition_b)""", "edition_b")
def c05(t):
    return CM.flip_definitions(t.edition_b)


@query("c06_band_sweep", "half_width:d too_close:i holds:i clear_flip:i disagreements:i", """select w as half_width, count_if(i) as too_close, count_if(not i and not d) as holds, count_if(not i and d) as clear_flip, count_if(not i and actual_margin <> 0 and s <> d) as disagreements from (
   select *, abs(dtw_home - 0.5) <= w + 1e-12 as i, (deserved_margin > 0) <> (actual_margin > 0) as s, (dtw_home > 0.5) <> (actual_margin > 0) as d from edition_b, (values (0.0), (0.05), (0.1), (0.15), (0.2)) v(w)) group by w""", "edition_b")
def c06(t):
    return CM.band_sweep(t.edition_b, (0.0, 0.05, 0.1, 0.15, 0.2))


_NOISE = "edition_a a join edition_b b on b.game_id = a.game_id join (select game_id, dtw_home + (cast('0x' || substr(md5(concat('7:', game_id)), 1, 13) as bigint) / 4503599627370496e0 - 0.5) * 0.01 as z from edition_a) n on n.game_id = a.game_id"


@query("c07_edition_delta", "games:i mean_move:d max_move:d mean_signed:d side_flips:i mean_noise:d median_move:d median_noise:d", f"""select count(*) as games, avg(abs(b.dtw_home - a.dtw_home)) as mean_move, max(abs(b.dtw_home - a.dtw_home)) as max_move, avg(b.dtw_home - a.dtw_home) as mean_signed, count_if((b.dtw_home > 0.5) <> (a.dtw_home > 0.5)) as side_flips,
   avg(abs(z - a.dtw_home)) as mean_noise, median(abs(b.dtw_home - a.dtw_home)) as median_move, median(abs(z - a.dtw_home)) as median_noise from {_NOISE}""", "edition_a edition_b")
def c07(t):
    noise = t.edition_a.withColumn("dtw_home", F.col("dtw_home") + (uniform(digest(7, F.col("game_id"))) - 0.5) * 0.01)
    return CM.edition_delta(t.edition_a, t.edition_b, noise)


_STATS = "select 'games' as statistic, cast(count(*) as double) as value from {0} union all select 'mean luck', avg(total_luck_epa) from {0} union all select 'events', cast(sum(n_luck_events) as double) from {0}"


@query("c08_published_vs_rerun", "statistic:s published:d rerun:d off:i", f"select p.statistic, p.value as published, r.value as rerun, cast(abs(p.value - r.value) > 0.5 as int) as off from ({_STATS.format('edition_a')}) p join ({_STATS.format('edition_b')}) r on r.statistic = p.statistic", "edition_a edition_b")
def c08(t):
    def stats(e):
        names = ("games", "mean luck", "events")
        return e.agg(F.count(F.lit(1)).cast("double").alias(names[0]), F.avg("total_luck_epa").alias(names[1]), F.sum("n_luck_events").cast("double").alias(names[2])).unpivot([], list(names), "statistic", "value")
    return CM.reconcile(stats(t.edition_a), stats(t.edition_b), 0.5)


@query("c09_give_back", "game_id:s share_proxy:d still:i bitten:i", f"""with c as (select game_id, sum(-reduction_epa) as cap_row_epa, max(bites_ever) as bitten from luck_drives group by 1),
   m as (select p.*, coalesce(c.bitten, 0) as bitten, dtw_home_a + (1 - case when abs(deserved_margin_b - deserved_margin_a) > 1e-12 then least(abs(coalesce(cap_row_epa, 0) * 0.8389) / abs(deserved_margin_b - deserved_margin_a), 1) else 0 end) * delta as share_proxy from pairs_ab p left join c on c.game_id = p.game_id where bucket_a <> bucket_b)
   select game_id, share_proxy, bitten, cast(bucket_a <> {_b('share_proxy', 'actual_margin')} as int) as still from m""", "pairs_ab luck_drives")
def c09(t):
    per = t.luck_drives.groupBy("game_id").agg(F.sum(-F.col("reduction_epa")).alias("cap_row_epa"), F.max("bites_ever").alias("bitten"))
    return CM.give_back(pairs(t), per)


@query("c10_edition_description", "games:i mean_shift:d disagreements:i mean_width:d events_per_game:d", f"select count(*) as games, avg(abs(deserved_margin - actual_margin)) as mean_shift, count_if({_SHARE}) as disagreements, avg(dtw_high - dtw_low) as mean_width, avg(n_luck_events) as events_per_game from edition_b", "edition_b")
def c10(t):
    return CM.describe(t.edition_b)


@query("c11_ledgers_by_component", "component:s n_a:i expected_a:d luck_a:d n_b:i expected_b:d luck_b:d", """select coalesce(a.component, b.component) as component, n_a, expected_a, luck_a, n_b, expected_b, luck_b from (select component, count(*) as n_a, avg(expected) as expected_a, sum(luck_epa) as luck_a from strict group by 1) a
   full join (select component, count(*) as n_b, avg(expected) as expected_b, sum(luck_epa) as luck_b from ledger group by 1) b on a.component = b.component""", "strict ledger")
def c11(t):
    return CM.ledgers_by_component(t.strict, t.ledger)


@query("c11_expectation_shift", "component:s roof:s rows:i mean_shift:d moved:i", """select a.component, r.roof, count(*) as rows, avg(b.expected - a.expected) as mean_shift, count_if(abs(b.expected - a.expected) > 1e-9) as moved from strict a join ledger b on b.component = a.component and b.game_id = a.game_id and b.play_id = a.play_id
   join (select game_id, max(roof) as roof from pbp group by 1) r on r.game_id = a.game_id group by all""", "strict ledger pbp")
def c11_shift(t):
    return CM.expectation_shift(t.strict, t.ledger, t.pbp.select("game_id", "roof"))


@query("c12_materiality", "median_move:d median_half_width:d material:i", "select median(abs(delta)) as median_move, median((dtw_high_a - dtw_low_a) / 2) as median_half_width, cast(median(abs(delta)) >= median((dtw_high_a - dtw_low_a) / 2) as int) as material from pairs_ab where extra > 0", "pairs_ab")
def c12(t):
    return CM.materiality(pairs(t), F.col("extra") > 0)


shared("flat", "ledger", "select * replace (sign(swing) * (select avg(abs(swing)) from ledger) as swing, (actual - expected) * sign(swing) * (select avg(abs(swing)) from ledger) as luck_epa) from ledger")
shared("edition_f", "flat games", edition_sql("flat"))
shared("capped", "ledger", "select * replace (sign(swing) * least(abs(swing), (select quantile_cont(abs(swing), 0.9) from ledger)) as swing, (actual - expected) * sign(swing) * least(abs(swing), (select quantile_cont(abs(swing), 0.9) from ledger)) as luck_epa) from ledger")


def flat_edition(t):
    mean = t.ledger.agg(F.avg(F.abs("swing"))).scalar()
    flat = t.ledger.withColumn("swing", F.signum("swing") * mean)
    return L.edition(flat.withColumn("luck_epa", (F.col("actual") - F.col("expected")) * F.col("swing")), t.games)


@query("c13_moved_overlap", "both:i only_left:i only_right:i jaccard:d", f"""select sum(l * r) as both, sum(l * (1 - r)) as only_left, sum((1 - l) * r) as only_right, coalesce(sum(l * r) / nullif(cast(sum(greatest(l, r)) as double), 0), 1) as jaccard from (
   select cast({_b('a.dtw_home', 'a.actual_margin')} <> {_b('b.dtw_home', 'a.actual_margin')} as int) as l, cast({_b('a.dtw_home', 'a.actual_margin')} <> {_b('f.dtw_home', 'a.actual_margin')} as int) as r from edition_a a join edition_b b on b.game_id = a.game_id join edition_f f on f.game_id = a.game_id)""", "edition_a edition_b edition_f")
def c13(t):
    return CM.moved_overlap(pairs(t), CM.paired(t.edition_a, flat_edition(t)))


@query("c14_capped_swing", "component:s n:i luck:d max_swing:d", "select component, count(*) as n, sum(luck_epa) as luck, max(abs(swing)) as max_swing from capped group by component", "capped")
def c14(t):
    rows = t.ledger.withColumn("size", F.abs("swing"))
    cap = quantile_row(rows, {"cap": ("size", 0.9)}).scalar()
    return L.capped_swing(t.ledger, cap).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("luck_epa").alias("luck"), F.max(F.abs("swing")).alias("max_swing"))


@query("c15_edition_summary", "game_id:s home_team:s away_team:s actual_margin:d deserved_margin:d dtw_home:d", "select e.game_id, g.home_team, g.away_team, e.actual_margin, e.deserved_margin, e.dtw_home from edition_b e join games g on g.game_id = e.game_id", "edition_b games")
def c15(t):
    """Teams joined on; the schedule's margin must agree with the edition's."""
    joined = t.edition_b.join(t.games.select("game_id", "home_team", "away_team", "margin"), "game_id")
    return guarded(joined, F.abs(F.col("margin") - F.col("actual_margin")) > 1e-9, F.concat(F.lit("actual margins differ for "), F.col("game_id")))


_U16 = "cast('0x' || substr(md5(concat('16:', game_id, ':', cast(cast(play_id as bigint) as varchar))), 1, 13) as bigint) / 4503599627370496e0"


@query("c16_assumption_sweep", "f:d games:i luck:d mean_abs_luck:d", f"""select f, count(*) as games, sum(l) as luck, avg(abs(l)) as mean_abs_luck from (select f, game_id, sum(luck_epa) as l from ledger, (values (0.0), (0.25), (0.5), (1.0)) v(f) where component <> 'fumble' or {_U16} < f group by all) group by f""", "ledger")
def c16(t):
    """A share f of one component's rows kept, by hash; each f re-priced per contest."""
    swept = t.ledger.withColumn("f", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)])))
    u = uniform(digest(16, F.col("game_id"), F.col("play_id").cast("long")))
    per = swept.filter((F.col("component") != "fumble") | (u < F.col("f"))).groupBy("f", "game_id").agg(F.sum("luck_epa").alias("l"))
    return per.groupBy("f").agg(F.count(F.lit(1)).alias("games"), F.sum("l").alias("luck"), F.avg(F.abs("l")).alias("mean_abs_luck"))


@query("c17_arms_side_by_side", "games:i mean_left:d mean_right:d r:d share_cancelling:d", """select count(*) as games, avg(abs(l)) as mean_left, avg(abs(x)) as mean_right, corr(l, x) as r, avg(cast(l * x < -1e-15 as int)) as share_cancelling from (
   select b.dtw_home - a.dtw_home as l, f.dtw_home - a.dtw_home as x from edition_a a join edition_b b on b.game_id = a.game_id join edition_f f on f.game_id = a.game_id)""", "edition_a edition_b edition_f")
def c17(t):
    wide = CM.arms_side_by_side({"full": CM.paired(t.edition_a, t.edition_b), "flat": CM.paired(t.edition_a, flat_edition(t))})
    return CM.arms_report(wide, "full", "flat")


__all__ = ["C", "pairs"]

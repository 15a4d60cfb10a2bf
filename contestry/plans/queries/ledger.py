"""Class tables, the ledger, luck drives, swing tables and their resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.functions import plays as P
from contestry.functions.columns import ratio
from contestry.functions.counters import counted_sql, lanes_sql, uniform_sql
from contestry.operators import kicks as K
from contestry.operators import ledger as L
from contestry.operators import quality as Q
from contestry.operators.joins import side_by_side
from contestry.operators.ranking import quantile_row
from contestry.plans.catalogue import query
from contestry.plans.oracle_tables import phi, shared
from contestry.plans.queries.filters import CELL_SQL, charted_passes
from contestry.session import cut_lineage


def _class_sql(rows: str, klass: str, outcome: str, epa: str) -> str:
    return f"""select {klass}, n, case when n >= 30 then p_own else pp end as p, coalesce(w, pw) as epa_won, coalesce(l, pl) as epa_lost, coalesce(w, pw) - coalesce(l, pl) as swing_value
    from (select {klass}, count(*) as n, avg({outcome}) as p_own, avg({epa}) filter (where {outcome} = 1) as w, avg({epa}) filter (where {outcome} = 0) as l from {rows} group by 1),
    (select avg({outcome}) as pp, avg({epa}) filter (where {outcome} = 1) as pw, avg({epa}) filter (where {outcome} = 0) as pl from {rows})"""


shared("eligible", "blocked live_fumbles", "select * from blocked o where not exists (select 1 from live_fumbles f where f.game_id = o.game_id and f.play_id = o.play_id)")
shared("field_goals", "kicks", "select *, concat('fg/', cast(cast(floor(distance / 5) * 5 as int) as varchar)) as kick_class from kicks where is_xp = 0 and (field_goal_result is null or field_goal_result <> 'blocked') and field_goal_result is not null")
shared("class_fumble", "all_fumbles", _class_sql("all_fumbles", "fumble_class", "retained", "epa_fumbler"))
shared("class_live", "live_fumbles", _class_sql("live_fumbles", "fumble_class", "retained", "epa_fumbler"))
shared("class_blocked", "eligible", _class_sql("eligible", "kick_class", "retained", "epa_kicker"))
shared("class_fg", "field_goals", _class_sql("field_goals", "kick_class", "made", "epa"))


def _ledger_sql(rows: str, table: str, component: str, klass: str, outcome: str, team: str) -> str:
    return f"""select '{component}' as component, r.game_id, r.play_id, r.season, r.{klass} as event_class, r.{team} as charged_team, cast(r.{outcome} as double) as actual, c.p as expected, c.n as class_n,
      c.swing_value * case when r.{team} = r.home_team then 1e0 else -1e0 end as swing,
      (r.{outcome} - c.p) * c.swing_value * case when r.{team} = r.home_team then 1e0 else -1e0 end as luck_epa
    from {rows} r join {table} c on c.{klass} = r.{klass} where c.p is not null and c.swing_value is not null"""


_FG = _ledger_sql("field_goals", "class_fg", "field_goal", "kick_class", "made", "posteam")
shared("ledger", "all_fumbles eligible field_goals class_fumble class_blocked class_fg", " union all ".join([
    _ledger_sql("all_fumbles", "class_fumble", "fumble", "fumble_class", "retained", "fumbled_1_team"),
    _ledger_sql("eligible", "class_blocked", "blocked", "kick_class", "retained", "kicking_team"), _FG]))
shared("strict", "live_fumbles field_goals class_live class_fg", " union all ".join([
    _ledger_sql("live_fumbles", "class_live", "fumble", "fumble_class", "retained", "fumbled_1_team"), _FG]))


def edition_sql(ledger: str) -> str:
    return f"""select *, {phi('(deserved_margin / 5.4528e0)')} as dtw_home, {phi('((deserved_margin - 1.5982e0 * sd) / 5.4528e0)')} as dtw_low,
      {phi('((deserved_margin + 1.5982e0 * sd) / 5.4528e0)')} as dtw_high
    from (select g.game_id, g.season, g.margin as actual_margin, coalesce(luck, 0) as total_luck_epa, coalesce(n, 0) as n_luck_events,
      sqrt(coalesce(v, 0)) * 0.8389e0 as sd, g.margin - coalesce(luck, 0) * 0.8389e0 as deserved_margin
    from games g left join (select game_id, sum(luck_epa) as luck, count(*) as n, sum(expected * (1 - expected) * swing * swing) as v from {ledger} group by game_id) l on l.game_id = g.game_id
    where g.margin is not null)"""


shared("edition_a", "strict games", edition_sql("strict"))
shared("edition_b", "ledger games", edition_sql("ledger"))
CT = "n:i p:d epa_won:d epa_lost:d swing_value:d"


@query("f30_fumble_class_table", f"fumble_class:s {CT}", "select * from class_fumble", "class_fumble")
def f30(t):
    return L.class_table(L.all_fumbles(t.pbp), "fumble_class", "retained", "epa_fumbler")


@query("f30_onside_class_table", f"onside_class:s {CT}", _class_sql("onside", "onside_class", "recovered", "epa_kicker"), "onside")
def f30_onside(t):
    return L.class_table(P.onside_frame(t.pbp), "onside_class", "recovered", "epa_kicker")


@query("f31_screen_value", "kick_class:s n:i screen_epa:d weighted_screen:d", """select kick_class, n, p * (1 - p) * swing_value as screen_epa,
   sum(n * p * (1 - p) * swing_value) over () / sum(n) over () as weighted_screen from class_blocked""", "class_blocked")
def f31(t):
    table = L.class_table(L.eligible_blocks(t.pbp), "kick_class", "retained", "epa_kicker").withColumn(
        "screen_epa", F.col("p") * (F.lit(1.0) - F.col("p")) * F.col("swing_value"))
    mean = table.agg(ratio(F.sum(F.col("n") * F.col("screen_epa")), F.sum("n"))).scalar()
    return table.withColumn("weighted_screen", mean)


@query("f31_luck_by_component", "component:s positive:i n:i mean_abs_luck:d", "select component, cast(actual = 1 as int) as positive, count(*) as n, avg(abs(luck_epa)) as mean_abs_luck from ledger group by all", "ledger")
def f31_luck(t):
    return t.ledger.groupBy("component", (F.col("actual") == 1).cast("int").alias("positive")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("luck_epa")).alias("mean_abs_luck"))


def _swing_sql(rows: str, outcome: str) -> str:
    return f"""select y as yard_bin, d as down_bin, coalesce(n_yes, 0) as n_yes, coalesce(n_no, 0) as n_no, mean_yes, mean_no,
      case when coalesce(n_yes, 0) < 30 or coalesce(n_no, 0) < 30 then py - pn else mean_yes - mean_no end as swing,
      case when coalesce(n_yes, 0) < 30 or coalesce(n_no, 0) < 30 then pn else mean_no end as no_mean, py - pn as pooled,
      case when coalesce(n_yes, 0) < 30 or coalesce(n_no, 0) < 30 then 'pooled' else 'cell' end as source
    from (values ('1-33'), ('34-66'), ('67-99')) a(y), (values ('1-2'), ('3-4')) b(d),
      (select avg(epa) filter (where {outcome} = 1) as py, avg(epa) filter (where {outcome} = 0) as pn from {rows}) pooled_
    left join (select {CELL_SQL} as cell, count_if({outcome} = 1) as n_yes, count_if({outcome} = 0) as n_no, avg(epa) filter (where {outcome} = 1) as mean_yes,
      avg(epa) filter (where {outcome} = 0) as mean_no from {rows} group by 1) c on c.cell = concat(y, '|', d)"""


shared("worthy", "charted", "select * from charted where is_interception_worthy")
shared("catchable", "charted", "select *, cast(not is_drop as int) as caught from charted where is_catchable_ball")
shared("catch_swing", "catchable", _swing_sql("catchable", "caught"))
SW = "yard_bin:s down_bin:s n_yes:i n_no:i mean_yes:d mean_no:d swing:d pooled:d source:s"


@query("f32_pick_swing_table", SW, _swing_sql("worthy", "interception"), "worthy")
def f32(t):
    rows = charted_passes(t).filter("is_interception_worthy")
    return L.swing_table(rows, "interception")


@query("f32_sign_guard", SW, f"select * from ({_swing_sql('worthy', 'interception')}) where swing >= 0", "worthy")
def f32_guard(t):
    return L.sign_guard(f32(t), positive=False)


def _catchable(t):
    """Catchable passes with what a swing is made of; the table, its pooled row and the plays read them, so they are joined once."""
    rows = charted_passes(t).filter("is_catchable_ball").withColumn("caught", (~F.col("is_drop")).cast("int"))
    return cut_lineage(rows.select("game_id", "play_id", "epa", "yardline_100", "down", "air_epa", "xyac_epa", "is_drop", "caught"))


_PLAY_SWING = f"""select k.*, case when air_epa is null and xyac_epa is null then 'bin_both_null' when air_epa is null or xyac_epa is null then 'bin_xyac_only_null' when {CELL_SQL} is null then 'bin_no_cell' else 'per_play' end as reason,
   case when air_epa is not null and xyac_epa is not null then abs(air_epa + xyac_epa - case when is_drop then epa else no_mean end) else coalesce(swing, (select max(pooled) from catch_swing)) end as play_swing
   from catchable k left join catch_swing c on concat(c.yard_bin, '|', c.down_bin) = {CELL_SQL}"""


@query("f33_per_play_swing", "game_id:s play_id:d reason:s play_swing:d", _PLAY_SWING, "catchable catch_swing")
def f33(t):
    rows = _catchable(t)
    return L.per_play_swing(rows, L.swing_table(rows, "caught"))


@query("f33_fallback_counts", "reason:s n:i mean_swing:d max_swing:d", f"select reason, count(*) as n, avg(play_swing) as mean_swing, max(play_swing) as max_swing from ({_PLAY_SWING}) group by reason", "catchable catch_swing")
def f33_counts(t):
    return f33(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.avg("play_swing").alias("mean_swing"), F.max("play_swing").alias("max_swing"))


@query("m09_luck_ledger", "component:s game_id:s play_id:d event_class:s charged_team:s actual:d expected:d swing:d luck_epa:d", "select * from ledger", "ledger")
def m09(t):
    return t.ledger


@query("m09_dialled_ledger", "game_id:s play_id:d expected:d luck_epa:d", f"""with c as ({_class_sql('eligible', 'kick_class', 'retained', 'epa_kicker')}),
   o as (select season, kicking_team, avg(retained) as own from eligible group by all),
   j as (select e.*, 0.3 * own + 0.7 * c.p as x, c.swing_value * case when e.kicking_team = e.home_team then 1 else -1 end as s from eligible e join c on c.kick_class = e.kick_class join o on o.season = e.season and o.kicking_team = e.kicking_team)
   select game_id, play_id, x as expected, (retained - x) * s as luck_epa from j""", "eligible")
def m09_dial(t):
    rows = L.eligible_blocks(t.pbp)
    table = L.class_table(rows, "kick_class", "retained", "epa_kicker")
    return L.ledger_rows(rows, table, "blocked", "kick_class", "retained", "kicking_team", dial=0.3)


ED = "game_id:s actual_margin:d deserved_margin:d dtw_home:d dtw_low:d dtw_high:d total_luck_epa:d n_luck_events:i"


@query("m09_game_summary", ED, "select * from edition_b", "edition_b")
def m09_games(t):
    return t.edition_b


#: Replicates of the replayed win share and of the expected clip.
REPLAYS = 2000


_EVENT = "concat(component, '|', cast(cast(play_id as bigint) as varchar))"
_CLASS = "concat(component, '|', event_class)"
_TOSS = lanes_sql("toss", f"concat('0:', game_id, ':', {_EVENT})")


@query("m10_replayed_share", "game_id:s dtw_home:d deserved_mean:d low:d high:d", f"""with k as (select l.game_id, margin, actual, swing, (expected * class_n + 0.5e0) / (class_n + 1e0) as mn, class_n,
     {lanes_sql("toss", f"concat('0:', l.game_id, ':', {_EVENT})")}, {lanes_sql("rate", f"concat('rate:0:', {_CLASS})")}, {lanes_sql("turn", f"concat('turn:0:', {_CLASS})")} from ledger l join games g on g.game_id = l.game_id where margin is not null),
   d as (select game_id, margin, rep, actual, swing, mn, class_n, {uniform_sql("toss")}, {uniform_sql("rate")}, {uniform_sql("turn")} from k, {counted_sql(REPLAYS)}),
   c as (select game_id, margin, rep, (actual - case when toss < least(greatest(mn + sqrt(-2e0 * ln(greatest(rate, 1e-12))) * cos(6.283185307179586e0 * turn) * sqrt(mn * (1 - mn) / (class_n + 2e0)), 0), 1) then 1e0 else 0e0 end) * swing * 0.8389e0 as m from d),
   s as (select game_id, rep, any_value(margin) - sum(m) as deserved from c group by all)
   select game_id, avg(case when round(deserved, 9) > 0 then 1e0 else 0e0 end) as dtw_home, avg(deserved) as deserved_mean, quantile_cont(deserved, 0.055) as low, quantile_cont(deserved, 0.945) as high from s group by 1""", "ledger games")
def m10(t):
    return L.replicate_share(t.ledger, t.games, REPLAYS)


@query("m10_exact_share", "game_id:s dtw_home:d deserved_mean:d deserved_sd:d coins:i replays_ok:i", """with recursive e as (select l.game_id, margin, row_number() over (partition by l.game_id order by component, play_id) as k, count(*) over (partition by l.game_id) as n,
     actual * swing * 0.8389e0 as up, (actual - 1) * swing * 0.8389e0 as down, (expected * class_n + 0.5e0) / (class_n + 1e0) as p from ledger l join games g on g.game_id = l.game_id where margin is not null),
   s as (select distinct game_id, 0::bigint as k, 0e0 as v, 1e0 as w from e union all
     select game_id, k, v, sum(w) as w from (select s.game_id, e.k, round(s.v + x.step, 9) as v, s.w * x.w as w from s join e on e.game_id = s.game_id and e.k = s.k + 1,
       lateral (select e.up as step, 1 - e.p as w union all select e.down, e.p) x) group by all),
   f as (select s.game_id, n, margin - v as d, w from s join e on e.game_id = s.game_id and e.k = s.k and s.k = n), m as (select game_id, sum(d * w) as mean from f group by 1)
   select f.game_id, coalesce(sum(w) filter (round(d, 9) > 0), 0) as dtw_home, any_value(mean) as deserved_mean, sqrt(sum((d - mean) * (d - mean) * w)) as deserved_sd, any_value(n) as coins, 1 as replays_ok from f join m on m.game_id = f.game_id group by f.game_id""", "ledger games")
def m10_exact(t):
    """The share over all outcomes; 2,000 replays, which draw the rates too, come within a twelfth of it."""
    replayed = L.replicate_share(t.ledger, t.games, REPLAYS).select("game_id", F.col("dtw_home").alias("replayed"))
    return L.exact_share(t.ledger, t.games).join(replayed, "game_id").withColumn("replays_ok", (F.abs(F.col("dtw_home") - F.col("replayed")) <= 1 / 12).cast("int"))


shared("driven", "ledger pbp", """select l.*, p.fixed_drive, p.qtr, p.posteam, coalesce(cast(cast(p.fixed_drive as bigint) as varchar), concat('no-drive:', cast(cast(l.play_id as bigint) as varchar))) as drive_key
   from ledger l left join pbp p on p.game_id = l.game_id and p.play_id = l.play_id""")
shared("luck_drives", "driven", """select *, greatest(pos_swing, -neg_swing) as max_attainable, greatest(least(signed_luck, cap), -cap) as clipped_luck, cast(round(sum_abs_luck - cap, 9) > 0 as int) as bites_prereg,
   cast(round(abs(signed_luck) - cap, 9) > 0 as int) as bites_point_estimate, cast(round(greatest(pos_swing, -neg_swing) - cap, 9) > 0 as int) as bites_ever, signed_luck - greatest(least(signed_luck, cap), -cap) as reduction_epa from (
   select game_id, drive_key, count(*) as n_events, sum(abs(luck_epa)) as sum_abs_luck, sum(luck_epa) as signed_luck, max(abs(swing)) as cap, sum(greatest((2 * actual - 1) * swing, 0)) as pos_swing,
     sum(least((2 * actual - 1) * swing, 0)) as neg_swing, min(qtr) as qtr, arg_min(posteam, play_id) as posteam, count(distinct posteam) as n_posteams, string_agg(distinct component, ',' order by component) as components from driven group by all)""")


@query("f51_luck_drives", "game_id:s drive_key:s n_events:i sum_abs_luck:d signed_luck:d cap:d pos_swing:d neg_swing:d clipped_luck:d bites_prereg:i bites_point_estimate:i bites_ever:i reduction_epa:d posteam:s n_posteams:i components:s",
       "select * from luck_drives", "luck_drives")
def f51(t):
    return t.luck_drives


@query("f52_events_per_drive", "n_events:i drives:i share_of_drives:d share_of_events:d", """select n_events, count(*) as drives, cast(count(*) as double) / sum(count(*)) over () as share_of_drives, cast(count(*) * n_events as double) / sum(count(*) * n_events) over () as share_of_events
   from luck_drives group by n_events""", "luck_drives")
def f52(t):
    hist = t.luck_drives.groupBy("n_events").agg(F.count(F.lit(1)).alias("drives"))
    total = hist.agg(F.struct(F.sum("drives").alias("d"), F.sum(F.col("drives") * F.col("n_events")).alias("e"))).scalar()
    return hist.withColumns({"share_of_drives": ratio("drives", total["d"]), "share_of_events": ratio(F.col("drives") * F.col("n_events"), total["e"])})


@query("m11_expected_clip", "game_id:s drive_key:s cap_row_epa:d expected_abs_clip_epa:d clipped:i", f"""with k as (select game_id, drive_key, abs(actual - expected) as q, (2 * actual - 1) * swing as s, {_TOSS} from driven),
   d as (select game_id, drive_key, rep, q, s, {uniform_sql("toss")} from k, {counted_sql(REPLAYS)}), c as (select game_id, drive_key, rep, sum(case when toss < q then s else 0 end) as total from d group by all),
   e as (select c.*, round(total - greatest(least(total, cap), -cap), 9) as x from c join luck_drives d on d.game_id = c.game_id and d.drive_key = c.drive_key)
   select game_id, drive_key, avg(-x) as cap_row_epa, avg(abs(x)) as expected_abs_clip_epa, max(cast(abs(x) > 1e-9 as int)) as clipped from e group by all""", "driven luck_drives")
def m11(t):
    driven = L.with_drive_key(t.ledger, t.pbp)
    return L.expected_clip(driven, t.luck_drives, REPLAYS).withColumnRenamed("clipped_in_the_draw", "clipped")


@query("v13_ledger_checks", "component:s rows:i expected:d actual:d duplicates:i lost:i", """select 'blocked' as component, count(*) as rows, sum(expected) as expected, sum(actual) as actual,
   (select count(*) from (select 1 from ledger where component = 'blocked' group by game_id, play_id having count(*) > 1)) as duplicates,
   (select count(*) from eligible e where not exists (select 1 from ledger l where l.component = 'blocked' and l.game_id = e.game_id and l.play_id = e.play_id)) as lost from ledger where component = 'blocked'""", "ledger eligible")
def v13(t):
    return Q.ledger_checks(t.ledger, L.eligible_blocks(t.pbp), "blocked")


_PART = "select game_id, sum(case when component = 'fumble' then luck_epa else 0 end) as f, sum(case when component = 'blocked' then luck_epa else 0 end) as b, sum(case when component = 'field_goal' then luck_epa else 0 end) as g, sum(luck_epa) as total from {0} group by game_id"


def _parts(led):
    part = lambda c: F.sum(F.when(F.col("component") == c, F.col("luck_epa")).otherwise(0.0))
    return led.groupBy("game_id").agg(part("fumble").alias("f"), part("blocked").alias("b"), part("field_goal").alias("g"), F.sum("luck_epa").alias("total"))


@query("v14_partition_identity", "rows:i max_before:d max_after:d holds:i", f"""select count(*) as rows, max(abs(a.f + a.b + a.g - a.total)) as max_before, max(abs(z.f + z.b + z.g - z.total)) as max_after,
   cast(max(abs(a.f + a.b + a.g - a.total)) <= 1e-9 and max(abs(z.f + z.b + z.g - z.total)) <= 1e-9 as int) as holds
   from ({_PART.format('strict')}) a join ({_PART.format('ledger')}) z on z.game_id = a.game_id""", "strict ledger")
def v14(t):
    return Q.partition_residual(_parts(t.strict), _parts(t.ledger), "game_id", ["f", "b", "g"], "total")


__all__ = ["K", "quantile_row", "side_by_side"]

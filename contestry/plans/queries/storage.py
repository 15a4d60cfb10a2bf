"""Sources, sinks, validation and streaming, each written, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions import plays as P
from contestry.functions.columns import normal_cdf
from contestry.operators import joins as J
from contestry.operators import kicks as K
from contestry.operators import posterior as B
from contestry.operators import quality as Q
from contestry.plans.catalogue import query
from contestry.plans.oracle_tables import modern
from contestry.plans.queries.model import _PAIRS, _TRAIN, _fit_sql
from contestry.session import cut_lineage, ensure_checkpoint_dir
from contestry.sources import seasons as S
from contestry.streaming import readiness as R


def scratch(t, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _stored(t, columns=("season", "week", "game_id", "play_id", "posteam", "defteam", "home_team", "away_team", "play_type",
                        "season_type", "epa", "success", "yards_gained", "interception", "fumble_lost", "two_point_attempt")):
    root = scratch(t, "seasons")
    S.write_season(t.pbp.select(*columns), root, "pbp")
    return root


@query("s01_load_seasons", "season:i plays:i contests:i epa:d", "select season, count(*) as plays, count(distinct game_id) as contests, sum(epa) as epa from pbp where season in (2017, 2020, 2024) group by season", "pbp")
def s01(t):
    df = S.load_seasons(t.spark, _stored(t), "pbp", [2017, 2020, 2024], ["season", "game_id", "epa"])
    per = df.groupBy("season", "game_id").agg(F.count(F.lit(1)).alias("n"), F.sum("epa").alias("e"))
    return per.groupBy("season").agg(F.sum("n").alias("plays"), F.count(F.lit(1)).alias("contests"), F.sum("e").alias("epa"))


@query("s02_load_charting", "season:i n:i drops:i", "select season, count(*) as n, count_if(is_drop) as drops from charting group by season", "charting")
def s02(t):
    root = scratch(t, "charting")
    S.write_season(t.charting, root, "ftn")
    df = S.load_seasons(t.spark, root, "ftn", list(S.cached_seasons(t.spark, root, "ftn", C.CHARTING_SEASONS)), ["season", "is_drop"])
    return df.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_drop").alias("drops"))


@query("s03_charting_if_cached", "season:i n:i", "select season, count(*) as n from charting where season in (2022, 2023) group by season", "charting")
def s03(t):
    root = scratch(t, "charting")
    S.write_season(t.charting.filter("season <= 2023"), root, "ftn")
    assert S.load_if_cached(t.spark, root, "ftn", [2030]) is None
    return S.load_if_cached(t.spark, root, "ftn", [2021, 2022, 2023, 2024]).groupBy("season").agg(F.count(F.lit(1)).alias("n"))


def _schedules(t):
    root = scratch(t, "schedules")
    S.write_season(t.schedule, root, "schedules")
    return root


@query("s04_read_schedule", "season:i game_id:s home_score:i", "select season, game_id, home_score from schedule", "schedule")
def s04(t):
    return S.load_schedule(t.spark, _schedules(t))


@query("s05_schedule_row", "game_id:s home_team:s home_score:i", "select game_id, home_team, home_score from schedule where game_id = (select max(game_id) from schedule)", "schedule")
def s05(t):
    root = _schedules(t)
    last = t.schedule.agg(F.max("game_id").alias("g")).first().g
    assert S.schedule_row(t.spark, root, "absent") == {}
    row = S.schedule_row(t.spark, root, last)
    return t.spark.createDataFrame([(row["game_id"], row["home_team"], row["home_score"])], "game_id string, home_team string, home_score int")


@query("s06_refresh_schedule", "season:i n:i home_points:i", "select season, count(*) as n, sum(case when season in (2019, 2021) then home_score + 1 else home_score end) as home_points from schedule where season <> 2022 group by season", "schedule")
def s06(t):
    """2022 is asked for and has no fresh row, so none of its rows may stay."""
    root = _schedules(t)
    S.refresh_schedule(t.schedule.filter("season <> 2022").withColumn("home_score", F.col("home_score") + 1), root, [2019, 2021, 2022])
    return S.load_schedule(t.spark, root).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("home_score").alias("home_points"))


_NEED = [c for c in C.PLAY_REQUIRED]


def _gate_sql(name: str, rows: str, live: bool) -> str:
    """What the gate says of each season in ``rows``, as ``<name>``: rows, contests, errors, warnings."""
    shortfall = "and games > want" if live else ""
    short = "printf('too short: %d contests under 90 plays (the least is %s, %d)', short::bigint, least.b, least.a)"
    return f"""{name}_g as (select season, game_id, count(*) as n, count_if(re) as re, count_if(re and epa is null) as ne, count_if(re and posteam is null) as np, count_if(fumble = 1) as fu,
     count_if(spread_line is null) as ns, count_if(fg) as fg, count_if(fg and kick_distance is null) as nd
     from (select *, coalesce(play_type in ('pass','run','punt','field_goal','extra_point','kickoff'), false) as re, coalesce(play_type = 'field_goal', false) as fg from {rows}) group by all),
   {name}_t as (select season, sum(n)::bigint as n, count(*) as games, sum(re) as re, sum(ne) as ne, sum(np) as np, sum(fu) as fu, sum(ns) as ns, sum(fg) as fg, sum(nd) as nd, count_if(n < 90) as short,
     min(struct_pack(a := n, b := game_id)) filter (n < 90) as least, count_if(n > 300) as long, max(struct_pack(a := n, b := game_id)) filter (n > 300) as most,
     (select count(*) from schedule s where s.season = {name}_g.season) as want from {name}_g group by season),
   {name} as (select season, n, games, list_filter([
     case when games <> want {shortfall} then printf('%d games, expected %d', games, want) end, {"null" if live else f"case when short > 0 then {short} end"},
     case when long > 0 then printf('too long: %d contests over 300 plays (the most is %s, %d)', long::bigint, most.b, most.a) end,
     case when re = 0 then 'not one row is a scored kind of play' end, case when ne::double / re > 0.01 then printf('epa null: %d of the %d scored plays', ne::bigint, re::bigint) end,
     case when np::double / re > 0.01 then printf('posteam null: %d of the %d scored plays', np::bigint, re::bigint) end], lambda x: x is not null) as errors, list_filter([
     {f"case when games < want then printf('season so far: %d games, a full one has %d', games, want) end, case when short > 0 then {short} end" if live else "null"},
     case when fu = 0 then 'no fumbles in any row, which no season has: look at the fumble columns' end,
     case when ns::double / n > 0.02 then printf('spread_line missing: %d of %d rows', ns::bigint, n) end,
     case when nd > 0 then printf('kick_distance missing: %d of %d field goals tried', nd::bigint, fg::bigint) end], lambda x: x is not null) as warnings from {name}_t)"""


_SAID = "case when len(errors) = 0 then array_to_string(warnings, ' | ') else concat('pbp ', season, ' failed validation: ', array_to_string(errors, '; ')) end"


def _said(report):
    text = F.when(F.col("accepted"), F.concat_ws(" | ", "warnings")).otherwise(
        F.concat(F.lit("pbp "), F.col("season").cast("string"), F.lit(" failed validation: "), F.concat_ws("; ", "errors")))
    return report.select("season", F.col("accepted").cast("int").alias("accepted"), text.alias("messages"))


def _pulled(t, name: str, weeks, **options):
    """Every season on file, as it is, through the gate, a pull for each bound on weeks (none:
    all of it): the folder, and what the gate said of the last. A season has the contests of its schedule."""
    root = scratch(t, name)
    want = t.schedule.groupBy("season").agg(F.count(F.lit(1)).alias("want"))
    rows = t.pbp.select(*_NEED, "play_id")
    for week in weeks:
        report = S.ingest_all(rows if week is None else rows.filter(F.col("week") <= week), root, expected=want, **options)
    return root, _said(report)


def _on_file(t, root: str):
    """Rows and contests of the seasons on file."""
    seasons = sorted(r.season for r in S.read_manifest(t.spark, root).select("season").collect())
    stored = S.load_if_cached(t.spark, root, "pbp", seasons)
    if stored is None:
        return t.spark.createDataFrame([], "season int, n long, contests long")
    per = stored.groupBy("season", "game_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("season").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contests"))


@query("s07_ingest_season", "season:i n:i contests:i accepted:i messages:s", f"""with {_gate_sql("whole", "pbp", False)}
   select season, case when len(errors) = 0 then n else 0 end as n, case when len(errors) = 0 then games else 0 end as contests, len(errors) = 0 as accepted, {_SAID} as messages from whole""", "pbp schedule")
def s07(t):
    root, told = _pulled(t, "ingest", [None])
    return told.join(_on_file(t, root), "season", "left").fillna(0, ["n", "contests"])


_TWICE = "with {early}, {whole}, e as (select season, n, games from early where len(errors) = 0)"


@query("s08_live_season", "season:i n:i contests:i accepted:i messages:s", _TWICE.format(early=_gate_sql("early", "(select * from pbp where week <= 2)", True), whole=_gate_sql("whole", "pbp", True)) + f"""
   select w.season, case when len(errors) = 0 then w.n else coalesce(e.n, 0) end as n, case when len(errors) = 0 then w.games else coalesce(e.games, 0) end as contests, len(errors) = 0 as accepted, {_SAID.replace("season", "w.season")} as messages
   from whole w left join e on e.season = w.season""", "pbp schedule")
def s08(t):
    """A live season's early weeks, then all of it: what is on file is the last pull that was taken."""
    root, told = _pulled(t, "live", [2, None], partial=True)
    return told.join(_on_file(t, root), "season", "left").fillna(0, ["n", "contests"])


@query("s09_manifest", "dataset:s season:i partial:i n_rows:i n_games:i accepted:i messages:s", _TWICE.format(early=_gate_sql("early", "(select * from pbp where week <= 1)", True), whole=_gate_sql("whole", "pbp", True)) + f"""
   select case when len(errors) = 0 or e.n is not null then 'pbp' end as dataset, w.season, case when len(errors) = 0 or e.n is not null then 1 end as partial, case when len(errors) = 0 then w.n else e.n end as n_rows,
     case when len(errors) = 0 then w.games else e.games end as n_games, len(errors) = 0 as accepted, {_SAID.replace("season", "w.season")} as messages from whole w left join e on e.season = w.season""", "pbp schedule")
def s09(t):
    root, told = _pulled(t, "manifest", [1, None], partial=True)
    listed = S.read_manifest(t.spark, root).withColumn("partial", F.col("partial").cast("int"))
    return told.join(listed.select("dataset", "season", "partial", "n_rows", "n_games"), "season", "left")


@query("s10_drift_report", "finding:s files:i", """select 'missing from cache' as finding, count(distinct season) as files from schedule where season = 2019 union all
   select 'revised', count(distinct season) from schedule where season in (2018, 2021) union all select 'not in the recorded manifest', count(distinct season) from schedule where season = 2016""", "schedule")
def s10(t):
    """The schedule on file and its digests recorded; then two seasons revised, one lost, one too many.

    The other seasons' files stay as they are: two executors that write equal rows need not write equal bytes.
    """
    root = _schedules(t)
    was = cut_lineage(S.season_hashes(t.spark, root))
    score = F.when(F.col("season").isin(2018, 2021), F.col("home_score") + 1).otherwise(F.col("home_score"))
    later = t.schedule.filter("season <> 2019").withColumn("home_score", score)
    extra = t.schedule.filter("season = 2016").withColumn("season", F.lit(2030))
    S.refresh_schedule(later.unionByName(extra), root, [2018, 2019, 2021, 2030])
    findings = ["missing from cache", "revised", "not in the recorded manifest"]
    counts = S.drift(was, S.season_hashes(t.spark, root)).agg(*[F.count_if(F.col("finding") == x).alias(x) for x in findings])
    return counts.unpivot([], findings, "finding", "files")


@query("s11_filtered_loader", "season:i n:i epa:d", "select season, count(*) as n, sum(epa) as epa from plays where season in (2016, 2023) group by season", "plays")
def s11(t):
    return S.load_filtered(t.spark, _stored(t), [2016, 2023]).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("epa").alias("epa"))


@query("s12_final_scores", "game_id:s season:i week:i home:s away:s home_score:i away_score:i", "select * from scores", "scores")
def s12(t):
    return t.scores


@query("s13_attached_columns", "season:i n:i return_yards:d touchdowns:d", "select season, count(*) as n, sum(return_yards) as return_yards, sum(touchdown) as touchdowns from plays group by season", "plays")
def s13(t):
    base = t.plays.drop("return_yards", "touchdown")
    out = S.attach_columns(base, t.plays, ["return_yards", "touchdown"])
    return out.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("return_yards").alias("return_yards"), F.sum("touchdown").alias("touchdowns"))


@query("s14_result_sinks", "fmt:s season:i n:i", "select fmt, season, count(*) as n from schedule, (values ('parquet'), ('json')) v(fmt) group by all", "schedule")
def s14(t):
    root = scratch(t, "sink")
    per = t.schedule.groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for fmt in ("parquet", "json"):
        S.write_summary(per, f"{root}/{fmt}", fmt)
        parts.append(t.spark.read.schema("season int, n long").format(fmt).load(f"{root}/{fmt}").withColumn("fmt", F.lit(fmt)))
    return J.union_strict(parts)


@query("s15_weights_record", "game_id:s home_deserved:d", "select game_id, home_deserved from deserved", "deserved")
def s15(t):
    """The artifact is written, read back through its checks and used to price every contest."""
    from contestry.operators.draws import plug_in_table

    path = scratch(t, "weights")
    S.weights_row(t.spark).write.json(path)
    return plug_in_table(t.frame, t.scores, S.load_weights(t.spark, path))


@query("m07_score_season", "game_id:s season:i week:i home:s away:s home_deserved:d away_deserved:d deserved_margin:d home_k:i away_n:i p_ok:i",
       "select game_id, season, week, home, away, home_deserved, away_deserved, deserved_margin, home_k, away_n, 1 as p_ok from deserved where season = 2025", "deserved")
def m07_season(t):
    """A season by its name: plays and schedule are stored, the baseline seasons read with it, every
    final scored; the share is that of the margin's draws."""
    from contestry.operators.scoring import score_season

    root = _stored(t, t.pbp.columns)
    S.write_season(t.schedule, root, "schedules")
    scored = score_season(t.spark, root, 2025, n_draws=2000, with_draws=True)
    share = F.aggregate("margin_draws", F.lit(0.0), lambda a, m: a + normal_cdf(m / F.lit(C.SIGMA_OF_RECORD))) / F.size("margin_draws")
    return scored.withColumn("p_ok", (F.abs(share - F.col("p_home")) < 1e-6).cast("int"))


# --- validation -----------------------------------------------------------------------------


@query("v01_validate_season", "season:i n_rows:i n_games:i errors:s warnings:s", """with x as (select *, case when week = 1 then season + 1 else season end as told,
     play_type in ('pass','run','punt','field_goal','extra_point','kickoff') as re, play_type = 'field_goal' as fg from pbp),
   g as (select season, game_id, count(*) as n, count_if(told <> season) as wrong, count_if(re) as re, count_if(re and epa is null) as ne, count_if(re and posteam is null) as np,
     count_if(fumble = 1) as fu, count_if(spread_line is null) as ns, count_if(fg) as fg, count_if(fg and kick_distance is null) as nd from x group by all),
   t as (select season, sum(n) as n, count(*) as games, sum(wrong) as wrong, sum(re) as re, sum(ne) as ne, sum(np) as np, sum(fu) as fu, sum(ns) as ns, sum(fg) as fg, sum(nd) as nd,
     count_if(n < 90) as short, min(struct_pack(a := n, b := game_id)) filter (n < 90) as least, count_if(n > 300) as long, max(struct_pack(a := n, b := game_id)) filter (n > 300) as most,
     case when season < 2021 then 256 else 272 end + case when season < 2020 then 11 else 13 end - case when season = 2022 then 1 else 0 end as want from g group by season)
   select season, n as n_rows, games as n_games, concat_ws(' | ', case when wrong > 0 then printf('season other than %d on %d of %d rows', season, wrong::bigint, n::bigint) end,
     case when games <> want then printf('%d games, expected %d', games, want) end,
     case when short > 0 then printf('too short: %d contests under 90 plays (the least is %s, %d)', short::bigint, least.b, least.a) end,
     case when long > 0 then printf('too long: %d contests over 300 plays (the most is %s, %d)', long::bigint, most.b, most.a) end,
     case when ne::double / re > 0.01 then printf('epa null: %d of the %d scored plays', ne::bigint, re::bigint) end,
     case when np::double / re > 0.01 then printf('posteam null: %d of the %d scored plays', np::bigint, re::bigint) end) as errors,
    concat_ws(' | ', case when fu = 0 then 'no fumbles in any row, which no season has: look at the fumble columns' end,
     case when ns::double / n > 0.02 then printf('spread_line missing: %d of %d rows', ns::bigint, n::bigint) end,
     case when nd > 0 then printf('kick_distance missing: %d of %d field goals tried', nd::bigint, fg::bigint) end) as warnings from t""", "pbp")
def v01(t):
    """Every season on file, the first week's rows carrying the next season by mistake."""
    rows = t.pbp.withColumn("on_file", F.col("season")).withColumn("season", F.when(F.col("week") == 1, F.col("season") + 1).otherwise(F.col("season")))
    return Q.validate_all(rows, "on_file").withColumns({c: F.concat_ws(" | ", c) for c in ("errors", "warnings")})


@query("v02_soft_warnings", "season:i warning:s", """with x as (select season, count(*) as n, count_if(spread_line is null) as ns, count_if(play_type = 'field_goal') as fg, count_if(play_type = 'field_goal' and kick_distance is null) as nd from pbp group by season)
   select season, printf('spread_line missing: %d of %d rows', ns, n) as warning from x where ns / n::double > 0.02 union all select season, printf('kick_distance missing: %d of %d field goals tried', nd, fg) from x where nd > 0
   union all select season, 'no fumbles in any row, which no season has: look at the fumble columns' from x""", "pbp")
def v02(t):
    """Every season on file, with the fumbles taken out."""
    rows = t.pbp.withColumns({"fumble": F.lit(0), "on_file": F.col("season")})
    return Q.validate_all(rows, "on_file").select("season", F.explode("warnings").alias("warning"))


@query("v03_validate_charting", "season:i case_name:s n_games:i n_errors:i n_warnings:i", """select season, case_name, g as n_games, n_errors, 0 as n_warnings
   from (select season, count(distinct nflverse_game_id) as g from charting group by season), (values ('exact', 0), ('more', 1), ('few', 1), ('duplicated', 1)) v(case_name, n_errors)""", "charting")
def v03(t):
    """Every season on file: as many contests as expected, too many, too few, and all twice."""
    df, n = t.charting, F.col("n_games")
    cases = {"exact": (df, n), "more": (df, n - 1), "few": (df, 2 * n), "duplicated": (df.unionByName(df), n)}
    reports = [Q.validate_all_charting(d, "season", expected=e).withColumn("case_name", F.lit(k)) for k, (d, e) in cases.items()]
    return J.union_strict(reports).withColumns({"n_errors": F.size("errors"), "n_warnings": F.size("warnings")})


@query("v04_expected_games", "season:i expected:i", """select season, case when season < 2021 then 256 else 272 end + case when season < 2020 then 11 else 13 end - case when season = 2022 then 1 else 0 end as expected
   from (select distinct season from schedule)""", "schedule")
def v04(t):
    return t.schedule.groupBy("season").agg(F.count(F.lit(1)).alias("n")).withColumn("expected", Q.expected_games())


_PINS = {"intercept": ("p.b_0", C.WEIGHTS_PIN[0]), "own_success_rate_for": ("p.b_a", C.WEIGHTS_PIN[1]), "own_ypp_for": ("p.b_b", C.WEIGHTS_PIN[2]), "margin_sd": ("q.margin_sd", C.MARGIN_SD_PIN)}


@query("v05_weights_pins", "field:s measured:d pinned:d ok:i",
       f"""with p as ({_fit_sql(_TRAIN, "points_for", "own_success_rate_for", "own_ypp_for")}), q as ({_fit_sql(_PAIRS, "result", "rate_diff", "ypp_diff")})
           select *, cast(round(measured, 3) = pinned as int) as ok from ({" union all ".join(f"select '{k}' as field, {m} as measured, {v!r} as pinned from p, q" for k, (m, v) in _PINS.items())})""", "frame")
def v05(t):
    """The refit's own numbers against the pins: weights from the points fit, the residual SD
    from the margin fit, all measured from the plays."""
    sd = B.margin_fit(t.frame).select("margin_sd").scalar()
    fit = B.points_fit(t.frame).select(F.col("b_0").alias("intercept"), F.col("b_a").alias("own_success_rate_for"), F.col("b_b").alias("own_ypp_for"), sd.alias("margin_sd"))
    return Q.pinned(fit, {k: v for k, (_, v) in _PINS.items()})


@query("v06_cardinality", "rows:i keys:i repeated:i", "select sum(c) as rows, count(*) as keys, count_if(c > 1) as repeated from (select game_id, play_id, count(*) as c from pbp group by all)", "pbp")
def v06(t):
    return J.cardinality(t.pbp, ["game_id", "play_id"])


@query("v07_non_positive_yards", "game_id:s posteam:s yards_for:d yards_against:d", """select game_id, posteam, yards_for - 250 as yards_for, yards_against - 250 as yards_against from frame
   where yards_for <= 250 or yards_against <= 250 order by game_id, posteam limit 5""", "frame")
def v07(t):
    shifted = t.frame.withColumns({c: F.col(c) - 250 for c in ("yards_for", "yards_against")})
    return Q.non_positive_yards(shifted)


@query("v08_missing_sides", "season:i missing:i", f"""select season, count(*) as missing from (select s.season, s.game_id, x.posteam from (select season, game_id, {modern('home_team')} as home, {modern('away_team')} as away from schedule) s,
   lateral (select s.home as posteam union all select s.away) x) m where not exists (select 1 from own o where o.game_id = m.game_id and o.posteam = m.posteam) group by season""", "schedule own")
def v08(t):
    from contestry.functions.columns import modern_code

    games = t.schedule.select("season", "game_id", modern_code("home_team").alias("home"), modern_code("away_team").alias("away"))
    missing = Q.missing_sides(games, B.production(t.plays))
    return missing.join(games.select("game_id", "season"), "game_id").groupBy("season").agg(F.count(F.lit(1)).alias("missing"))


@query("v09_fold_partition", "week:i folds:i", "select week, count(distinct fold) as folds from (select week, cast(substr(game_id, 2) as bigint) % 2 as fold from schedule) group by week having count(distinct fold) <> 1", "schedule")
def v09(t):
    rows = t.schedule.withColumn("fold", F.substring("game_id", 2, 20).cast("long") % 2)
    return Q.fold_partition(rows, "week", "fold")


@query("v10_frame_guards", "measure:s value:d expected:d ok:i", """select 'rows' as measure, count(*) as value, 8000.0 as expected, cast(abs(count(*) - 8000.0) <= 2000 as int) as ok from charted
   union all select 'worthy rate', avg(cast(is_interception_worthy as int)), 0.13, cast(abs(avg(cast(is_interception_worthy as int)) - 0.13) <= 0.02 as int) from charted
   union all select 'pick rate', avg(interception), 0.2, cast(abs(avg(interception) - 0.2) <= 0.02 as int) from charted""", "charted")
def v10(t):
    from contestry.plans.queries.filters import charted_passes

    return Q.frame_guard(charted_passes(t), {
        "rows": (F.count(F.lit(1)), 8000, 2000), "worthy rate": (F.avg(F.col("is_interception_worthy").cast("int")), 0.13, 0.02),
        "pick rate": (F.avg("interception"), 0.2, 0.02)})


@query("v11_row_order_invariance", "layouts_differ:i rows:i", "select 0 as layouts_differ, count(*) as rows from deserved", "deserved")
def v11(t):
    """Summaries of the same contests under two partitionings, compared element by element."""
    from contestry.operators.draws import two_layouts
    from contestry.plans.queries.model import _posterior_rows

    a, b = two_layouts(_posterior_rows(t), only=("p_home", "margin_var"))
    b = b.select("game_id", F.col("p_home").alias("p2"), F.col("margin_var").alias("v2"))
    differ = (F.col("p_home") != F.col("p2")) | (F.col("margin_var") != F.col("v2"))
    return a.join(b, "game_id").agg(F.count_if(differ).alias("layouts_differ"), F.count(F.lit(1)).alias("rows"))


@query("v12_era_code_scan", "game_id:s code:s era:s", f"""select game_id, code, case code when 'LV' then 'OAK' when 'LAC' then 'SD' end as era from (select game_id, season, {modern('home_team')} as code from schedule
   union all select game_id, season, {modern('away_team')} from schedule) where (code = 'LV' and season <= 2019) or (code = 'LAC' and season <= 2016)""", "schedule")
def v12(t):
    from contestry.functions.columns import modern_code

    return Q.era_violations(t.schedule.withColumns({c: modern_code(c) for c in ("home_team", "away_team")}))


@query("v15_played_guard", "games:i seasons:i season_list:s ok:i", """select count(*) as games, count(distinct season) as seasons, string_agg(distinct cast(season as varchar), ',' order by cast(season as varchar)) as season_list, 1 as ok from games where result is not null""", "games")
def v15(t):
    return Q.played_guard(t.results.filter("result is not null"), list(range(2016, 2026)))


# --- streaming ---------------------------------------------------------------------------------


@query("r01_readiness_stream", "game_id:s week:i ready:i", """select game_id, week, cast(game_id in (select game_id from (select game_id, posteam, count(*) as n from pbp where epa is not null and posteam is not null
   and play_type in ('pass', 'run') and two_point_attempt = 0 group by all) group by game_id having count(*) = 2 and min(n) >= 25) as int) as ready from games where result is not null""", "pbp games")
def r01(t):
    root = scratch(t, "stream")
    plays = t.pbp.select("game_id", "play_id", "home_team", "posteam", "play_type", "epa", "two_point_attempt")
    plays.repartition(4).write.parquet(f"{root}/in")
    stream = R.play_stream(t.spark, f"{root}/in", plays.schema, files_per_trigger=2)
    R.start_readiness(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return R.read_readiness(t.spark, f"{root}/out", t.results).withColumn("ready", F.col("ready").cast("int"))


@query("r02_live_refresh_stream", "season:i n:i epa:d", "select season, count(*) as n, sum(epa) as epa from (select season, game_id, play_id, max(epa) as epa from pbp where season >= 2024 group by all) group by season", "pbp")
def r02(t):
    """Two pulls of the live seasons, four files each, one a trigger; the second carries
    everything and wins."""
    root = scratch(t, "refresh")
    plays = t.pbp.filter("season >= 2024").groupBy("season", "week", "game_id", "play_id").agg(F.max("epa").alias("epa"))
    for n, pull in enumerate((plays.filter("week = 1"), plays)):
        pull.repartition(4).write.parquet(f"{root}/in{n}")
        stream = R.play_stream(t.spark, f"{root}/in{n}", plays.schema, files_per_trigger=1)
        R.refresh_live(stream, root, f"{root}/state{n}", f"pull{n}")
    return S.load_seasons(t.spark, root, "pbp", [2024, 2025]).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("epa").alias("epa"))


__all__ = ["K", "P", "scratch"]

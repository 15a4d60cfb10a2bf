"""Statistics and resampling studies; every random pick is a digest, so values are comparable."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.functions import plays as P
from contestry.functions.columns import digest, floor_bin, ratio, uniform
from contestry.functions.counters import STEP, WORD, counted_sql, lanes_sql, mixed_list_sql, mixed_sql, uniform_sql
from contestry.operators import drives as DR
from contestry.operators import placement as PL
from contestry.operators import resample as RS
from contestry.operators import stats as ST
from contestry.operators import windows as WN
from contestry.operators.boosting import boosted_out_of_fold
from contestry.operators.joins import extremes, union_strict
from contestry.operators.ranking import quantile_row
from contestry.plans.catalogue import query
from contestry.plans.oracle_tables import shared
from contestry.plans.queries.filters import charted_passes
from contestry.plans.queries.relational import team_margins
from contestry.plans.queries.tables import overtime, rested, sequencing, shifts


#: Sizes of the resampling studies: splits, permutations, resamples, resamples of a contrast.
SPLITS, PERMUTATIONS, RESAMPLES, CONTRASTS = 200, 500, 2000, 20000
#: Draws of the placement null.
NULL_DRAWS = 2000
#: Replicates per punt of the worst-bin table, and folds of the out-of-fold studies.
BIN_REPLICATES, FOLDS = 200, 10
#: Boosting rounds, and the nested feature sets that they are run on.
ROUNDS = 200
_ADVANCE = ("depth", "start_yardline_100", "scrimmage_plays")
_PRODUCTION = (*_ADVANCE, "explosive_plays", "max_gain", "first_downs", "penalty_aid_yards")
FEATURE_SETS = {"F1_depth": ("depth",), "F2_advance": _ADVANCE, "F3_production": _PRODUCTION, "F4_yardage": (*_PRODUCTION, "net_yards")}


def _u(parts: str) -> str:
    return f"cast('0x' || substr(md5({parts}), 1, 13) as bigint) / 4503599627370496e0"


def _pick(parts: str, n: str) -> str:
    return f"least(cast(floor({_u(parts)} * {n}) as bigint), {n} - 1)"


def _reps(n: int) -> str:
    return f"(select unnest(generate_series(0, {n - 1})) as rep)"


@query("a13_worst_cell_miss", "worst:d worst_cell:s cells:i", """with c as (select cast(cast(floor(distance / 5) * 5 as int) as varchar) as cell, avg(made) as actual, avg(p_old) as predicted, sum(p_old * (1 - p_old)) / power(count(*), 2) as v from shifts group by 1)
   select max(abs(actual - predicted) / sqrt(v)) as worst, arg_max(cell, abs(actual - predicted) / sqrt(v)) as worst_cell, count(*) as cells from c""", "shifts")
def a13(t):
    n = F.count(F.lit(1)).cast("double")
    cells = shifts(t).groupBy(floor_bin("distance", 5).cast("string").alias("cell")).agg(
        F.avg("made").alias("actual"), F.avg("p_old").alias("predicted"), (F.sum(F.col("p_old") * (F.lit(1.0) - F.col("p_old"))) / (n * n)).alias("v"))
    return ST.standardized_miss(cells, "predicted", "actual", "v")


shared("retention", "fumbles", "select concat(cast(season as varchar), '_', fumbled_1_team) as entity, count(*) as n, sum(retained) as k from fumbles group by 1")


def retention(t):
    return P.fumble_frame(t.pbp).groupBy(F.concat_ws("_", F.col("season").cast("string"), "fumbled_1_team").alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("retained").alias("k"))


_GRID = """with o as (select *, least(greatest(25e0 / sqrt(n * p * (1 - p)), 0.15), 6.0) as w, ln(p / (1 - p)) as c from (select cast(sum(n) as double) as n, sum(k) / cast(sum(n) as double) as p from retention)),
   g as (select i, h, mu, exp(lk) as kappa, lk from (select i, h, 1 / (1 + exp(-(c - w + i * (2 * w / 79e0)))) as mu, h * (14e0 / 219e0) as lk from o, (select unnest(generate_series(0, 79)) as i), (select unnest(generate_series(0, 219)) as h))),
   ll as (select i, h, mu, kappa, lk, sum(lgamma(k + mu * kappa) - lgamma(mu * kappa) + lgamma(n - k + (1 - mu) * kappa) - lgamma((1 - mu) * kappa) - lgamma(n + kappa) + lgamma(kappa)) + 2 * ln(mu) + 2 * ln(1 - mu) - power(lk - 4, 2) / 8 as lp from g, retention group by i, h, mu, kappa, lk),
   s as (select *, exp(lp - (select max(lp) from ll)) as wt from ll)
   select sum(wt * mu) / sum(wt) as mu_mean, exp(sum(wt * lk) / sum(wt)) as kappa_geo, sum(wt * sqrt(mu * (1 - mu) / (kappa + 1))) / sum(wt) as population_sd, sum(case when i in (0, 79) or h in (0, 219) then wt else 0 end) / sum(wt) as edge_mass from s"""


@query("a16_beta_binomial_grid", "mu_mean:d kappa_geo_k:d population_sd:d edge_mass:d", f"select *, kappa_geo / 1000 as kappa_geo_k from ({_GRID})", "retention")
def a16(t):
    return ST.grid_summary(ST.beta_binomial_grid(retention(t), 80, 220)).withColumn("kappa_geo_k", F.col("kappa_geo") / 1000.0)


@query("a17_shrunk_rates", "entity:s n:i k:i rate:d dial:d", "select *, (0.6 * 40 + k) / (40 + n) as rate, n / (n + 40.0) as dial from retention", "retention")
def a17(t):
    return ST.shrunk_rates(retention(t), 0.6, 40.0)


@query("a17_extremes", "end:s entity:s rate:d", """(select 'low' as "end", entity, (0.6 * 40 + k) / (40 + n) as rate from retention order by rate, entity limit 5) union all (select 'high', entity, (0.6 * 40 + k) / (40 + n) as rate from retention order by rate desc, entity limit 5)""", "retention")
def a17_ends(t):
    return extremes(ST.shrunk_rates(retention(t), 0.6, 40.0), "rate", 5, "entity")


@query("a18_variance_components", "beta:d between_sd:d residual_sd:d best_ratio:d", """with l as (select posteam, cast(count(*) as double) as c, sum(epa) as s, sum(epa * epa) as ss from scrim group by 1),
   g as (select i, power(10e0, -6 + i * (8e0 / 240)) as lam from (select unnest(generate_series(0, 240)) as i)),
   a as (select i, lam, sum(c) as n, count(*) as p, sum(c * c / (1 / lam + c)) as cc, sum(s) as sy, sum(c * s / (1 / lam + c)) as cs, sum(ss) as yy, sum(s * s / (1 / lam + c)) as s2, sum(ln(1 / lam + c)) as ld from g, l group by all),
   b as (select *, n - cc as xhx, (sy - cs) / (n - cc) as beta, greatest((yy - s2) - (sy - cs) / (n - cc) * (sy - cs), 1e-12) / (n - 1) as sigma2 from a),
   d as (select *, -0.5 * ((n - 1) * ln(sigma2) + ld + p * ln(lam) + ln(xhx)) + 0.5 * ln(lam) as lp from b), w as (select *, exp(lp - (select max(lp) from d)) as wt from d)
   select sum(wt * beta) / sum(wt) as beta, sum(wt * sqrt(lam * sigma2)) / sum(wt) as between_sd, sum(wt * sqrt(sigma2)) / sum(wt) as residual_sd, arg_max(lam, lp) as best_ratio from w""", "scrim")
def a18(t):
    return ST.component_summary(ST.variance_component_grid(P.scrimmage_with_down(t.pbp), "posteam", "epa"))


def prediction_frame(t):
    """Home minus away form and the line, per decided contest."""
    form = WN.rolling_strength(team_margins(t), "margin").select("game_id", "team", "strength").filter("strength is not null")
    line = t.pbp.groupBy("game_id").agg(F.max("spread_line").alias("spread_line"))
    home = form.select("game_id", F.col("team").alias("home_team"), F.col("strength").alias("hs"))
    away = form.select("game_id", F.col("team").alias("away_team"), F.col("strength").alias("as_"))
    return t.games.filter("margin <> 0").join(home, ["game_id", "home_team"]).join(away, ["game_id", "away_team"]).join(line, "game_id").select(
        "game_id", "season", (F.col("hs") - F.col("as_")).alias("strength_diff"), "spread_line", (F.col("margin") > 0).cast("double").alias("home_won"))


shared("prediction", "strength games pbp", """select g.game_id, g.season, h.strength - a.strength as strength_diff, l.spread_line, (margin > 0)::double as home_won from games g
   join strength h on h.game_id = g.game_id and h.team = g.home_team and h.strength is not null join strength a on a.game_id = g.game_id and a.team = g.away_team and a.strength is not null
   join (select game_id, max(spread_line) as spread_line from pbp group by 1) l on l.game_id = g.game_id where margin <> 0""")


def _newton_sql(name: str, rows: str, own: str, ridge: float, inputs: tuple[str, ...]) -> str:
    """Recursive Newton steps, as ``<name>_s``; ``<name>`` has the coefficients ``b0``, ``b1``, … of each ``fit``.
    ``rows`` has ``fold``, ``y`` and the inputs; ``own`` says which rows a fit leaves out."""
    x = ["1e0", *inputs]
    k = range(len(x))
    sums = [f"sum((y - p) * {x[i]}) - {ridge if i else 0.0!r} * any_value(b{i}) as g{i}" for i in k]
    sums += [f"sum(p * (1 - p) * {x[i]} * {x[j]}) + {ridge if i and i == j else 0.0!r} as h{i}{j}" for i in k for j in k if j >= i]
    h = [[f"h{min(i, j)}{max(i, j)}" for j in k] for i in k]

    def det(m):
        if len(m) == 1:
            return m[0][0]
        return "(" + " ".join(f"{'-' if c % 2 else '+'} {m[0][c]} * {det([r[:c] + r[c + 1:] for r in m[1:]])}" for c in range(len(m))) + ")"

    solved = [f"b{i} + {det([[f'g{r}' if c == i else h[r][c] for c in k] for r in k])} / {det(h)} as b{i}" for i in k]
    z = " + ".join(f"b{i} * {x[i]}" for i in k)
    b = ", ".join(f"b{i}" for i in k)
    return f"""{name}_s as (select fit, 0 as step, {", ".join(f"0e0 as b{i}" for i in k)} from (select distinct fold as fit from {rows}) union all
      select fit, step + 1, {", ".join(solved)} from (select fit, step, {", ".join(f"any_value(b{i}) as b{i}" for i in k)}, {", ".join(sums)} from (
        select s.*, r.*, 1 / (1 + exp(-({z}))) as p from {name}_s s join {rows} r on {own} where step < 12) group by fit, step)),
    {name} as (select fit, {b} from {name}_s where step = 12)"""


@query("a19_logistic_holdout", "n_train:i n_test:i log_loss:d brier:d auc:d accuracy:d", f"""with recursive l as (select 0 as fold, strength_diff as x, home_won as y from prediction where season <= 2022), {_newton_sql('m', 'l', 'true', 1.0, ('x',))},
   p as (select home_won as y, 1 / (1 + exp(-(b0 + b1 * strength_diff))) as p from prediction, m where season > 2022),
   r as (select *, (rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0) as place from p)
   select (select count(*) from l) as n_train, count(*) as n_test, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as log_loss, avg((p - y) * (p - y)) as brier,
     (sum(place) filter (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0) / (count_if(y = 1) * count_if(y = 0)) as auc, avg(((p > 0.5)::int = y)::int) as accuracy from r""", "prediction")
def a19(t):
    return ST.logistic_holdout(prediction_frame(t), ["strength_diff"], "home_won", F.col("season") <= 2022)


@query("a20_paired_out_of_fold", "n:i loss_a:d loss_b:d difference:d ci_low:d ci_high:d non_inferior:i", f"""with recursive d as (select game_id, strength_diff / 10.0 as x1, spread_line / 10.0 as x2, home_won as y,
     (row_number() over (order by md5(concat('0:', game_id)), game_id) - 1) % {FOLDS} as fold from prediction where spread_line is not null),
   {_newton_sql('a', 'd', 'r.fold <> s.fit', 0.0, ('x1', 'x2'))}, {_newton_sql('b', 'd', 'r.fold <> s.fit', 0.0, ('x1',))},
   p as (select y, 1 / (1 + exp(-(a.b0 + a.b1 * x1 + a.b2 * x2))) as pa, 1 / (1 + exp(-(b.b0 + b.b1 * x1))) as pb from d join a on a.fit = fold join b on b.fit = fold),
   e as (select -(y * ln(pa) + (1 - y) * ln(1 - pa)) as la, -(y * ln(pb) + (1 - y) * ln(1 - pb)) as lb from p),
   o as (select count(*) as n, avg(la) as loss_a, avg(lb) as loss_b, avg(la - lb) as difference, 1.96e0 * stddev_samp(la - lb) / sqrt(count(*)) as half from e)
   select *, difference - half as ci_low, difference + half as ci_high, cast(difference + half < 0.01 as int) as non_inferior from o""", "prediction")
def a20(t):
    rows = DR.fold_by_hash(prediction_frame(t).filter("spread_line is not null"), ["game_id"], FOLDS)
    rows = rows.withColumns({"x1": F.col("strength_diff") / 10.0, "x2": F.col("spread_line") / 10.0})
    both = ST.newton_out_of_fold(rows, ["x1", "x2"], "home_won", FOLDS, "game_id")
    one = ST.newton_out_of_fold(rows, ["x1"], "home_won", FOLDS, "game_id")
    return ST.paired_losses(both, one, "game_id", "home_won", 0.01)


shared("folded", "drives", "select *, floor(depth / 5) as cell, (row_number() over (order by md5(concat('0:', game_id, '|', cast(cast(fixed_drive as bigint) as varchar))), game_id, fixed_drive) - 1) % 10 as fold from drives where resampled = 1")


def folded(t):
    rows = t.drives.filter("resampled = 1").withColumn("drive_no", F.col("fixed_drive").cast("long"))
    return DR.fold_by_hash(rows, ["game_id", "drive_no"], FOLDS)


@query("a21_out_of_fold_means", "game_id:s fixed_drive:d fold:i predicted:d", """select f.game_id, f.fixed_drive, f.fold, case when c.c - coalesce(o.c, 0) >= 100 then (c.s - o.s) / (c.c - o.c) else (t.s - x.s) / (t.c - x.c) end as predicted from folded f
   join (select cell, sum(points) s, count(*) c from folded group by 1) c on c.cell = f.cell join (select cell, fold, sum(points) s, count(*) c from folded group by all) o on o.cell = f.cell and o.fold = f.fold
   join (select fold, sum(points) s, count(*) c from folded group by 1) x on x.fold = f.fold, (select sum(points) s, count(*) c from folded) t""", "folded")
def a21(t):
    return DR.out_of_fold_means(folded(t), "depth_bin", "points", "fold")


@query("a22_boosted_out_of_fold", "features:s sd_observed:d sd_modelled:d retention:d")
def a22(t):
    """One row per nested feature set: the same learner and folds, more information each time."""
    rows = boosted_out_of_fold(folded(t), FEATURE_SETS, "points", FOLDS, ROUNDS)
    return union_strict([DR.spread_retention(rows, f"predicted.{name}").withColumn("features", F.lit(name)) for name in FEATURE_SETS])


@query("a26_spearman_brown", "season:i r:d reliability:d", "select season, r, 2 * r / (1 + r) as reliability from (select season, corr(success_rate_for, success_rate_against) as r from frame group by season)", "frame")
def a26(t):
    return t.frame.groupBy("season").agg(F.corr("success_rate_for", "success_rate_against").alias("r")).withColumn("reliability", ST.spearman_brown(F.col("r")))


@query("a28_ks_uniform", "ks:d n:i", "select max(greatest(rn / cast(n as double) - wp, wp - (rn - 1) / cast(n as double))) as ks, max(n) as n from (select wp, row_number() over (order by wp, game_id, play_id, mix) as rn, count(*) over () as n from pbp where wp is not null)", "pbp")
def a28(t):
    rows = t.pbp.filter("wp is not null").select("wp", F.concat_ws("|", "game_id", "play_id", "mix").alias("tie"))
    return WN.ks_from_uniform(rows, "wp", "tie")


@query("a30_quality_controlled", "r:d n:i", """with h as (select season, posteam, week % 2 as half, avg(points_for) as y, avg(own_ypp_for) as x from frame group by all), s as (select half, regr_slope(y, x) as b, avg(y) as my, avg(x) as mx from h group by half),
   d as (select h.season, h.posteam, h.half, y - my - b * (x - mx) as e from h join s on s.half = h.half) select corr(a.e, b.e) as r, count(*) as n from d a join d b on a.season = b.season and a.posteam = b.posteam and a.half = 0 and b.half = 1""", "frame")
def a30(t):
    halves = t.frame.groupBy("season", "posteam", (F.col("week") % 2).alias("half")).agg(F.avg("points_for").alias("y"), F.avg("own_ypp_for").alias("x"))
    lines = halves.groupBy("half").agg(F.regr_slope("y", "x").alias("b"), F.avg("y").alias("my"), F.avg("x").alias("mx"))
    left = halves.join(lines, "half").withColumn("e", F.col("y") - F.col("my") - F.col("b") * (F.col("x") - F.col("mx")))
    both = left.groupBy("season", "posteam").agg(F.max(F.when(F.col("half") == 0, F.col("e"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("e"))).alias("z"))
    return both.filter("a is not null and z is not null").agg(F.corr("a", "z").alias("r"), F.count(F.lit(1)).alias("n"))


@query("a31_home_balanced_contrast", "swing:d n:i", "select avg(fp_margin) filter (where home_received = 1) + avg(fp_margin) filter (where home_received = 0) as swing, count(*) as n from overtime", "overtime")
def a31(t):
    home = F.col("home_received") == 1
    return overtime(t).agg((F.avg(F.when(home, F.col("fp_margin"))) + F.avg(F.when(~home, F.col("fp_margin")))).alias("swing"), F.count(F.lit(1)).alias("n"))


@query("a32_odd_even_split", "entities:i r:d", """select count(*) as entities, corr(a, b) as r from (select defteam, avg(interception) filter (where week % 2 = 1) as a, avg(interception) filter (where week % 2 = 0) as b, count_if(week % 2 = 1) as na, count_if(week % 2 = 0) as nb from charted where is_interception_worthy group by 1) where na >= 3 and nb >= 3""", "charted")
def a32(t):
    return ST.odd_even(charted_passes(t).filter("is_interception_worthy"), ["defteam"], F.col("interception"))


@query("a33_adjacent_seasons", "pairs:i r:d", "with e as (select season, defteam, avg(interception) as v from plays where play_type = 'pass' group by all) select count(*) as pairs, corr(a.v, b.v) as r from e a join e b on a.defteam = b.defteam and b.season = a.season + 1", "plays")
def a33(t):
    effects = t.plays.filter("play_type = 'pass'").groupBy("season", "defteam").agg(F.avg("interception").alias("effect"))
    return ST.adjacent_seasons(effects, "defteam", "effect")


@query("a34_reference_row", "air:d xyac:d air_squared:d", "select median(air_epa) as air, median(xyac_epa) as xyac, power(median(air_epa), 2) as air_squared from charted", "charted")
def a34(t):
    row = quantile_row(charted_passes(t).select("air_epa", "xyac_epa"), {"air": ("air_epa", 0.5), "xyac": ("xyac_epa", 0.5)})
    return row.withColumn("air_squared", F.col("air") * F.col("air"))


@query("a35_rematch_parameters", "n_pairs:i sd_margin:d reliability:d hfa_points:d a_wins_rate:d p_a_home:d", "select count(*) as n_pairs, stddev_samp(margin_g1_a) as sd_margin, corr(margin_g1_a, margin_g2_a) as reliability, (avg(margin_g1_a) - avg(margin_g2_a)) / 2 as hfa_points, avg(cast(margin_g2_a > 0 as int)) as a_wins_rate, avg(a_home_g2) as p_a_home from rematches", "rematches")
def a35(t):
    return WN.rematches(t.games).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.stddev_samp("margin_g1_a").alias("sd_margin"), F.corr("margin_g1_a", "margin_g2_a").alias("reliability"),
        ((F.avg("margin_g1_a") - F.avg("margin_g2_a")) / 2.0).alias("hfa_points"), F.avg((F.col("margin_g2_a") > 0).cast("double")).alias("a_wins_rate"), F.avg("a_home_g2").alias("p_a_home"))


_R36 = f"select floor(spot / 5) * 5 as bin, rep, avg(net + ({_u('''concat('36:', rep, ':', game_id, ':', cast(cast(play_id as bigint) as varchar))''')} - 0.5) * 20) as m, avg(net) as o from punts, {_reps(BIN_REPLICATES)} group by all having count(*) >= 20"


@query("a36_worst_bin_vs_replicates", "statistic:d threshold:d", f"""with b as ({_R36}), s as (select bin, avg(m) as mu, stddev_samp(m) as sd from b group by bin), z as (select b.*, abs(m - mu) / sd as zr, abs(o - mu) / sd as zo from b join s on s.bin = b.bin)
   select max(zo) as statistic, (select quantile_cont(x, 0.945) from (select max(zr) as x from z group by rep)) as threshold from z""", "punts")
def a36(t):
    u = uniform(digest(36, F.col("rep"), F.col("game_id"), F.col("play_id").cast("long")))
    rows = P.punt_table(t.pbp).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(BIN_REPLICATES - 1))))
    bins = rows.withColumn("draw", F.col("net") + (u - 0.5) * 20.0).groupBy(floor_bin("spot", 5).alias("bin"), "rep").agg(F.avg("draw").alias("m"), F.avg("net").alias("o"), F.count(F.lit(1)).alias("c")).filter("c >= 20")
    spread = bins.groupBy("bin").agg(F.avg("m").alias("mu"), F.stddev_samp("m").alias("sd"))
    z = bins.join(spread, "bin")
    per = z.groupBy("rep").agg(F.max(F.abs(F.col("m") - F.col("mu")) / F.col("sd")).alias("x"), F.max(F.abs(F.col("o") - F.col("mu")) / F.col("sd")).alias("y"))
    return per.agg(F.max("y").alias("statistic"), F.percentile("x", 0.945).alias("threshold"))


# --- resampling ----------------------------------------------------------------------------------

_HALF = f"""with u as (select *, count(*) over (partition by team_season) as size from sequencing), d as (select u.*, rep, row_number() over (partition by rep, team_season order by md5(concat('0:', rep, ':', team_season, '|', game_id)), game_id) - 1 < floor(size / 2) as a from u, {_reps(SPLITS)} where size >= 3),
   h as (select rep, team_season, sum(epa_all) filter (where a) / sum(n_all) filter (where a) as a1, sum(epa_all) filter (where not a) / sum(n_all) filter (where not a) as b1, avg(succ_all) filter (where a) as a2, avg(succ_all) filter (where not a) as b2 from d group by all),
   r as (select rep, corr(a1, b1) as pooled, corr(a2, b2) as averaged, count(*) as entities from h group by rep)"""


@query("m12_split_half", "measure:s mean_r:d low:d high:d entities:i full_length:d", _HALF + " " + " union all ".join(f"select '{m}' as measure, avg({m}) as mean_r, quantile_cont({m}, 0.055) as low, quantile_cont({m}, 0.945) as high, max(entities) as entities, 2 * avg({m}) / (1 + avg({m})) as full_length from r" for m in ("pooled", "averaged")), "sequencing")
def m12(t):
    by_split = RS.split_half(sequencing(t), "team_season", "game_id", {"pooled": ("epa_all", "n_all"), "averaged": ("succ_all", None)}, SPLITS, min_units=3)
    return RS.reliability(by_split, ["pooled", "averaged"])


@query("m13_event_split_half", "mean_r:d entities:i", f"""with e as (select concat(cast(season as varchar), '_', defteam) as entity, concat(game_id, '-', cast(cast(play_id as bigint) as varchar)) as unit, return_yards as y from pbp where interception = 1 and return_yards is not null), u as (select *, count(*) over (partition by entity) as size from e),
   d as (select u.*, rep, row_number() over (partition by rep, entity order by md5(concat('0:', rep, ':', entity, '|', unit)), unit) - 1 < floor(size / 2) as a from u, {_reps(SPLITS)} where size >= 3), h as (select rep, entity, avg(y) filter (where a) as x, avg(y) filter (where not a) as z from d group by all)
   select avg(r) as mean_r, max(n) as entities from (select rep, corr(x, z) as r, count(*) as n from h group by rep)""", "pbp")
def m13(t):
    events = t.pbp.filter("interception = 1 and return_yards is not null").select(
        F.concat_ws("_", F.col("season").cast("string"), "defteam").alias("entity"), F.concat_ws("-", "game_id", F.col("play_id").cast("long").cast("string")).alias("unit"), F.col("return_yards").alias("y"))
    out = RS.split_half(events, "entity", "unit", {"r": ("y", None)}, SPLITS, min_units=3)
    return out.agg(F.avg("r").alias("mean_r"), F.max("entities").alias("entities"))


@query("m14_permutation_null", "rep:i sd_between:d entities:i", f"""with k as (select * from (select team_season, game_id, epa_all, n_all, count(*) over (partition by team_season) as size from sequencing) where size >= 3), s as (select team_season as slot_team, row_number() over (order by team_season, game_id) as slot from k),
   d as (select k.*, rep, row_number() over (partition by rep order by md5(concat('perm:0:', rep, ':', team_season, '|', game_id)), team_season, game_id) as slot from k, {_reps(PERMUTATIONS)})
   select rep, stddev_samp(v) as sd_between, count(*) as entities from (select rep, slot_team, sum(epa_all) / sum(n_all) as v from d join s on s.slot = d.slot group by all) group by rep""", "sequencing")
def m14(t):
    units = sequencing(t).select("team_season", "game_id", "epa_all", "n_all")
    dealt = RS.permuted_sums(units, "team_season", "game_id", {"e": F.col("epa_all"), "n": F.col("n_all")}, PERMUTATIONS, min_units=3)
    per = dealt.select("rep", ratio("e", "n").alias("v"))
    return per.groupBy("rep").agg(F.stddev_samp("v").alias("sd_between"), F.count(F.lit(1)).alias("entities"))


shared("redrawn", "drives donors", f"""with l as (select d.*, x.donor_bin, x.mean_points from drives d join donors x on x.depth_bin = d.depth_bin where resampled = 1), p as (select donor_bin, points, row_number() over (partition by donor_bin order by points) - 1 as place, count(*) over (partition by donor_bin) as size from l),
   s as (select donor_bin, max(size) as size from p group by 1), e as (select l.game_id, l.is_home, l.points, l.donor_bin, size, {lanes_sql("place", "concat('0:', game_id, ':', cast(cast(fixed_drive as bigint) as varchar))")} from l join s on s.donor_bin = l.donor_bin),
   k as (select game_id, is_home, points, donor_bin, rep, size, {uniform_sql("place")} from e, {counted_sql(RESAMPLES)})
   select k.game_id, rep, sum(case when is_home = 1 then 1 else -1 end * (p.points - k.points)) as delta, sum(p.points) as drawn, sum(k.points) as observed, count(*) as n from k join p on p.donor_bin = k.donor_bin and p.place = least(cast(floor(k.place * k.size) as bigint), k.size - 1) group by all""")


@query("m15_donor_bin_resample", "game_id:s reps:i mean_delta:d sd_delta:d low:d high:d", "select game_id, count(*) as reps, avg(delta) as mean_delta, stddev_samp(delta) as sd_delta, quantile_cont(delta, 0.055) as low, quantile_cont(delta, 0.945) as high from redrawn group by 1", "redrawn")
def m15(t):
    drives = DR.resampled_drives(t.drives)
    return DR.resample_summary(drives, DR.conditional_points(drives, 400), RESAMPLES)


@query("m15_unbiasedness", "observed_mean:d resampled_mean:d difference:d pass:i", "select *, resampled_mean - observed_mean as difference, cast(abs(resampled_mean - observed_mean) < 0.05 as int) as pass from (select sum(observed) / sum(n) as observed_mean, sum(drawn) / sum(n) as resampled_mean from redrawn)", "redrawn")
def m15_check(t):
    drives = DR.resampled_drives(t.drives)
    return DR.unbiased(drives, DR.conditional_points(drives, 400), RESAMPLES)


@query("m16_expected_delta", "game_id:s expected_delta:d", "select game_id, sum(case when is_home = 1 then 1 else -1 end * (mean_points - points)) as expected_delta from drives d join donors x on x.depth_bin = d.depth_bin where resampled = 1 group by 1", "drives donors")
def m16(t):
    return DR.expected_delta(t.drives, DR.conditional_points(t.drives, 400))


def _boot(rows: str, key: str, group: str, sums: str, reps: int) -> str:
    part = f"partition by {group}" if group else ""
    g, kg = (f"{group}, ", f"k.{group}, ") if group else ("", "")
    seeds = lanes_sql("pick", f"concat('0:', rep, ':', cast({group} as varchar))" if group else "concat('0:', rep)")
    return f"""with p as (select *, row_number() over ({part} order by {key}) - 1 as i, count(*) over ({part}) as n from {rows}), r as (select {g}rep, {seeds} from {f'(select distinct {group} from p),' if group else ''} {_reps(reps)}),
      u as (select {'p.' + group + ', ' if group else ''}rep, n, pick_high, pick_low, {mixed_sql('c', f'((i * {STEP}) & {WORD})')} from p, r {f'where p.{group} = r.{group}' if group else ''}),
      d as (select {g}rep, n, {uniform_sql('pick', 'c5')} from u), k as (select {g}rep, least(cast(floor(pick * n) as bigint), n - 1) as i from d)
      select {kg}rep, {sums} from k join p on p.i = k.i {f'and p.{group} = k.{group}' if group else ''} group by all"""


@query("m17_paired_bootstrap", "rep:i mean_gap:d drawn:i", _boot("(select game_id, deserved_margin - (home_score - away_score) as gap from deserved)", "game_id", "", "sum(gap) / count(*) as mean_gap, count(*) as drawn", RESAMPLES), "deserved")
def m17(t):
    rows = t.deserved.select("game_id", (F.col("deserved_margin") - (F.col("home_score") - F.col("away_score"))).alias("gap"))
    return RS.bootstrap(rows, "game_id", {"s": F.col("gap")}, {"mean_gap": ratio("s", "drawn")}, RESAMPLES)


@query("m18_cluster_bootstrap", "rep:i rate:d", _boot("(select game_id, sum(made) as m, count(*) as c from kicks group by 1)", "game_id", "", "sum(m) / cast(sum(c) as double) as rate", RESAMPLES), "kicks")
def m18(t):
    per = shifts(t).groupBy("game_id").agg(F.sum("made").alias("m"), F.count(F.lit(1)).alias("c"))
    return RS.bootstrap(per, "game_id", {"sm": F.col("m"), "sc": F.col("c")}, {"rate": ratio("sm", "sc")}, RESAMPLES)


@query("m19_two_group_bootstrap", "rep:i swing:d", f"select rep, sum(m) as swing from ({_boot('overtime', 'game_id', 'home_received', 'sum(fp_margin) / count(*) as m', CONTRASTS)}) group by rep", "overtime")
def m19(t):
    rows = overtime(t).select("game_id", "home_received", "fp_margin")
    draws = RS.bootstrap(rows, "game_id", {"s": F.col("fp_margin")}, {"m": ratio("s", "drawn")}, CONTRASTS, group=["home_received"])
    return draws.groupBy("rep").agg(F.sum("m").alias("swing"))


def _interval(rows: str, value: str) -> str:
    return f"select avg({value}) as mean, quantile_cont({value}, 0.025) as low, quantile_cont({value}, 0.975) as high, avg(cast({value} < 0 as int)) as share_below_zero, count(*) as reps from ({rows})"


_INTERVAL = "mean:d low:d high:d share_below_zero:d reps:i"


@query("m17_interval", _INTERVAL, _interval(_boot("(select game_id, deserved_margin - (home_score - away_score) as gap from deserved)", "game_id", "", "sum(gap) / count(*) as mean_gap", RESAMPLES), "mean_gap"), "deserved")
def m17_interval(t):
    return RS.summarize_draws(m17(t), "mean_gap")


@query("m18_interval", _INTERVAL, _interval(_boot("(select game_id, sum(made) as m, count(*) as c from kicks group by 1)", "game_id", "", "sum(m) / cast(sum(c) as double) as rate", RESAMPLES), "rate"), "kicks")
def m18_interval(t):
    return RS.summarize_draws(m18(t), "rate")


@query("m19_interval", _INTERVAL, _interval(f"select rep, sum(m) as swing from ({_boot('overtime', 'game_id', 'home_received', 'sum(fp_margin) / count(*) as m', CONTRASTS)}) group by rep", "swing"), "overtime")
def m19_interval(t):
    return RS.summarize_draws(m19(t), "swing")


def _selected(group: str) -> str:
    """For each group of plays and draw, ``s``: the values in the order of the draw's keys."""
    return f"""with e as (select *, {lanes_sql("key", "concat('0:', game_id, '|', cast(cast(play_id as bigint) as varchar), '|', cast(mix as varchar))")} from priced),
       u as (select row_number() over () as id, * from (select {group}, list(epa_priced order by play_id, mix) as v, list(key_high order by play_id, mix) as h, list(key_low order by play_id, mix) as l,
         count(*) as n, count_if(cell = 'red_zone') as n_rz, count_if(cell <> 'other') as k, avg(epa_priced) as mn from e group by all)),
       x as materialized (select id, rep, num from u, {counted_sql(NULL_DRAWS)}),
       w as (select u.* exclude (h, l), rep, {mixed_list_sql("list_transform(h, lambda y: xor(y, num))")} as mh, {mixed_list_sql("list_transform(l, lambda y: xor(y, num))")} as ml from x join u on u.id = x.id),
       o as (select * exclude (v, mh, ml), list_sort(list_transform(range(1, n + 1), lambda i: {{'key': mh[i] * 1048576 + (ml[i] >> 12), 'v': v[i]}})) as s from w)"""


def _sum_of(first: str, last: str) -> str:
    return f"coalesce(list_sum(list_transform(s[{first}:{last}], lambda y: y.v)), 0)"


def _raw(score: str) -> str:
    return f"""{_selected('game_id, posteam')}, t as (select *, {_sum_of('1', 'n_rz')} - n_rz * mn as a, {_sum_of('n_rz + 1', 'k')} - (k - n_rz) * mn as b, k / n::double as share from o)
      select game_id, posteam, rep, case when k = 0 or k = n then 0 else ({score}) * 0.8389e0 end as score from t"""


def _stratified(scale: str) -> str:
    return f"""{_selected('game_id, posteam, down')}, t as (select *, {_sum_of('1', 'n_rz')} as a, {_sum_of('1', 'n')} as whole from o),
      c as (select game_id, posteam, count(*) as n, count_if(cell <> 'other') as k, avg(epa_priced) as mn from priced group by all),
      g as (select game_id, posteam, rep, sum(n_rz * mn + {scale} * (a - n_rz * mn) + case when down in (3, 4) then whole - a else 0 end) as total from t group by all)
      select g.game_id, g.posteam, rep, case when k = 0 or k = n then 0 else (total - k * mn) * 0.8389e0 end as score from g join c on c.game_id = g.game_id and c.posteam = g.posteam"""


_MATCHED = "((1 - share) * 1.41e0 + share * 0.82e0) * a + ((1 - share) * 1.1e0 + share * 0.82e0) * b"
_SUMMARY = "rung:s game_id:s posteam:s draws:i mean:d sd:d least:d most:d low:d high:d"


def _summed(**rungs: str) -> str:
    return " union all ".join(
        f"select '{rung}' as rung, game_id, posteam, count(*) as draws, avg(score) as mean, stddev_samp(score) as sd, min(score) as least, max(score) as most, "
        f"quantile_cont(score, 0.055) as low, quantile_cont(score, 0.945) as high from ({body}) group by game_id, posteam" for rung, body in rungs.items())


@query("m20_placement_null", _SUMMARY, _summed(raw=_raw("a + b"), down_stratified=_stratified("1e0")), "priced")
def m20(t):
    return PL.null_summary(t.priced, NULL_DRAWS, ("raw", "down_stratified"))


@query("m20_variance_matched_null", _SUMMARY, _summed(raw_var_matched=_raw(_MATCHED), down_stratified_var_matched=_stratified("1.41e0")), "priced")
def m20_matched(t):
    return PL.null_summary(t.priced, NULL_DRAWS, ("raw_var_matched", "down_stratified_var_matched"), rz_scale=1.41, scales=(1.41, 1.1, 0.82))


@query("m21_group_folds", "fold:i games:i", "select fold, count(*) as games from (select (row_number() over (order by md5(concat('0:', game_id)), game_id) - 1) % 5 as fold from schedule) group by fold", "schedule")
def m21(t):
    return DR.fold_by_hash(t.schedule, ["game_id"], 5).groupBy("fold").agg(F.count(F.lit(1)).alias("games"))


_BAND = f"""with d as ({_raw("a + b")}) select d.game_id, d.posteam, quantile_cont(d.score, 0.055) as low, quantile_cont(d.score, 0.945) as high, max(p.score) as realized,
   (count_if(d.score < p.score - 1e-9) + 0.5 * count_if(abs(d.score - p.score) <= 1e-9)) / cast(count(*) as double) as pit from d join placed p on p.game_id = d.game_id and p.posteam = d.posteam group by all"""


@query("m22_null_bands", "game_id:s posteam:s low:d high:d realized:d pit:d", _BAND, "priced placed")
def m22(t):
    return PL.null_band(t.priced, NULL_DRAWS)


@query("a29_mid_p_percentile", "units:i mean_pit:d", f"select count(*) as units, avg(pit) as mean_pit from ({_BAND})", "priced placed")
def a29(t):
    return m22(t).agg(F.count(F.lit(1)).alias("units"), F.avg("pit").alias("mean_pit"))


__all__ = ["prediction_frame", "rested"]

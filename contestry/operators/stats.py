"""Grouped statistics, closed-form grids and learners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.columns import ln_gamma, ratio
from contestry.operators.ranking import with_prefix_sum
from contestry.session import cut_lineage


def counts(rows: DataFrame, keys: Sequence[str], success: Column) -> DataFrame:
    """Trials and successes per entity; entities with a null key are dropped."""
    kept = rows
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(success.cast("int"), F.lit(0))).cast("long").alias("k"))


def covariance_shares(rows: DataFrame, target: str, components: Sequence[str]) -> DataFrame:
    """Each component's share of the target's variance; with exact parts the shares sum to 1."""
    one = rows.agg(*[F.struct(
        F.lit(c).alias("component"), ratio(F.covar_samp(c, target), F.var_samp(target)).alias("share"),
        F.stddev_samp(c).alias("sd"), F.corr(c, target).alias("r")).alias(c) for c in components])
    return one.select(F.explode(F.array(*components)).alias("x")).select("x.*")


def shrunk_rates(entities: DataFrame, mu: float, kappa: float) -> DataFrame:
    """(mu kappa + k) / (kappa + n) with the trust dial n / (n + kappa)."""
    return entities.withColumns({
        "rate": ratio(F.lit(mu * kappa) + F.col("k"), F.lit(kappa) + F.col("n")),
        "dial": ratio("n", F.col("n") + F.lit(kappa))})


def spearman_brown(r: Column) -> Column:
    return F.when(r > -1, F.lit(2.0) * r / (F.lit(1.0) + r))


def leave_one_out_rate(rows: DataFrame, group: str, num: str, den: str, name: str = "rest_rate") -> DataFrame:
    """The group's rate without the row; group totals joined back, never a group in one task."""
    totals = rows.groupBy(group).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d"))
    return rows.join(totals, group).withColumn(
        name, ratio(F.col("_n") - F.col(num), F.col("_d") - F.col(den))).drop("_n", "_d")


def standardized_miss(cells: DataFrame, predicted: str, actual: str, variance: str) -> DataFrame:
    """Largest |actual - predicted| in standard errors over cells."""
    gap = ratio(F.abs(F.col(actual) - F.col(predicted)), F.sqrt(variance))
    return cells.agg(F.max(gap).alias("worst"), F.max_by("cell", gap).alias("worst_cell"), F.count(F.lit(1)).alias("cells"))


def matched_bin_gap(rows: DataFrame, bin_col: str, group: Column, value: str, minimum: int) -> DataFrame:
    """Two groups compared inside bins both fill, weighted by the second group."""
    left, right = group == "left", group == "right"
    per = rows.groupBy(bin_col).agg(
        F.count_if(F.coalesce(left, F.lit(False))).alias("n_left"), F.count_if(F.coalesce(right, F.lit(False))).alias("n_right"),
        F.avg(F.when(left, F.col(value))).alias("mean_left"), F.avg(F.when(right, F.col(value))).alias("mean_right"))
    kept = per.filter((F.col("n_left") >= minimum) & (F.col("n_right") >= minimum)).withColumn(
        "gap", F.col("mean_right") - F.col("mean_left"))
    return kept.agg(F.count(F.lit(1)).alias("bins"), F.sum("n_right").alias("weight"),
                    ratio(F.sum(F.col("gap") * F.col("n_right")), F.sum("n_right")).alias("weighted_gap"))


def odd_even(rows: DataFrame, keys: Sequence[str], value: Column, minimum: int = 3) -> DataFrame:
    """Odd against even weeks per entity: both halves from one aggregate, then one correlation."""
    odd = F.col("week") % 2 == 1
    per = rows.groupBy(*keys).agg(
        F.avg(F.when(odd, value)).alias("a"), F.avg(F.when(~odd, value)).alias("b"),
        F.count(F.when(odd, value)).alias("na"), F.count(F.when(~odd, value)).alias("nb"))
    kept = per.filter((F.col("na") >= minimum) & (F.col("nb") >= minimum))
    return kept.agg(F.count(F.lit(1)).alias("entities"), F.corr("a", "b").alias("r"))


def adjacent_seasons(effects: DataFrame, entity: str, value: str) -> DataFrame:
    nxt = effects.select(entity, (F.col("season") - 1).alias("season"), F.col(value).alias("_next"))
    return effects.join(nxt, [entity, "season"]).agg(F.count(F.lit(1)).alias("pairs"), F.corr(value, "_next").alias("r"))


# --- grids ---------------------------------------------------------------------------------------


def beta_binomial_grid(entities: DataFrame, mu_points: int = 80, kappa_points: int = 220) -> DataFrame:
    """Grid posterior of a beta-binomial population: every cell's log density.

    Entities enter only through how many share a success, failure or trial count. Those
    histograms meet the grid in one expansion whose sums combine map-side, so neither an
    entity with very many trials nor very many entities lands in one task.
    """
    total = entities.agg(F.struct(F.sum("k").cast("double").alias("k"), F.sum("n").cast("double").alias("n"))).scalar()
    rate = F.least(F.greatest(ratio(total["k"], total["n"]), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    width = F.least(F.greatest(F.lit(25.0) / F.sqrt(total["n"] * rate * (F.lit(1.0) - rate)), F.lit(0.15)), F.lit(6.0))
    values = F.array(
        F.struct(F.lit("a").alias("kind"), F.col("k").cast("double").alias("v")),
        F.struct(F.lit("b").alias("kind"), (F.col("n") - F.col("k")).cast("double").alias("v")),
        F.struct(F.lit("t").alias("kind"), F.col("n").cast("double").alias("v")))
    histogram = entities.select(F.explode(values).alias("x")).groupBy("x.kind", "x.v").agg(
        F.count(F.lit(1)).cast("double").alias("c"))
    cells = (
        histogram.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(mu_points - 1))))
        .withColumn("eta", F.ln(rate / (F.lit(1.0) - rate)) - width + F.col("i") * (F.lit(2.0) * width / (mu_points - 1)))
        .withColumn("mu", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("eta"))))
        .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(kappa_points - 1))))
        .withColumn("ln_kappa", F.col("h") * F.lit(14.0 / (kappa_points - 1)))
    )
    share = F.when(F.col("kind") == "a", F.col("mu")).when(F.col("kind") == "b", F.lit(1.0) - F.col("mu")).otherwise(1.0)
    sign = F.when(F.col("kind") == "t", -1.0).otherwise(1.0)
    at = share * F.exp("ln_kappa")
    term = sign * F.col("c") * (ln_gamma(F.col("v") + F.col("at")) - ln_gamma(F.col("at")))
    summed = cells.withColumn("at", at).groupBy("i", "h", "mu", "ln_kappa").agg(F.sum(term).alias("ll"))
    lk = F.col("ln_kappa")
    prior = F.lit(2.0) * F.ln("mu") + F.lit(2.0) * F.ln(F.lit(1.0) - F.col("mu")) - (lk - 4.0) * (lk - 4.0) / 8.0
    return summed.select("i", "h", "mu", F.exp("ln_kappa").alias("kappa"), "ln_kappa", (F.col("ll") + prior).alias("log_post"))


def grid_summary(grid: DataFrame) -> DataFrame:
    """Posterior means of the rate, concentration and population SD, and the edge mass."""
    top = grid.agg(F.max("log_post")).scalar()
    edges = grid.agg(F.struct(F.max("i").alias("i"), F.max("h").alias("h"))).scalar()
    w = F.exp(F.col("log_post") - top)
    sd = F.sqrt(F.col("mu") * (F.lit(1.0) - F.col("mu")) / (F.col("kappa") + 1.0))
    edge = (F.col("i") == 0) | (F.col("h") == 0) | (F.col("i") == edges["i"]) | (F.col("h") == edges["h"])
    return grid.withColumns({"w": w, "sd": sd}).agg(
        ratio(F.sum(F.col("w") * F.col("mu")), F.sum("w")).alias("mu_mean"),
        F.exp(ratio(F.sum(F.col("w") * F.col("ln_kappa")), F.sum("w"))).alias("kappa_geo"),
        ratio(F.sum(F.col("w") * F.col("kappa")), F.sum("w")).alias("kappa_mean"),
        ratio(F.sum(F.col("w") * F.col("sd")), F.sum("w")).alias("population_sd"),
        ratio(F.sum(F.when(edge, F.col("w")).otherwise(0.0)), F.sum("w")).alias("edge_mass"))


def variance_component_grid(rows: DataFrame, level: str, value: str, points: int = 241,
                            low: float = -6.0, high: float = 2.0) -> DataFrame:
    """One-way variance component: the restricted log likelihood on a grid of ratios.

    Per-level counts and sums first; a level then meets every grid point once and the
    sums over levels combine map-side.
    """
    levels = rows.filter(F.col(value).isNotNull() & F.col(level).isNotNull()).groupBy(level).agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    # levels with equal counts share d, so they are pooled before meeting the grid
    pooled = levels.groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum("s").alias("s1"),
                                     F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("ss").alias("ss"))
    step = (high - low) / (points - 1)
    grid = pooled.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "lam", F.pow(F.lit(10.0), F.lit(low) + F.col("i") * step))
    d = F.lit(1.0) / F.col("lam") + F.col("c")
    sums = grid.groupBy("i", "lam").agg(
        F.sum(F.col("m") * F.col("c")).alias("n"), F.sum("m").alias("p"), F.sum(F.col("m") * F.col("c") * F.col("c") / d).alias("cc"),
        F.sum("s1").alias("sy"), F.sum(F.col("c") * F.col("s1") / d).alias("cs"), F.sum("ss").alias("yy"),
        F.sum(F.col("s2") / d).alias("s2"), F.sum(F.col("m") * F.ln(d)).alias("ld"))
    xhx, xhy, yhy = F.col("n") - F.col("cc"), F.col("sy") - F.col("cs"), F.col("yy") - F.col("s2")
    out = sums.withColumns({"beta": ratio(xhy, xhx), "xhx": xhx})
    rss = F.greatest(yhy - F.col("beta") * xhy, F.lit(1e-12))
    out = out.withColumn("sigma2", rss / (F.col("n") - 1.0))
    ll = F.lit(-0.5) * ((F.col("n") - 1.0) * F.ln("sigma2") + F.col("ld") + F.col("p") * F.ln("lam") + F.ln("xhx"))
    return out.select("i", "lam", "beta", "sigma2", (ll + F.lit(0.5) * F.ln("lam")).alias("log_post"))


def component_summary(grid: DataFrame) -> DataFrame:
    top = grid.agg(F.max("log_post")).scalar()
    w = F.exp(F.col("log_post") - top)
    weighted = grid.withColumn("w", w)
    mean = lambda e: ratio(F.sum(F.col("w") * e), F.sum("w"))
    return weighted.agg(
        mean(F.col("beta")).alias("beta"), mean(F.sqrt(F.col("lam") * F.col("sigma2"))).alias("between_sd"),
        mean(F.sqrt("sigma2")).alias("residual_sd"), F.max_by("lam", "log_post").alias("best_ratio"))


# --- learners ------------------------------------------------------------------------------------


def newton_fits(data: DataFrame, cols: Sequence[str], label: str, uses: Sequence[Column], ridge: float = 0.0, steps: int = 25):
    """Logistic coefficients, one row for each of ``uses`` (which rows it learns from), by Newton steps.

    A step is one aggregate over the data: gradient and Hessian sums of all fits, solved as
    small dense systems on the driver (fits x features numbers). ``ridge`` holds back all
    coefficients but that of the first column.
    """
    import numpy as np

    width = len(cols)
    beta = np.zeros((len(uses), width))
    held = np.diag([0.0] + [ridge] * (width - 1))
    y = F.col(label).cast("double")
    for _ in range(steps):
        aggs = []
        for f, use in enumerate(uses):
            z = sum((F.lit(float(beta[f, j])) * F.col(c) for j, c in enumerate(cols[1:], 1)), F.lit(float(beta[f, 0])) * F.col(cols[0]))
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
            w = p * (F.lit(1.0) - p)
            for i in range(width):
                aggs.append(F.sum(F.when(use, (y - p) * F.col(cols[i]))).alias(f"g{f}_{i}"))
                for j in range(i, width):
                    aggs.append(F.sum(F.when(use, w * F.col(cols[i]) * F.col(cols[j]))).alias(f"h{f}_{i}_{j}"))
        sums = data.agg(*aggs).first()
        moved = 0.0
        for f in range(len(uses)):
            grad = np.array([sums[f"g{f}_{i}"] or 0.0 for i in range(width)]) - held @ beta[f]
            hess = np.array([[sums[f"h{f}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(width)] for i in range(width)]) + held
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
            beta[f] += step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:
            break
    return beta


def area_under_curve(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row, ``auc``: the exact share of pairs of a positive and a negative that the score puts in
    order, ties by half. Equal scores are one row before they are ordered."""
    positive = F.col(label).cast("double")
    tied = scored.groupBy(F.col(score).alias("_score")).agg(F.sum(positive).alias("_pos"), F.sum(F.lit(1.0) - positive).alias("_neg"))
    ladder = with_prefix_sum(tied, [], ["_score"], "_neg", "_upto")
    return ladder.agg(ratio(F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") * 0.5)), F.sum("_pos") * F.sum("_neg")).alias("auc"))


def logistic_holdout(rows: DataFrame, features: Sequence[str], label: str, train: Column,
                     ridge: float = 1.0) -> DataFrame:
    """Logistic fit on one part, scored on the rest. ``ridge`` is the inverse of C."""
    cols = ["_one", *features]
    data = rows.withColumns({"_one": F.lit(1.0), "_train": F.coalesce(train, F.lit(False))}).select(label, "_train", *cols).persist()
    beta = newton_fits(data, cols, label, [F.col("_train")], ridge)[0]
    n = data.filter("_train").count()
    z = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
    scored = cut_lineage(data.filter(~F.col("_train")).withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))
    data.unpersist()
    p = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1.0 - 1e-15))
    y = F.col(label).cast("double")
    return scored.agg(
        F.lit(n).alias("n_train"), F.count(F.lit(1)).alias("n_test"),
        F.avg(-(y * F.ln(p) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - p))).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"),
        area_under_curve(scored, "p", label).scalar().alias("auc"), F.avg(((p > 0.5).cast("double") == y).cast("double")).alias("accuracy"),
        F.lit(float(beta[1])).alias("coef"))


def newton_out_of_fold(rows: DataFrame, features: Sequence[str], label: str, folds: int, key: str,
                       steps: int = 25) -> DataFrame:
    """Out-of-fold logistic probabilities for every fold at once."""
    cols = ["_one", *features]
    data = rows.withColumn("_one", F.lit(1.0)).select(key, "fold", label, *cols).persist()
    beta = newton_fits(data, cols, label, [F.col("fold") != f for f in range(folds)], steps=steps)
    z = None
    for f in range(folds):
        lin = sum((F.lit(float(beta[f, j])) * F.col(c) for j, c in enumerate(cols)), F.lit(0.0))
        z = F.when(F.col("fold") == f, lin) if z is None else z.when(F.col("fold") == f, lin)
    signs = F.array(*[F.lit(float(b)) for b in beta.mean(axis=0)])
    out = cut_lineage(data.withColumns({"p": F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), "mean_coef": signs}))
    data.unpersist()
    return out


def paired_losses(a: DataFrame, b: DataFrame, key: str, label: str, margin: float) -> DataFrame:
    """Loss of one model minus another's per row: mean, interval, non-inferiority."""
    def loss(df, name):
        p = F.least(F.greatest("p", F.lit(1e-12)), F.lit(1.0 - 1e-12))
        y = F.col(label).cast("double")
        return df.select(key, (-(y * F.ln(p) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - p))).alias(name))
    both = loss(a, "la").join(loss(b, "lb"), key).withColumn("d", F.col("la") - F.col("lb"))
    one = both.agg(F.count(F.lit(1)).alias("n"), F.avg("la").alias("loss_a"), F.avg("lb").alias("loss_b"),
                   F.avg("d").alias("difference"), F.stddev_samp("d").alias("_s"))
    half = F.lit(1.96) * F.col("_s") / F.sqrt(F.col("n").cast("double"))
    return one.select("n", "loss_a", "loss_b", "difference", (F.col("difference") - half).alias("ci_low"),
                      (F.col("difference") + half).alias("ci_high"), (F.col("difference") + half < margin).cast("int").alias("non_inferior"))

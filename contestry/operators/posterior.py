"""Least squares from sufficient statistics, closed-form posteriors and scales.

With two inputs the whole fit is one aggregate: counts, means and centred moments.
The coefficients, their covariance and the residual scales are expressions over that
single row, so nothing but the row itself ever leaves an executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions.columns import guarded, ratio
from contestry.operators.features import KEYS
from contestry.operators.ranking import quantile_row

INPUTS = ("own_success_rate_for", "own_ypp_for")


def training_rows(frame: DataFrame, seasons=C.TRAIN_SEASONS, inputs=INPUTS) -> DataFrame:
    """Training seasons, contests whose two rows are both complete (a side pair per window)."""
    complete = F.lit(True)
    for c in (*inputs, "points_for"):
        complete = complete & F.col(c).isNotNull()
    pair = W.partitionBy("game_id")
    return (
        frame.filter(F.col("season").isin(*seasons))
        .withColumn("_complete", F.sum(complete.cast("int")).over(pair))
        .filter(F.col("_complete") == 2).drop("_complete")
    )


def _moments(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """n, means and centred sums of squares and products."""
    n = F.count(F.lit(1)).cast("double")
    return rows.agg(
        n.alias("n"), F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        (F.var_pop(a) * n).alias("saa"), (F.var_pop(b) * n).alias("sbb"),
        (F.covar_pop(a, b) * n).alias("sab"), (F.covar_pop(a, y) * n).alias("say"),
        (F.covar_pop(b, y) * n).alias("sby"), (F.var_pop(y) * n).alias("syy"),
    )


def two_input_fit(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row: coefficients, residual sum of squares, R squared, covariance of the fit."""
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    fit = _moments(rows, y, a, b).withColumns({
        "det": det,
        "b_a": ratio(F.col("sbb") * F.col("say") - F.col("sab") * F.col("sby"), det),
        "b_b": ratio(F.col("saa") * F.col("sby") - F.col("sab") * F.col("say"), det),
    })
    fit = fit.withColumns({
        "b_0": F.col("my") - F.col("b_a") * F.col("ma") - F.col("b_b") * F.col("mb"),
        "rss": F.col("syy") - F.col("b_a") * F.col("say") - F.col("b_b") * F.col("sby"),
    })
    s2 = ratio("rss", F.col("n") - 3)
    caa, cbb, cab = ratio("sbb", "det"), ratio("saa", "det"), ratio(-F.col("sab"), "det")
    ma, mb = F.col("ma"), F.col("mb")
    return fit.withColumns({
        "r2": F.lit(1.0) - ratio("rss", "syy"), "sigma2": s2,
        "v_aa": s2 * caa, "v_bb": s2 * cbb, "v_ab": s2 * cab,
        "v_0a": -s2 * (ma * caa + mb * cab), "v_0b": -s2 * (ma * cab + mb * cbb),
        "v_00": s2 * (ratio(F.lit(1.0), "n") + ma * ma * caa + F.lit(2.0) * ma * mb * cab + mb * mb * cbb),
    })


def points_fit(frame: DataFrame, seasons=C.TRAIN_SEASONS) -> DataFrame:
    return two_input_fit(training_rows(frame, seasons), "points_for", *INPUTS)


def game_pairs(frame: DataFrame, values=(*INPUTS, "points_for")) -> DataFrame:
    """Home row beside away row: one aggregate per contest, home margin added."""
    home = F.col("home") == 1
    both = frame.groupBy("game_id").agg(
        F.max("season").alias("season"), F.max("week").alias("week"),
        F.max(F.when(home, F.col("posteam"))).alias("home"),
        F.max(F.when(~home, F.col("posteam"))).alias("away"),
        *[F.max(F.when(home, F.col(v))).alias(f"{v}_h") for v in values],
        *[F.max(F.when(~home, F.col(v))).alias(f"{v}_a") for v in values],
        F.count_if(home).alias("_h"), F.count_if(~home).alias("_a"),
    )
    both = guarded(both, (F.col("_h") > 1) | (F.col("_a") > 1), F.concat(F.lit("more than one row per side in "), F.col("game_id")))
    return (
        both.filter((F.col("_h") > 0) & (F.col("_a") > 0))
        .withColumn("result", F.col("points_for_h") - F.col("points_for_a"))
        .drop("_h", "_a")
    )


def margin_fit(frame: DataFrame, seasons=C.TRAIN_SEASONS) -> DataFrame:
    """Home margin on home-minus-away inputs; its residual SD has n - 3 degrees of freedom."""
    pairs = game_pairs(training_rows(frame, seasons)).select(
        "result", *[(F.col(f"{v}_h") - F.col(f"{v}_a")).alias(f"{v}_diff") for v in INPUTS])
    return two_input_fit(pairs, "result", *[f"{v}_diff" for v in INPUTS]).withColumn(
        "margin_sd", F.sqrt("sigma2"))


def league_means(frame: DataFrame, seasons=C.TRAIN_SEASONS) -> DataFrame:
    return training_rows(frame, seasons).agg(
        F.avg(INPUTS[0]).alias("rate"), F.avg(INPUTS[1]).alias("ypp"))


def deserved_points(weights=None) -> Column:
    b0, b1, b2 = weights or C.WEIGHTS_OF_RECORD["mean"]
    return F.lit(b0) + F.lit(b1) * F.col(INPUTS[0]) + F.lit(b2) * F.col(INPUTS[1])


def with_deserved(frame: DataFrame, weights=None) -> DataFrame:
    """Own and opponent's plug-in points and both margins on every side's row."""
    own = frame.withColumn("deserved_for", deserved_points(weights))
    other = own.select("game_id", F.col("posteam").alias("defteam"),
                       F.col("deserved_for").alias("deserved_against"))
    return own.join(other, ["game_id", "defteam"], "left").withColumns({
        "deserved_margin": F.col("deserved_for") - F.col("deserved_against"),
        "actual_margin": F.col("points_for") - F.col("points_against"),
    })


def production(plays: DataFrame) -> DataFrame:
    """k successes of n plays, mean and SD of yards; a single play has SD 0."""
    return plays.groupBy(*KEYS).agg(
        F.sum(F.coalesce("success", F.lit(0))).alias("k"), F.count(F.lit(1)).alias("n"),
        F.avg("yards_gained").alias("y_mean"),
        F.coalesce(F.stddev_samp("yards_gained"), F.lit(0.0)).alias("y_sd"))


def folded_production(frame: DataFrame) -> DataFrame:
    """The record's posterior with its seams checked inside the plan.

    The frame already carries every count, so no second pass over the plays is needed;
    a broken seam raises while the row is produced.
    """
    return seams_checked(frame).select(
        *KEYS, F.col("own_k_for").cast("long").alias("k"), F.col("own_n_for").cast("long").alias("n"),
        F.col("own_ypp_for").alias("y_mean"), "y_sd",
        (F.col("own_n_for") - F.col("srtake_takeaways_for")).cast("long").alias("n_y"),
    )


def seams_checked(frame: DataFrame) -> DataFrame:
    """The frame, a row of which raises where its folded counts do not fit together."""
    gap = F.abs(ratio("own_k_for", "own_n_for") - F.col("own_success_rate_for"))
    none = F.col("own_k_for").isNull() | F.col("own_n_for").isNull()
    plays = F.col("own_n_for") - F.col("srtake_takeaways_for") != F.col("plays_for")
    what = F.when(none, "no folded counts").when(gap > C.SEAM_LINE, "k / n misses the frame's rate").otherwise("folded count less takeaways is not the play count")
    return guarded(frame, none | F.coalesce(gap > C.SEAM_LINE, F.lit(False)) | F.coalesce(plays, F.lit(False)),
                   F.concat(what, F.lit(": "), F.col("game_id"), F.lit(" "), F.col("posteam")))


def gate_games(scores: DataFrame, frame: DataFrame, seasons=C.GATE_SEASONS) -> DataFrame:
    both = frame.groupBy("game_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows = 2")
    return (
        scores.filter(F.col("season").isin(*seasons))
        .withColumn("result", F.col("home_score") - F.col("away_score"))
        .filter(F.col("result") != 0).join(both, "game_id", "left_semi")
    )


def pooled_scale(variances: DataFrame, margin_sd: float, column: str = "margin_var") -> DataFrame:
    """sqrt(sd^2 - median variance), never floored; refuses a median at or above sd^2."""
    total = F.lit(float(margin_sd) ** 2)
    med = quantile_row(variances, {"med": (column, 0.5)})
    med = guarded(med, F.col("med") >= total, F.lit("the median production variance is not below the squared residual SD"))
    return med.select(F.sqrt(total - F.col("med")).cast("double").alias("sigma"))


def per_game_scale(variances: DataFrame, margin_sd: float, floor: float = C.SCALE_FLOOR,
                   column: str = "margin_var") -> DataFrame:
    left = F.lit(float(margin_sd) ** 2) - F.col(column)
    least = F.lit(float(floor) ** 2)
    return variances.withColumns({
        "sigma": F.sqrt(F.greatest(left, least)), "floored": (left < least).cast("int")})


def plug_in_variance(weights_cov=None, weights=None) -> Column:
    """Closed-form variance of a contest's margin draw, from the two sides' posteriors."""
    _, b1, b2 = weights or C.WEIGHTS_OF_RECORD["mean"]
    cov = weights_cov or C.WEIGHTS_OF_RECORD["cov"]
    mean = lambda s: (F.col(f"k_{s}") + 1) / (F.col(f"n_{s}") + 2.0)
    var = lambda s: mean(s) * (F.lit(1.0) - mean(s)) / (F.col(f"n_{s}") + 3.0)
    yv = lambda s: F.col(f"y_sd_{s}") * F.col(f"y_sd_{s}") / F.col(f"n_y_{s}")
    dr, dy = mean("h") - mean("a"), F.col("y_mean_h") - F.col("y_mean_a")
    vr, vy = var("h") + var("a"), yv("h") + yv("a")
    return (
        F.lit(cov[1][1]) * dr * dr + F.lit(2 * cov[1][2]) * dr * dy + F.lit(cov[2][2]) * dy * dy
        + F.lit(b1 * b1 + cov[1][1]) * vr + F.lit(b2 * b2 + cov[2][2]) * vy
    )

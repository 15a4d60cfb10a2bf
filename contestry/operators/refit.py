"""Refit of the model of record: measure every pinned number again, write only if all hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry import constants as C
from contestry.operators import draws as D
from contestry.operators import posterior as B
from contestry.operators.ranking import quantile_row


class RefitStopped(RuntimeError):
    """A measured number is not the pinned one; nothing was written."""


def fitted_weights(frame: DataFrame) -> dict:
    """The fit as a record: coefficients, their covariance, residual scales (one row, ten numbers)."""
    p, m = B.points_fit(frame).first(), B.margin_fit(frame).first()
    cov = ((p.v_00, p.v_0a, p.v_0b), (p.v_0a, p.v_aa, p.v_ab), (p.v_0b, p.v_ab, p.v_bb))
    return {"mean": (p.b_0, p.b_a, p.b_b), "cov": cov, "sigma2": p.sigma2, "n_rows": int(p.n), "margin_sd": m.margin_sd}


def gate_variances(frame: DataFrame, scores: DataFrame, weights: dict, n_draws: int = C.DRAWS_OF_RECORD, seed: int = C.SEED_OF_RECORD) -> DataFrame:
    """Per gate contest, the variance of its own margin draws and the exact one."""
    table = D.plug_in_table(frame, scores, weights).join(B.gate_games(scores, frame).select("game_id"), "game_id", "left_semi")
    post = table.select("game_id", *[F.col(f"{s}_{c}").alias(f"{c}_{s[0]}") for s in ("home", "away") for c in ("k", "n", "y_mean", "y_sd", "n_y")])
    post = post.withColumn("exact_var", B.plug_in_variance(weights["cov"], weights["mean"]))
    return D.draw_summaries(post, n_draws, seed, weights=weights, keep=["game_id", "exact_var"]).select("game_id", "margin_var", "exact_var")


def measured_scale(frame: DataFrame, scores: DataFrame, weights: dict, n_draws: int = C.DRAWS_OF_RECORD, seed: int = C.SEED_OF_RECORD) -> DataFrame:
    """One row: ``drawn`` and ``exact``, the noise-once scale that the draws' median variance leaves
    of the published residual SD, and the one that the exact median leaves; null where none is left."""
    total = F.lit(round(float(weights["margin_sd"]), C.PIN_DECIMALS) ** 2)
    medians = quantile_row(gate_variances(frame, scores, weights, n_draws, seed), {"drawn": ("margin_var", 0.5), "exact": ("exact_var", 0.5)})
    return medians.select(*[F.when(F.col(c) < total, F.sqrt(total - F.col(c))).alias(c) for c in ("drawn", "exact")])


def refit_gate(frame: DataFrame, scores: DataFrame, weights: dict | None = None, n_draws: int = C.DRAWS_OF_RECORD, seed: int = C.SEED_OF_RECORD,
               pins: dict[str, float] | None = None) -> DataFrame:
    """Each check with what was measured, its pin and its line, and whether it passes; the scale
    is measured on the gate contests' own draws, ``exact`` is what they should come to.

    ``pins`` replaces pins by the name of their check.
    """
    w = weights or fitted_weights(frame)
    spark = frame.sparkSession
    gates = B.gate_games(scores, frame).count()
    scale = measured_scale(frame, scores, w, n_draws, seed).first()
    drawn, exact = scale.drawn or 0.0, scale.exact or 0.0
    # (name, measured, exact, pin, line)
    checks = [
        ("training rows", float(w["n_rows"]), None, float(C.EXPECTED_TRAIN_ROWS), 0.0), ("gate games", float(gates), None, float(C.EXPECTED_GATE_GAMES), 0.0),
        ("success weight", w["mean"][1], None, C.WEIGHTS_PIN[1], C.COEFFICIENT_LINE), ("yards weight", w["mean"][2], None, C.WEIGHTS_PIN[2], C.COEFFICIENT_LINE),
        ("margin residual sd", w["margin_sd"], None, C.MARGIN_SD_PIN, C.COEFFICIENT_LINE),
        ("noise-once scale", drawn, exact, C.SIGMA_OF_RECORD, C.SCALE_LINE), ("noise-once floor", drawn, exact, C.SCALE_FLOOR, 0.0),
    ]
    rows = [(name, float(m or 0.0), float(m if e is None else e or 0.0), float((pins or {}).get(name, pin)), line) for name, m, e, pin, line in checks]
    table = spark.createDataFrame(rows, "check_name string, measured double, exact double, pinned double, line double")
    close = F.abs(F.col("measured") - F.col("pinned")) <= F.col("line")
    return table.withColumn("pass", F.when(F.col("check_name") == "noise-once floor", F.col("measured") > F.col("pinned")).otherwise(close).cast("int"))


def refit(frame: DataFrame, scores: DataFrame, path: str, n_draws: int = C.DRAWS_OF_RECORD, seed: int = C.SEED_OF_RECORD, pins: dict[str, float] | None = None) -> dict:
    """Fit, check against every pin, and write the weights artifact; a check that fails stops the
    refit before anything is written, and is named in the error."""
    from contestry.sources.seasons import WEIGHTS_SCHEMA

    w = fitted_weights(frame)
    gate = {r.check_name: r for r in refit_gate(frame, scores, w, n_draws, seed, pins).collect()}
    failed = [f"{name}: measured {r.measured:.10g}, pinned {r.pinned:.10g}" for name, r in gate.items() if not r["pass"]]
    if failed:
        raise RefitStopped("; ".join(failed))
    sigma = round(gate["noise-once scale"].measured, C.SCALE_DECIMALS)
    row = (list(C.WEIGHT_COLUMNS), list(w["mean"]), [list(r) for r in w["cov"]], w["sigma2"], w["n_rows"], w["margin_sd"], sigma, n_draws, seed, C.ARM_OF_RECORD)
    frame.sparkSession.createDataFrame([row], WEIGHTS_SCHEMA).write.mode("overwrite").json(path)
    return w | {"sigma_once": sigma}

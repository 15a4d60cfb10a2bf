"""Positions, prefix sums, quantiles and frames against brute force, with a hot group."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.operators.ranking import (
    bounded_frame, drop_copies, equal_count_bins, exact_quantiles, hash_rank, with_positions, with_prefix_sum,
)


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("g"),
        (F.col("id") * 37 % 50).cast("double").alias("v"), F.col("id"))


def test_positions_and_prefix_sums(skewed):
    pos = with_positions(skewed, ["g"], ["v", "id"]).toPandas().sort_values(["g", "v", "id"])
    assert (pos.groupby("g").cumcount().to_numpy() == pos.pos.to_numpy()).all()
    cum = with_prefix_sum(skewed, ["g"], ["v", "id"], "v").toPandas().sort_values(["g", "v", "id"])
    assert np.allclose(cum.groupby("g").v.cumsum().to_numpy(), cum.cum.to_numpy())


def test_hash_rank(skewed):
    df = hash_rank(skewed.withColumn("h", F.md5(F.col("id").cast("string"))), ["g"], "h", "id", F.lit(900)).toPandas().sort_values(["g", "h"])
    assert (df.groupby("g").cumcount().to_numpy() == df["rank"].to_numpy()).all()


def test_frames_cross_chunk_edges(skewed):
    placed = with_positions(skewed, ["g"], ["v", "id"])
    laid, over = bounded_frame(placed, ["g"], "pos", 3, 2, chunk=7)
    out = drop_copies(laid.withColumn("s", F.sum("v").over(over.rowsBetween(-3, 2)))).toPandas()
    assert len(out) == 900
    for _, part in out.sort_values("pos").groupby("g"):
        v = part.v.to_numpy()
        want = [v[max(0, i - 3): i + 3].sum() for i in range(len(v))]
        assert np.allclose(part.s.to_numpy(), want)


def test_exact_quantiles_and_bins(skewed):
    got = {(r.g, r.q): r.value for r in exact_quantiles(skewed, ["v"], [0.1, 0.5, 0.99], ["g"]).collect()}
    pdf = skewed.toPandas()
    for (g, q), value in got.items():
        assert value == pytest.approx(np.quantile(pdf[pdf.g == g].v, q))
    sizes = [r["count"] for r in equal_count_bins(skewed, "v", "id", 7).groupBy("bin").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 900


def test_draws_do_not_depend_on_layout(spark):
    from contestry.operators.resample import bootstrap

    rows = spark.range(50).select(F.concat(F.lit("u"), "id").alias("u"), F.col("id").cast("double").alias("x"))
    run = lambda d: sorted(map(tuple, bootstrap(d, "u", {"s": F.col("x")}, {}, 5).collect()))
    assert run(rows.repartition(1)) == run(rows.repartition(13))

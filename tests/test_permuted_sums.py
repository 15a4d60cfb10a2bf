"""Synthetic entities summed in bins of digests against the units dealt as rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from contestry.operators import resample as RS


def test_sums_of_permuted_units(spark, monkeypatch):
    r = random.Random(8)
    rows = [(f"e{r.randint(0, 9)}", f"u{k}", r.choice([None, r.gauss(0, 1)]), r.randint(1, 9)) for k in range(900)] + [("few", "u", 1.0, 1)]
    units = spark.createDataFrame(rows, "entity string, unit string, y double, n int").repartition(5)
    told = lambda df: {(x.rep, x.entity): (round(x.y, 9), x.n) for x in df.collect()}
    dealt = RS.permuted_entities(units, "entity", "unit", 40, min_units=3)
    want = told(dealt.groupBy("rep", "entity").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"), F.sum("n").cast("double").alias("n")))
    assert len(want) == 400
    terms = {"y": F.col("y"), "n": F.col("n")}
    assert told(RS.permuted_sums(units, "entity", "unit", terms, 40, min_units=3, held=1)) == want
    monkeypatch.setattr(RS, "permuted_entities", None)  # no unit is dealt as a row
    assert told(RS.permuted_sums(units, "entity", "unit", terms, 40, min_units=3)) == want
    assert RS.permuted_sums(units, "entity", "unit", terms, 40, min_units=10_000).count() == 0

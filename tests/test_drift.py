"""The drift report names what was changed, whatever bytes a writer makes of equal rows."""

from __future__ import annotations

from itertools import cycle
from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from contestry.plans.queries import QUERIES

LOST, REVISED, EXTRA = "missing from cache", "revised", "not in the recorded manifest"


def report(spark, seasons):
    schedule = spark.range(20 * len(seasons)).select(
        F.element_at(F.lit(list(seasons)), (F.col("id") % len(seasons) + 1).cast("int")).alias("season"),
        F.format_string("G%09d", "id").alias("game_id"), (F.col("id") % 30).cast("int").alias("home_score"))
    return {r.finding: r.files for r in QUERIES["s10_drift_report"].build(SimpleNamespace(spark=spark, schedule=schedule)).collect()}


def test_equal_rows_in_other_bytes_are_no_revision(spark, monkeypatch):
    """No write gives the bytes of the one before, as on executors whose JVMs order a footer's encodings differently."""
    written, codecs = DataFrameWriter.parquet, cycle(["snappy", "gzip", "zstd"])
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: written(self.option("compression", next(codecs)), path, *a, **k))
    assert report(spark, range(2016, 2026)) == {LOST: 1, REVISED: 2, EXTRA: 1}


def test_a_season_of_several_files_counts_once(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        assert report(spark, range(2016, 2026)) == {LOST: 1, REVISED: 2, EXTRA: 1}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


@pytest.mark.parametrize(("seasons", "want"), [((2016, 2017), (0, 0, 1)), ((2018, 2019), (1, 1, 0)), ((2020,), (0, 0, 0))])
def test_what_was_not_found_is_told_as_none(spark, seasons, want):
    assert report(spark, seasons) == dict(zip((LOST, REVISED, EXTRA), want, strict=True))

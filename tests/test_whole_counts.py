"""Queries that once ran a part of their count, window or input."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contestry.operators import stats
from contestry.plans.queries import ledger, studies
from contestry.plans.tables import Tables

SF = "/root/testdata/sf0.001"


def answers(sql):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("name", ["m10_replayed_share", "m11_expected_clip", "m20_placement_null", "m20_variance_matched_null", "s07_ingest_season",
                                  "s08_live_season", "s09_manifest", "a15_refit_gate", "m04_points_draws", "m10_exact_share"])
def test_against_the_registered_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
    assert got and got == sorted(map(repr, answers(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})")))


def test_logistic_fit_and_area_against_plain_sums(spark):
    r = random.Random(1)
    rows = [(k, r.choice([-2.0, -1.0, 0.0, 0.5, 1.0, 2.0]), k % 3 == 0) for k in range(300)]
    rows = [(*row, float(r.random() < 1 / (1 + math.exp(-0.3 - 0.8 * row[1])))) for row in rows]
    frame = spark.createDataFrame(rows, "id long, x double, held boolean, y double")
    got = stats.logistic_holdout(frame, ["x"], "y", ~F.col("held"), ridge=2.0).first()
    learn, b = [(x, y) for _, x, held, y in rows if not held], np.zeros(2)
    for _ in range(30):
        g, h = np.array([0.0, -2.0 * b[1]]), np.diag([0.0, 2.0])
        for x, y in learn:
            v = np.array([1.0, x])
            p = 1 / (1 + math.exp(-b @ v))
            g, h = g + (y - p) * v, h + p * (1 - p) * np.outer(v, v)
        b = b + np.linalg.solve(h, g)
    test = [(1 / (1 + math.exp(-b[0] - b[1] * x)), y) for _, x, held, y in rows if held]
    pairs = [(p > q) + 0.5 * (p == q) for p, y in test if y == 1 for q, z in test if z == 0]
    assert (got.n_train, got.n_test) == (200, 100) and got.coef == pytest.approx(b[1], abs=1e-9)
    assert got.auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)
    assert got.brier == pytest.approx(sum((p - y) ** 2 for p, y in test) / 100, abs=1e-9)


def test_studies_run_at_the_counts_of_record():
    assert (studies.NULL_DRAWS, studies.RESAMPLES, studies.FOLDS, studies.ROUNDS, ledger.REPLAYS) == (2000, 2000, 10, 200, 2000)


def test_validation_reports_every_season(spark):
    t = Tables(spark, SF)
    warned = entry.queries()["v02_soft_warnings"](spark, SF).filter("warning like 'no fumbles%'")
    assert sorted(r.season for r in warned.collect()) == sorted(r.season for r in t.pbp.select("season").distinct().collect())
    cases = {(r.season, r.case_name): (r.n_errors, r.n_warnings) for r in entry.queries()["v03_validate_charting"](spark, SF).collect()}
    seasons = [r.season for r in t.charting.select("season").distinct().collect()]
    assert cases == {(s, k): (e, 0) for s in seasons for k, e in {"exact": 0, "more": 1, "few": 1, "duplicated": 1}.items()}


def test_neither_layout_of_the_row_order_check_is_one_partition(spark, monkeypatch):
    from contestry.operators import draws

    summaries, parts = draws.draw_summaries, []

    def spy(games, **options):
        parts.append(games.rdd.getNumPartitions())
        return summaries(games, **options)

    monkeypatch.setattr(draws, "draw_summaries", spy)
    row = entry.queries()["v11_row_order_invariance"](spark, SF).first()
    assert row.layouts_differ == 0 and row.rows > 0
    assert len(parts) == 2 and min(parts) > 1

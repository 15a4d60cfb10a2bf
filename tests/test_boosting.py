"""Boosting by histograms against trees grown one after the other."""

from __future__ import annotations

import math
import random

import pytest

from contestry.operators import boosting
from contestry.operators.boosting import boosted_out_of_fold


def bins_of(values, max_bins):
    known = sorted(v for v in values if v is not None)

    def quantile(q):
        spot = q * (len(known) - 1)
        low = math.floor(spot)
        return known[low] + (spot - low) * (known[min(low + 1, len(known) - 1)] - known[low])

    edges = sorted({quantile(k / max_bins) for k in range(1, max_bins)})
    return [0 if v is None else 1 + sum(e < v for e in edges) for v in values]


def grown(x, r, rows, depth, least, rate, width):
    """Node of each row id -> value, by the same rules, with plain loops."""
    def best(ids):
        total, found = sum(r[i] for i in ids), None
        for f in range(len(x)):
            for cut in range(width - 1):
                left = [i for i in ids if x[f][i] <= cut]
                if len(left) < least or len(ids) - len(left) < least:
                    continue
                g = sum(r[i] for i in left)
                gain = round(g * g / len(left) + (total - g) ** 2 / (len(ids) - len(left)) - total * total / len(ids), 6)
                if gain > 0 and (found is None or gain > found[0]):
                    found = (gain, f, cut)
        return found

    def node(ids, everyone, level, value):
        split = best(ids) if level < depth else None
        if split is None:
            return {i: value for i in everyone}
        _, f, cut = split
        sides = [[i for i in ids if (x[f][i] <= cut) == s] for s in (True, False)]
        out = {}
        for s, side in zip((True, False), sides, strict=True):
            out |= node(side, [i for i in everyone if (x[f][i] <= cut) == s], level + 1, rate * sum(r[i] for i in side) / len(side))
        return out

    return node(rows, range(len(r)), 0, rate * sum(r[i] for i in rows) / len(rows))


@pytest.mark.parametrize("few", [8, 0])
def test_boosting_against_plain_trees(spark, few):
    r = random.Random(2)
    rows = [(k, r.choice([None, *range(9)]), r.uniform(-2, 2), r.randint(0, 3), k % 3) for k in range(240)]
    rows = [(*row, (row[1] or 0) * 0.5 + row[2] ** 2 - row[3] + r.gauss(0, 0.3)) for row in rows]
    sets, folds, rounds, depth, least, rate, max_bins = {"one": ("a",), "all": ("a", "b", "c")}, 3, 7, 3, 8, 0.3, 6
    frame = spark.createDataFrame(rows, "id long, a int, b double, c int, fold int, y double").repartition(5)
    got = boosted_out_of_fold(frame, sets, "y", folds, rounds, rate, depth, least, max_bins, few).collect()
    assert len(got) == len(rows)
    binned = {f: bins_of([row[1 + j] for row in rows], max_bins) for j, f in enumerate(("a", "b", "c"))}
    y = [row[5] for row in rows]
    want = {}
    for name, features in sets.items():
        x = [binned[f] for f in features]
        for fold in range(folds):
            learn = [i for i, row in enumerate(rows) if row[4] != fold]
            p = [sum(y[i] for i in learn) / len(learn)] * len(rows)
            for _ in range(rounds):
                step = grown(x, [a - b for a, b in zip(y, p, strict=True)], learn, depth, least, rate, max_bins + 1)
                p = [v + step[i] for i, v in enumerate(p)]
            want |= {(name, i): p[i] for i, row in enumerate(rows) if row[4] == fold}
    for row in got:
        for name in sets:
            assert abs(row.predicted[name] - want[name, row.id]) < 1e-9


def test_too_few_rows_give_the_mean(spark):
    frame = spark.createDataFrame([(1, None, 0, 4.0), (2, 1.0, 1, 8.0), (3, 1.0, 1, None)], "id long, a double, fold int, y double")
    got = {row.id: row.predicted.only for row in boosted_out_of_fold(frame, {"only": ("a",)}, "y", 2, 3, least=100).collect()}
    assert got == {1: 4.0, 2: 4.0, 3: 4.0}


def test_rows_with_equal_bins_are_passed_over_as_one(spark, monkeypatch):
    rows = [(k % 4, k % 3, float(k % 5)) for k in range(600)]
    frame = spark.createDataFrame(rows, "a int, fold int, y double")
    held = []
    monkeypatch.setattr(boosting, "cells_of", lambda *of, plain=boosting.cells_of: held.append(plain(*of)) or held[0])
    got = boosted_out_of_fold(frame, {"only": ("a",)}, "y", 3, 2, least=5, max_bins=4).collect()
    assert len(got) == 600
    cells = held[0].collect()
    assert len(cells) == 4
    assert sum(sum(c.w) for c in cells) == 600
    assert sum(sum(c.t) for c in cells) == sum(row[2] for row in rows)


@pytest.mark.parametrize("few", [8, 0])
def test_models_grown_alone_and_level_by_level_agree(spark, few):
    r = random.Random(8)
    rows = [(k, r.choice([None, *range(9)]), r.uniform(-2, 2), k % 3, r.gauss(0, 3)) for k in range(300)]
    frame = spark.createDataFrame(rows, "id long, a int, b double, fold int, y double").repartition(4)
    sets = {"one": ("a",), "both": ("a", "b")}
    told = [{x.id: x.predicted for x in boosted_out_of_fold(frame, sets, "y", 3, 5, 0.3, 3, 8, 6, few, alone).collect()} for alone in (boosting.ALONE, 0)]
    assert len(told[0]) == len(told[1]) == 300
    assert all(abs(told[0][k][name] - told[1][k][name]) < 1e-9 for k in told[0] for name in sets)


def test_no_job_for_every_level_where_a_model_fits_in_a_task(spark):
    frame = spark.createDataFrame([(k % 4, k % 3, float(k % 5)) for k in range(600)], "a int, fold int, y double")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())

    def used(rounds):
        before = jobs()
        boosted_out_of_fold(frame, {"only": ("a",)}, "y", 3, rounds, least=5, max_bins=4).collect()
        return jobs() - before

    assert used(6) - used(1) < 3


@pytest.mark.parametrize("alone", [boosting.ALONE, 0])
def test_a_row_of_no_fold_stays_without_a_prediction(spark, alone):
    frame = spark.createDataFrame([(1, 1.0, 0, 4.0), (2, 1.0, 1, 8.0), (3, 2.0, None, 6.0)], "id long, a double, fold int, y double")
    got = {row.id: row.predicted.only for row in boosted_out_of_fold(frame, {"only": ("a",)}, "y", 2, 2, alone=alone).collect()}
    assert set(got) == {1, 2, 3} and got[3] is None and None not in (got[1], got[2])

"""The exact share against all outcomes written out, and with more coins than outcomes fit memory."""

from __future__ import annotations

import itertools
import math

import pytest

from contestry.operators.ledger import exact_share

LEDGER = "component string, game_id string, play_id double, event_class string, actual double, expected double, swing double, class_n long"


def shares(spark, swings, margin):
    rows = [("fumble", "G1", float(i), f"c{i}", float(i % 2), 0.3 + 0.01 * i, s, 50) for i, s in enumerate(swings)]
    games = spark.createDataFrame([("G1", margin)], "game_id string, margin double")
    return rows, exact_share(spark.createDataFrame(rows, LEDGER), games).first()


def chances(rows):
    return [(r[4], r[6] * 0.8389, (r[5] * r[7] + 0.5) / (r[7] + 1.0)) for r in rows]


@pytest.mark.parametrize("margin", [0.0, 3.0, -4.0])
def test_against_all_outcomes(spark, margin):
    rows, got = shares(spark, [1.5, -1.5, 2.25, 2.25, -0.7, 3.1, 1.5, -2.25], margin)
    won = mean = square = 0.0
    for fall in itertools.product((0, 1), repeat=len(rows)):
        d, w = margin, 1.0
        for f, (actual, worth, p) in zip(fall, chances(rows), strict=True):
            d -= (actual - f) * worth
            w *= p if f else 1.0 - p
        won, mean, square = won + w * (round(d, 9) > 0), mean + w * d, square + w * d * d
    assert got.dtw_home == pytest.approx(won, abs=1e-12) and got.coins == 8
    assert got.deserved_mean == pytest.approx(mean, abs=1e-9) and got.deserved_sd == pytest.approx(math.sqrt(square - mean * mean), abs=1e-9)


def test_thirty_four_unlike_coins_fit(spark):
    _, got = shares(spark, [(-1) ** i * math.sqrt(i + 2.0) for i in range(34)], 1.0)
    assert got.coins == 34 and 0.0 < got.dtw_home < 1.0

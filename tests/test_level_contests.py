"""A contest whose values add up to nothing has no leader by the last bit of a sum."""

from __future__ import annotations

from types import SimpleNamespace

from contestry.plans.queries import tables as T


def test_a_level_contest_is_level_in_any_order(spark, monkeypatch):
    noise = 0.1 + 0.2 - 0.3
    assert noise > 0
    rows = [("G1", 2016, 7.0, noise), ("G2", 2016, 7.0, -noise), ("G3", 2016, 7.0, 0.0)]
    monkeypatch.setattr(T, "components", lambda t: spark.createDataFrame(rows, "game_id string, season int, margin double, epa_diff double"))
    got = {(r.grouping, r.key): (r.n, r.win_rate) for r in T.f02(SimpleNamespace()).collect()}
    assert got[("venue", "away team led")] == (3, 0.0) and ("venue", "home team led") not in got

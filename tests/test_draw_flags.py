"""Flags that compare a contest's draws with closed forms allow for the contest's own drawing noise."""

from __future__ import annotations

from types import SimpleNamespace

from contestry.plans.queries import model as M

SCHEMA = "game_id string, " + ", ".join(f"{s}_k long, {s}_n long, {s}_y_mean double, {s}_y_sd double, {s}_n_y long" for s in ("home", "away"))


def tables(spark, rows):
    return SimpleNamespace(deserved=spark.createDataFrame(rows, SCHEMA))


def test_an_end_may_be_off_by_what_its_draws_are(spark):
    # the end of this contest lies four standard errors off, 0.029 as a share
    t = tables(spark, [("G000008059", 19, 31, 9.733333, 9.161953, 30, 23, 37, 12.939394, 7.953463, 33)])
    drawn = M._drawn(t).first()
    assert abs(drawn.p_hi - drawn.closed_hi) > 0.02
    assert M.m06(t).first().ends_ok == 1


def test_an_end_that_is_wrong_is_flagged(spark, monkeypatch):
    t = tables(spark, [("G000008059", 30, 62, 5.5, 6.0, 60, 28, 60, 5.0, 7.0, 58)])
    drawn = M._drawn(t)
    monkeypatch.setattr(M, "_drawn", lambda _: drawn.withColumn("p_hi", drawn.p_hi + 0.1))
    assert M.m06(t).first().ends_ok == 0


def test_points_of_few_plays_are_judged_by_their_own_error(spark):
    rows = [(f"G{i}", 2, 4, 5.0, 20.0, 4, 28, 60, 5.0, 7.0, 58) for i in range(12)]
    t = tables(spark, rows)
    got = M.m04(t).collect()
    assert max(abs(r.home_points - r.closed_home) for r in got) > 0.15
    assert all(r.home_ok and r.away_ok for r in got)
    assert all(r._home_line > 1 and r._away_line < 0.15 for r in got)

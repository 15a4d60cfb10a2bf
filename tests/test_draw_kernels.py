"""Draws of the nulls and resamples: words that decide by their upper bits, groups as arrays."""

from __future__ import annotations

import random

import numpy as np

from contestry.functions.counters import counted, mix32, uniforms
from contestry.operators import drives as DR
from contestry.operators import placement as PL
from contestry.operators.replicates import per_group_arrays


def test_least_keys_where_upper_words_are_equal():
    r = np.random.default_rng(5)
    top = r.integers(0, 6, (400, 30)).astype(np.uint32)  # many are equal across a cut
    tail = r.permuted(np.tile(np.arange(30, dtype=np.uint32), (400, 1)), axis=1)
    parts = PL._least(top, lambda draw: tail[draw], [0, 7, 19])
    for draw in range(400):
        want = np.lexsort((tail[draw], top[draw]))
        assert [sorted(p[draw]) for p in parts] == [[], sorted(want[:7]), sorted(want[7:19])]


def test_bars_are_the_least_numbers_of_a_place():
    r = random.Random(2)
    for _ in range(300):
        upto = np.cumsum([r.choice([1, 2, 3, 1000, 1_234_567, 87_654_321]) for _ in range(r.randint(1, 6))])
        high, low = DR._bars(upto)
        for k, bar in enumerate(upto[:-1].tolist()):
            least = int(high[k]) << 20 | int(low[k])
            place = lambda number: np.floor(np.float64(number) / 4503599627370496.0 * np.float64(upto[-1]))
            assert place(least) >= bar and place(least - 1) < bar


def test_resampled_points_against_a_lookup_in_the_pool(spark):
    r = random.Random(9)
    rows = [(f"g{k % 9}", float(k), k % 2, float(r.choice([0, 0, 3, 6, 7])), 10.0, 10 * (k % 3), 1) for k in range(120)]
    drives = spark.createDataFrame(rows, "game_id string, fixed_drive double, is_home int, points double, depth double, depth_bin int, resampled int").repartition(3)
    table = DR.conditional_points(drives, 5)
    got = {x.game_id: x for x in DR.resample_points(drives, table, 300).collect()}
    pools = {b: sorted(x[3] for x in rows if x[5] == b) for b in (0, 10, 20)}
    import hashlib
    for game in got:
        deltas, drawn = np.zeros(300), 0.0
        for x in (x for x in rows if x[0] == game):
            h = hashlib.md5(f"0:{game}:{int(x[1])}".encode()).hexdigest()
            place = np.floor(uniforms(int(h[:8], 16), int(h[8:16], 16), counted(300)) * len(pools[x[5]])).astype(int)
            points = np.array(pools[x[5]])[place]
            deltas, drawn = deltas + (1 if x[2] == 1 else -1) * (points - x[3]), drawn + points.sum()
        assert np.array_equal(deltas, np.array(got[game].deltas)) and drawn == got[game].drawn
    told = {x.game_id: x for x in DR.resample_summary(drives, table, 300).collect()}
    for game, x in told.items():
        d = np.array(got[game].deltas)
        assert np.allclose([x.reps, x.mean_delta, x.sd_delta, x.low, x.high], [300, d.mean(), d.std(ddof=1), *np.quantile(d, (0.055, 0.945))], atol=1e-12)


def test_summary_and_band_against_the_draws(spark):
    r = random.Random(3)
    rows = [(f"g{k % 4}", "AB"[k % 2], float(k), k, r.randint(1, 4), r.choice(["red_zone", "late_down", "other"]), r.gauss(0, 1)) for k in range(160)]
    plays = spark.createDataFrame(rows, "game_id string, posteam string, play_id double, mix long, down int, cell string, epa_priced double")
    rungs = ("raw", "down_stratified")
    draws = {(x.game_id, x.posteam, x.rung): np.array(x.scores) for x in PL.placement_null(plays, 500, rungs).collect()}
    for x in PL.null_summary(plays, 500, rungs).collect():
        d = draws[x.game_id, x.posteam, x.rung]
        assert np.allclose([x.draws, x.mean, x.sd, x.least, x.most, x.low, x.high], [500, d.mean(), d.std(ddof=1), d.min(), d.max(), *np.quantile(d, (0.055, 0.945))], atol=1e-9)
    for x in PL.null_band(plays, 500).collect():
        d, side = draws[x.game_id, x.posteam, "raw"], [y for y in rows if y[:2] == (x.game_id, x.posteam)]
        mean = sum(y[6] for y in side) / len(side)
        own = sum(y[6] - mean for y in side if y[5] != "other") * PL.C.POINTS_PER_EPA
        assert abs(x.realized - own) < 1e-9 and abs(x.pit - (d < own).mean()) < 1e-9


def test_groups_as_arrays_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(None if k % 5 == 0 else f"k{k % 5}", k) for k in range(50)], "name string, n long")
        each = lambda g: [{"name": g["name"][0], "n": len(g["n"]), "rising": bool((np.diff(g["n"]) > 0).all())}]
        got = per_group_arrays(rows, ["name"], ["n"], each, "name string, n long, rising boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((x.name or "", x.n, x.rising) for x in got) == [("", 10, True), *[(f"k{i}", 10, True) for i in range(1, 5)]]


def test_words_mix_alike_in_rows_and_columns():
    lanes = np.array([3, 1 << 31, 77], dtype=np.uint32)
    assert np.array_equal(mix32(counted(50)[:, None] ^ lanes), mix32(counted(50) ^ lanes[:, None]).T)

"""Commits of season tables: versions, writers side by side, readers and jobs that die."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from contestry.functions.counters import counted, counted_sql, lanes_of, lanes_sql, uniform_sql, uniforms
from contestry.operators import refit as RF
from contestry.sources import seasons as S
from contestry.sources import snapshots as N
from contestry.streaming import readiness as R


def rows(spark, season, n, value=0):
    return spark.range(n).select(F.col("id").alias("play_id"), F.lit("g").alias("game_id"), F.lit(value).alias("value"), F.lit(season).alias("season"))


def test_one_winner_a_version(spark, tmp_path):
    """Writers with equal clocks: every commit gets a number of its own, the last number counts."""
    root, done = str(tmp_path), []

    def write(k):
        for _ in range(6):
            done.append((N.commit(spark, root, [{"dataset": "pbp", "season": 1, "path": f"p{k}", "pulled_at": 5.0, "n_rows": k}]), k))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for v, _ in done) == list(range(1, 25)) and N.latest(spark, root) == 24
    assert N._listed(spark, root)[1] == [16]
    for version in (3, 16, 20, 24):
        row = N.entries(spark, root, version).first()
        assert (row.version, row.n_rows) == (version, dict(done)[version])
    assert not N.put_if_absent(spark, f"{root}/_log/{24:020d}.json", "late")


def test_a_reader_keeps_its_version(spark, tmp_path):
    root = str(tmp_path)
    N.replace_seasons(rows(spark, 2020, 5).unionByName(rows(spark, 2021, 3)), root, "pbp", [2020, 2021])
    reader = S.load_seasons(spark, root, "pbp", [2020, 2021])
    N.replace_seasons(rows(spark, 2020, 7, 1), root, "pbp", [2020])
    assert reader.count() == 8 and reader.agg(F.max("value")).first()[0] == 0
    assert S.load_seasons(spark, root, "pbp", [2020, 2021]).count() == 10
    assert S.load_seasons(spark, root, "pbp", [2020, 2021], version=1).count() == 8
    N.replace_seasons(rows(spark, 2021, 0), root, "pbp", [2021])
    with pytest.raises(S.SeasonMissing, match="2021"):
        S.load_seasons(spark, root, "pbp", [2020, 2021])
    assert N.vacuum(spark, root, "pbp") == 2 and S.load_seasons(spark, root, "pbp", [2020]).count() == 7


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    N.replace_seasons(rows(spark, 2020, 5), root, "pbp", [2020])
    monkeypatch.setattr(N, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        N.replace_seasons(rows(spark, 2020, 9), root, "pbp", [2020])
    monkeypatch.undo()
    assert N.latest(spark, root) == 1 and S.load_seasons(spark, root, "pbp", [2020]).count() == 5
    assert N.vacuum(spark, root, "pbp") == 1  # what it left behind


def test_hashes_do_not_depend_on_the_pieces_alone(spark, tmp_path):
    """A file above the limit is hashed in pieces; a byte in any of them counts."""
    for name in ("a", "b"):
        (tmp_path / name / "x").mkdir(parents=True)
        (tmp_path / name / "x" / "f.parquet").write_bytes(bytes(range(256)) * 40)
    digests = lambda name, piece: {r.file: r.digest for r in S.file_hashes(spark, f"{tmp_path}/{name}", piece).collect()}
    assert len(set(digests("a", 1000).values()) | set(digests("b", 1000).values())) == 1
    for at in (0, 999, 1000, 10239):
        changed = bytearray(bytes(range(256)) * 40)
        changed[at] ^= 1
        (tmp_path / "b" / "x" / "f.parquet").write_bytes(changed)
        assert set(digests("a", 1000).values()) != set(digests("b", 1000).values())


PLAYS = "game_id string, play_id long, home_team string, posteam string, play_type string, epa double, two_point_attempt int, season int"


def plays(spark, game, ids, side, **other):
    return spark.createDataFrame([(game, k, "H", side, "run", other.get("epa", 0.1), 0, 2025) for k in ids], PLAYS)


def test_readiness_writes_what_changed(spark, tmp_path):
    feed, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    schedule = spark.createDataFrame([("g1", 1, 3.0), ("g2", 1, 1.0), ("g3", 2, None), ("g4", 2, 7.0)], "game_id string, week int, result double")

    def poll(*frames):
        for f in frames:
            f.coalesce(1).write.mode("append").parquet(feed)
        R.start_readiness(R.play_stream(spark, feed, f.schema), out, state).awaitTermination()
        return {r.game_id: r.ready for r in R.read_readiness(spark, out, schedule, 3).collect()}

    assert poll(plays(spark, "g1", range(3), "H"), plays(spark, "g1", range(10, 12), "A"), plays(spark, "g2", range(3), "A")) == {"g1": False, "g2": False, "g4": False}
    # a file with plays that were there before, and a late one
    assert poll(plays(spark, "g1", range(10, 12), "A"))["g1"] is False
    assert poll(plays(spark, "g1", [12], "A"), plays(spark, "g3", range(5), "H"))["g1"] is True
    changed = spark.read.option("basePath", out).parquet(out).groupBy("batch").agg(F.sort_array(F.collect_set("game_id")).alias("g")).orderBy("batch").collect()
    assert [r.g for r in changed] == [["g1", "g2"], ["g1"], ["g1", "g3"]]


def test_polling_a_live_season(spark, tmp_path):
    root, feed = str(tmp_path / "root"), f"{tmp_path}/in"
    schedule = spark.createDataFrame([("g1", 1, 3.0), ("g2", 1, 1.0)], "game_id string, week int, result double")

    def poll(pull, *frames):
        for f in frames:
            f.coalesce(1).write.mode("append").parquet(feed)
        told = R.poll_live(R.play_stream(spark, feed, f.schema), schedule, root, pull, 2)
        return {r.game_id: (r.ready, r.fresh) for r in told.collect()}

    assert poll("a", plays(spark, "g1", [1, 2], "H")) == {"g1": (False, False), "g2": (False, False)}
    assert N.latest(spark, root) == 0
    assert poll("b", plays(spark, "g1", [3, 4], "A"))["g1"] == (True, True)
    assert S.load_seasons(spark, root, "pbp", [2025]).count() == 4
    assert poll("c", plays(spark, "g2", [1], "A")) == {"g1": (True, False), "g2": (False, False)} and N.latest(spark, root) == 1
    assert poll("d", plays(spark, "g2", [2], "A"), plays(spark, "g2", [5, 6], "H"))["g2"] == (True, True)
    assert S.load_seasons(spark, root, "pbp", [2025]).count() == 8 and N.latest(spark, root) == 2


def test_a_moved_pin_writes_no_file(spark, tmp_path, monkeypatch):
    w = {"mean": (-16.829, 35.126, 4.178), "cov": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.1)), "sigma2": 60.0, "n_rows": 4190, "margin_sd": 8.875}
    scale = spark.createDataFrame([(5.45281, 5.4527)], "drawn double, exact double")
    monkeypatch.setattr(RF, "fitted_weights", lambda frame: w)
    monkeypatch.setattr(RF, "measured_scale", lambda *a: scale)
    monkeypatch.setattr(RF.B, "gate_games", lambda scores, frame: spark.range(543))
    frame = spark.range(1)
    for name in ("success weight", "noise-once scale", "noise-once floor", "gate games"):
        with pytest.raises(RF.RefitStopped, match=name):
            RF.refit(frame, frame, f"{tmp_path}/w", pins={name: 6.0})
    assert not (tmp_path / "w").exists()
    assert RF.refit(frame, frame, f"{tmp_path}/w")["sigma_once"] == 5.4528
    assert S.load_weights(spark, f"{tmp_path}/w")["n_rows"] == 4190


def test_counters_are_the_same_in_sql():
    import duckdb

    got = duckdb.sql(f"with k as (select {lanes_sql('u', chr(39) + '0:key' + chr(39))}) select rep, u from (select rep, {uniform_sql('u')} from k, {counted_sql(500)}) order by rep").fetchall()
    want = uniforms(*lanes_of("0:key"), counted(500)).tolist()
    assert [u for _, u in got] == want and 0.4 < sum(want) / 500 < 0.6

"""Each check raises even where the caller selects none of the columns it looks at."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from contestry.operators import draws as D
from contestry.operators import features as FE
from contestry.operators import joins as J
from contestry.operators import kicks as K
from contestry.operators import posterior as B
from contestry.operators.ranking import exact_quantiles, hash_rank, with_positions, with_prefix_sum
from contestry.sources import seasons as S
from contestry.streaming.readiness import play_stream, refresh_live
from tests.frames import base, pick, play, plays, scores


def lost_ground(spark):
    """The away side's nine plays gain -3 yards in all."""
    away = [play(100 + i, "AWY", yards_gained=-3.0 if i == 0 else 0.0) for i in range(9)]
    return plays(spark, [*base()[:10], *away, pick(200)])


@pytest.mark.parametrize("build", [FE.team_games_with_yards, FE.team_games_fold, FE.team_games_of_record, lambda p, s: D.score_games(p, s, n_draws=50)])
def test_yards(spark, build):
    with pytest.raises(Exception, match="non-positive yards"):
        build(lost_ground(spark), scores(spark)).select("game_id").collect()


def test_seams(spark):
    frame = FE.team_games_of_record(plays(spark, [*base(), pick(200)]), scores(spark))
    assert D.plug_in_table(frame, scores(spark)).select("game_id").count() == 1
    for broken in (frame.withColumn("own_k_for", F.col("own_k_for") + 1), frame.withColumn("plays_for", F.col("plays_for") + 1), frame.withColumn("own_n_for", F.lit(None).cast("long"))):
        with pytest.raises(Exception, match="folded|misses"):
            B.folded_production(broken).select("game_id").collect()
        with pytest.raises(Exception, match="folded|misses"):
            D.score_games(plays(spark, base()), scores(spark), frame=broken, n_draws=50).select("game_id").collect()


def test_score_by_ids(spark):
    p, s = plays(spark, [*base(), pick(200)]), scores(spark)
    one = D.score_games(p, s, ["2016_01_AWY_HOM", "2016_01_AWY_HOM"], n_draws=50)
    assert one.count() == 1 and len(one.columns) == 29
    with pytest.raises(Exception, match="no scored rows for contest nowhere"):
        D.score_games(p, s, ["2016_01_AWY_HOM", "nowhere"], n_draws=50).select("season").collect()
    ids = D.ordered_ids(spark.createDataFrame([(["b", "a", "b", "c", "a"],)], "ids array<string>")).orderBy("pos").collect()
    assert [r.game_id for r in ids] == ["b", "a", "c"]


def test_missing_side(spark):
    frame = FE.team_games_of_record(plays(spark, [*base(), pick(200)]), scores(spark)).filter("posteam = 'HOM'")
    with pytest.raises(Exception, match="no production"):
        D.sides_side_by_side(frame, scores(spark)).select("game_id").collect()


def test_one_to_one(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    assert J.one_to_one(left, left.withColumnsRenamed({"v": "v2", "w": "w2"}), ["k"]).count() == 2
    with pytest.raises(Exception, match="side repeats 1"):
        J.one_to_one(left.union(left.limit(1)), left.withColumnsRenamed({"v": "v2", "w": "w2"}), ["k"]).select("w2").collect()


def test_attach(spark):
    rows = spark.createDataFrame([("g", 1.0, 0.5, 7.0), ("g", 2.0, -0.5, 8.0)], "game_id string, play_id double, epa double, extra double")
    out = S.attach_columns(rows.drop("extra"), rows, ["extra"]).select("extra").collect()
    assert sorted(r.extra for r in out) == [7.0, 8.0]
    for bad, what in ((rows.union(rows.limit(1)), "repeat"), (rows.withColumn("epa", F.col("epa") + 1), "line up"), (rows.limit(1), "line up")):
        with pytest.raises(Exception, match=what):
            S.attach_columns(rows.drop("extra"), bad, ["extra"]).select("extra").collect()


def test_elevation(spark):
    kicks = spark.createDataFrame([("S1", 1), ("S2", 2)], "stadium_id string, n int")
    with pytest.raises(Exception, match="no elevation for stadium S2"):
        K.with_elevation(kicks, spark.createDataFrame([("S1", 5.0)], "stadium_id string, elev_kft double")).select("n").collect()


def test_scale(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(1, 10)], "margin_var double")
    assert B.pooled_scale(rows, 3.0).first().sigma == pytest.approx(2.0)
    with pytest.raises(Exception, match="median production variance"):
        B.pooled_scale(rows, 2.0).collect()


def test_null_group_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 2), ("a", 3.0, 3)], "g string, v double, id int")
    assert sorted((str(r.g), r.pos) for r in with_positions(df, ["g"], ["v"]).collect()) == [("None", 0), ("None", 1), ("a", 0)]
    assert sorted(r.cum for r in with_prefix_sum(df, ["g"], ["v"], "v").collect()) == [1.0, 3.0, 3.0]
    ranked = hash_rank(df.withColumn("h", F.md5(F.col("id").cast("string"))), ["g"], "h", "id", F.lit(3)).collect()
    assert sorted((str(r.g), r["rank"]) for r in ranked) == [("None", 0), ("None", 1), ("a", 0)]
    assert {(r.g, r.value) for r in exact_quantiles(df, ["v"], [0.5], ["g"]).collect()} == {(None, 1.5), ("a", 3.0)}


@pytest.mark.parametrize("size", [1, 10**6, 10**9])
def test_hash_ranks_do_not_depend_on_the_split(spark, size):
    df = spark.range(500).withColumn("h", F.md5(F.col("id").cast("string")))
    want = [r.id for r in df.orderBy("h", "id").collect()]
    got = hash_rank(df.withColumn("g", F.lit(1)), ["g"], "h", "id", F.lit(size)).orderBy("rank").collect()
    assert [r.id for r in got] == want and [r["rank"] for r in got] == list(range(500))


def test_a_pull_in_many_batches_keeps_all_rows(spark, tmp_path):
    root, schema = f"file:{tmp_path}/root", "season int, game_id string, play_id long, epa double"
    rows = [(2024 + i % 2, f"g{i % 3}", i, float(i)) for i in range(40)]
    S.write_season(spark.createDataFrame([(2023, "old", 1, 0.0), (2024, "stale", 1, 0.0)], schema), root, "pbp")
    pull = spark.createDataFrame([*rows, *rows[:5]], schema)
    pull.repartition(4).write.parquet(f"{root}/in")
    for state in ("one", "two"):  # the second reads the same files again, as a replay would
        refresh_live(play_stream(spark, f"{root}/in", pull.schema, files_per_trigger=1), root, f"{root}/{state}", "pull")
        got = S.load_seasons(spark, root, "pbp", [2023, 2024, 2025]).collect()
        assert sorted((r.season, r.game_id, r.play_id) for r in got) == sorted([(2023, "old", 1), *((s, g, p) for s, g, p, _ in rows)])


def test_a_season_without_fresh_rows_is_emptied(spark, tmp_path):
    root, schema = f"file:{tmp_path}/s", "season int, game_id string"
    S.refresh_schedule(spark.createDataFrame([(2019, "a"), (2020, "b"), (2021, "c")], schema), root, [2019, 2020, 2021])
    S.refresh_schedule(spark.createDataFrame([(2019, "new")], schema), root, [2019, 2020])
    assert sorted((r.season, r.game_id) for r in S.load_schedule(spark, root).select("season", "game_id").collect()) == [(2019, "new"), (2021, "c")]

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from contestry.operators import quality as Q
from contestry.sources import seasons as S


@pytest.fixture(scope="module")
def season(spark):
    n = 6
    return spark.range(n * 160).select(
        F.concat(F.lit("G"), (F.col("id") % n)).alias("game_id"), F.lit(2018).alias("season"), F.lit(1).alias("week"),
        *[F.lit("AA").alias(c) for c in ("posteam", "defteam", "home_team", "away_team", "fumble_recovery_1_team", "penalty_team", "field_goal_result")],
        F.lit("pass").alias("play_type"), F.lit(0.1).alias("epa"), F.lit(1).alias("fumble"),
        *[F.lit(0).alias(c) for c in ("fumble_lost", "interception", "penalty")],
        *[F.lit(1.0).alias(c) for c in ("kick_distance", "penalty_yards", "spread_line")])


def report(df, **kw):
    return Q.validate_plays(df, 2018, **{"expected": 6, **kw}).first()


def test_clean_season_passes(season):
    row = report(season)
    assert row.errors == [] and row.warnings == [] and (row.n_rows, row.n_games) == (960, 6)


@pytest.mark.parametrize(("change", "word"), [
    (lambda d: d.drop("epa"), "missing required"), (lambda d: d.limit(0), "zero rows"),
    (lambda d: d.filter("game_id <> 'G0'"), "5 games, expected 6"), (lambda d: d.unionByName(d), "over 300"),
    (lambda d: d.withColumn("season", F.lit(2017)), "season other"), (lambda d: d.withColumn("epa", F.lit(None).cast("double")), "epa null"),
])
def test_each_error(season, change, word):
    assert any(word in e for e in report(change(season)).errors)


def test_partial_demotes_shortfalls_only(season):
    few = season.filter("game_id <> 'G0'")
    row = report(few, partial=True)
    assert row.errors == [] and "so far" in row.warnings[0]
    assert report(season.unionByName(season), partial=True).errors


def test_ingest_refuses_records_and_reads_back(spark, season, tmp_path):
    root = f"file:{tmp_path}"
    with pytest.raises(S.SeasonRefused):
        S.ingest_season(season.drop("epa"), root, "pbp", 2018, expected=6)
    S.ingest_season(season, root, "pbp", 2018, expected=6)
    S.ingest_season(season, root, "pbp", 2018, expected=6)
    assert S.read_manifest(spark, root).count() == 1 and S.is_cached(spark, root, "pbp", 2018)
    assert S.load_seasons(spark, root, "pbp", [2018], ["game_id", "epa"]).count() == 960
    with pytest.raises(S.SeasonMissing, match="2019"):
        S.load_seasons(spark, root, "pbp", [2018, 2019])


def test_weights_artifact_is_pinned(spark, tmp_path):
    S.weights_row(spark).write.json(f"{tmp_path}/w")
    assert S.load_weights(spark, f"{tmp_path}/w")["n_rows"] == 4190
    S.weights_row(spark).withColumn("margin_sd", F.lit(9.0)).write.json(f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="margin_sd"):
        S.load_weights(spark, f"{tmp_path}/bad")

"""The ledger reads the plays a few times, whatever reads its events."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contestry.operators import ledger as L
from contestry.operators import placement as PL
from contestry.plans.tables import Tables

SF = "/root/testdata/sf0.001"


def test_each_kind_of_event_is_one_scan(spark):
    plays = Tables(spark, SF).pbp.localCheckpoint()
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = plays.mapInArrow(counting, plays.schema)
    rows = L.full_ledger(counted).count()
    assert rows > 0 and read.value <= 4 * plays.count()


@pytest.mark.parametrize("name", ["m09_luck_ledger", "f40_priced_plays", "f41_cell_table", "m22_null_bands"])
def test_against_the_registered_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
    assert got and got == sorted(map(repr, want))


def test_luck_of_a_play_meets_all_its_rows(spark):
    plays = spark.createDataFrame(
        [("g1", 1.0, "A"), ("g1", 1.0, "B"), ("g1", 2.0, "A"), ("g1", None, "A"), ("g2", 1.0, "A")], "game_id string, play_id double, posteam string").withColumns({
            "home_team": F.lit("A"), "season": F.lit(2016), "epa": F.lit(1.0), "down": F.lit(1), "play_type": F.lit("run"), "yardline_100": F.lit(50.0)})
    luck = spark.createDataFrame([("g1", 1.0, 0.25), ("g1", 1.0, 0.25), ("g1", None, 9.0), ("g3", 1.0, 9.0)], "game_id string, play_id double, luck_epa double")
    games = spark.createDataFrame([("g1",), ("g3",)], "game_id string")
    got = sorted((r.posteam, r.play_id or 0.0, r.epa_priced) for r in PL.priced_plays(plays, luck, games).collect())
    assert got == [("A", 0.0, 1.0), ("A", 1.0, 0.5), ("A", 2.0, 1.0), ("B", 1.0, 1.5)]

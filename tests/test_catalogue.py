from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_query_has_a_contract():
    assert len(entry.queries()) > 220
    assert len(entry.oracle_sql()) > 200


@pytest.mark.parametrize("name", ["m07_plug_in_scores", "f20_drive_summary_rows", "m09_luck_ledger", "w02_meeting_index", "c01_verdict_buckets"])
def test_against_the_oracle_at_the_smallest_size(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
    want = sorted(map(repr, con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()))
    assert got == want

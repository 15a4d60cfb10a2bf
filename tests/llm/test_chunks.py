"""Chunks of token alignment: a task holds a few at a time, whatever the table's size."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest

from contestry.llm import token_alignment


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, f"token {k % 7} of unbelievable alignment {k}") for k in range(60)], "doc_id long, text string").coalesce(1)


def test_a_chunk_is_a_row_group(docs, monkeypatch):
    written, plain = [], token_alignment.staged

    def spy(df, *more):
        written.append(plain(df, *more))
        return written[-1]

    monkeypatch.setattr(token_alignment, "staged", spy)
    assert token_alignment.align_texts(docs, together=60, chunk_entries=20).count() == 60
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written[0].inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 5 and set(groups) == {1}


def test_answers_of_a_chunk_come_in_pieces_and_not_as_one_list(spark, docs):
    whole = sorted(token_alignment.align_texts(docs).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pieces = token_alignment.align_texts(docs, together=200, chunk_entries=50)
        assert sorted(pieces.collect()) == whole
        assert "collect_list" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

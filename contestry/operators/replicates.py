"""Studies of many replicates: a group's replicates are one vector, summed as its rows stream by.

Rows are dealt by group before any replicate is made, so what is shuffled does not depend on
how many there are, and a task holds one vector (or one group's few rows) at a time. A
contest, a side or a drive has at most the plays of one contest, which the season's gate bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 2048


def _dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    # (a number is given because the rows are few bytes and many draws: sized by bytes they would share one task)
    width = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(width, *keys).sortWithinPartitions(*keys, *order)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from batch.slice(at, ROWS).to_pylist()


def _written(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def mapped(rows: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterable[dict]]) -> DataFrame:
    """The rows that ``work`` makes of each partition's rows, in batches."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written(work(_read(batches)), arrow)

    return rows.mapInArrow(run, schema)


def vector_totals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], vector: Callable[[dict], np.ndarray],
                  finish: Callable[[dict, np.ndarray, int], dict], schema: str) -> DataFrame:
    """One row per group: the element-wise sum of ``vector(row)`` over its rows, in ``order``,
    turned into columns by ``finish(last row, sums, number of rows)``."""

    def work(stream: Iterator[dict]) -> Iterator[dict]:
        last: dict | None = None
        total, n = np.zeros(0), 0
        for row in stream:
            if last is not None and any(last[k] != row[k] for k in keys):
                yield {k: last[k] for k in keys} | finish(last, total, n)
                last = None
            v = vector(row)
            total, n = (v, 1) if last is None else (total + v, n + 1)
            last = row
        if last is not None:
            yield {k: last[k] for k in keys} | finish(last, total, n)

    return mapped(_dealt(rows, keys, order), schema, work)


def per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str], each: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """The rows that ``each`` makes of one group's rows, which come in ``order``."""

    def work(stream: Iterator[dict]) -> Iterator[dict]:
        held: list[dict] = []
        for row in stream:
            if held and any(held[0][k] != row[k] for k in keys):
                yield from each(held)
                held = []
            held.append(row)
        if held:
            yield from each(held)

    return mapped(_dealt(rows, keys, order), schema, work)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(at).to_numpy(zero_copy_only=False) for at, name in enumerate(batch.schema.names)}


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Places where another group begins than that of the row before; equal nulls are one group."""
    other = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for key in keys:
        column = batch.column(batch.schema.get_field_index(key))
        a, b = column[:-1], column[1:]
        other |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(other) + 1


def per_group_arrays(rows: DataFrame, keys: Sequence[str], order: Sequence[str], each: Callable[[dict[str, np.ndarray]], Iterable[dict]], schema: str) -> DataFrame:
    """The rows that ``each`` makes of one group's columns, an array each, whose rows come in ``order``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held: list[dict[str, np.ndarray]] = []
        whole = lambda: held[0] if len(held) == 1 else {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _columns(batch)
            if held and any(held[-1][k][-1] != columns[k][0] for k in keys):
                yield whole()
                held = []
            cuts = [0, *_starts(batch, keys).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.append({k: c[a:b] for k, c in columns.items()})
                if b < batch.num_rows:
                    yield whole()
                    held = []
        if held:
            yield whole()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _written((row for group in groups(batches) for row in each(group)), arrow)

    return _dealt(rows, keys, order).mapInArrow(run, schema)


def sorted_quantile(ordered: np.ndarray, q: float) -> float:
    """Linearly interpolated quantile of a sorted array."""
    spot = (len(ordered) - 1) * q
    low = int(spot)
    a, b = float(ordered[low]), float(ordered[min(low + 1, len(ordered) - 1)])
    return a + (spot - low) * (b - a)

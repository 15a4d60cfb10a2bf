"""The catalogue of registered queries.

Each entry carries a Spark builder over :class:`Tables`, an output contract
(``name:type`` pairs) and, where the semantics allow, an oracle in plain SQL over the
same tables. The contract is applied to both sides, so their schemas always agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.plans.oracle_tables import CTES
from contestry.plans.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None
    tables: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, tables: str = ""):
    """Register a builder; ``tables`` names the oracle's shared inputs."""

    def wrap(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        spec = tuple(tuple(c.split(":")) for c in columns.split())
        QUERIES[name] = Query(name, spec, build, sql, tuple(tables.split()))
        return build

    return wrap


def _shape(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "d":
        # the nudge settles exact seventh-digit ties the same way in both engines
        return F.round(c.cast("double") + F.lit(3e-10), 6).alias(name)
    return c.cast("string").alias(name)


def _shape_sql(name: str, kind: str) -> str:
    if kind == "i":
        return f'cast("{name}" as bigint) as "{name}"'
    if kind == "d":
        return f'round(cast("{name}" as double) + 3e-10, 6) + 0.0 as "{name}"'
    return f'cast("{name}" as varchar) as "{name}"'


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = QUERIES[name]
    return entry.build(Tables(spark, sf_dir)).select(*[_shape(n, k) for n, k in entry.columns])


def oracle(name: str) -> str | None:
    entry = QUERIES[name]
    if entry.sql is None:
        return None
    wanted: list[str] = []

    def visit(table: str) -> None:
        for dep in CTES[table][0]:
            visit(dep)
        if table not in wanted:
            wanted.append(table)

    for table in entry.tables:
        visit(table)
    ctes = [f"{t} as ({CTES[t][1]})" for t in wanted] + [f"answer as ({entry.sql})"]
    shape = ", ".join(_shape_sql(n, k) for n, k in entry.columns)
    return "with " + ",\n".join(ctes) + f"\nselect {shape} from answer"

"""Guarded joins and row-set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.functions.columns import guarded


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose two sides must be unique on the keys; a duplicate raises in the plan.

    Each side is reduced to its keys with a row count first, so a duplicated key never
    multiplies rows before it is reported.
    """
    def unique(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in rest])
        message = F.concat(F.lit(f"{side} side repeats "), F.concat_ws(" ", *keys))
        return guarded(grouped, F.col("_n") > 1, message).drop("_n")

    return unique(left, "left").join(unique(right, "right"), keys, how)


def checked_left(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Left join plus a one-row report: rows before, rows after, keys that repeat on the right."""
    joined = left.join(right, keys, "left")
    repeats = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    extra = left.join(repeats, keys).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("added_rows"))
    counts = left.agg(F.count(F.lit(1)).alias("rows_before"), extra.scalar().alias("added_rows"))
    return joined, counts.withColumn("unchanged", (F.col("added_rows") == 0).cast("int"))


def cardinality(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys, repeated keys; two aggregates, no distinct expansion."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("c") > 1).alias("repeated"))


def override(base: DataFrame, wins: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wins`` replace the same-key rows of ``base``."""
    kept = base.join(wins.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*wins.columns).unionByName(wins)


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on coalesced keys."""
    return left.join(right, keys, "full")


def unpivot_sides(games: DataFrame, home: str, away: str, home_value: str, away_value: str,
                  team: str, value: str) -> DataFrame:
    """Two rows per contest from one scan: each side with its own value."""
    pair = F.array(F.struct(F.col(home).alias(team), F.col(home_value).alias(value)),
                   F.struct(F.col(away).alias(team), F.col(away_value).alias(value)))
    return games.select("game_id", F.explode(pair).alias("s")).select("game_id", "s.*")


def union_loose(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks become null and numeric types widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_strict(frames: list[DataFrame]) -> DataFrame:
    names = frames[0].columns
    for f in frames[1:]:
        if sorted(f.columns) != sorted(names):
            raise ValueError(f"columns differ: {sorted(set(f.columns) ^ set(names))}")
    return reduce(DataFrame.unionByName, frames)


def membership(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side once, tagged both, left or right."""
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    both = tagged.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    where = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left").otherwise("right")
    return both.select(*keys, where.alias("where"))


def top_by(df: DataFrame, keys: dict[str, tuple], limit: int, id_col: str) -> DataFrame:
    """The first rows under each of several orders, merged with the reasons they were kept.

    Each order is a top-k: only ``limit`` rows per task and order ever move.
    """
    parts = [df.orderBy(*order).limit(limit).select(id_col, F.lit(reason).alias("reason"))
             for reason, order in keys.items()]
    merged = reduce(DataFrame.unionByName, parts)
    return merged.groupBy(id_col).agg(
        F.concat_ws(",", F.sort_array(F.collect_set("reason"))).alias("reasons"))


def extremes(df: DataFrame, column: str, limit: int, id_col: str) -> DataFrame:
    """Bottom and top rows of a column, tagged."""
    low = df.orderBy(F.col(column).asc(), id_col).limit(limit).withColumn("end", F.lit("low"))
    high = df.orderBy(F.col(column).desc(), id_col).limit(limit).withColumn("end", F.lit("high"))
    return low.unionByName(high)

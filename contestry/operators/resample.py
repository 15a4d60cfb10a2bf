"""Resampling whose randomness is a hash of (seed, replicate, key): any layout, same answer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions.columns import digest, ratio
from contestry.functions.counters import STEP, lanes_of, mix32, uniforms
from contestry.operators.ranking import HASH_PIECE, hash_rank, with_positions, with_prefix_sum
from contestry.operators.replicates import mapped, per_group, per_group_arrays, vector_totals
from contestry.session import cut_lineage


def kept_entities(units: DataFrame, entity: str, min_units: int) -> DataFrame:
    """Units of entities with enough of them, with the entity's size beside each."""
    sizes = units.groupBy(entity).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_units)
    return units.join(sizes, entity)


def dealt_halves(units: DataFrame, entity: str, unit: str, splits: int, seed: int = 0) -> DataFrame:
    """Every unit in every split, flagged for half A: the lowest floor(size / 2) digests."""
    laid = units.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    key = F.concat_ws("|", F.col(entity), F.col(unit))
    laid = laid.withColumns({"_key": key, "_hex": digest(seed, F.col("split"), key)})
    ranked = hash_rank(laid, ["split", entity], "_hex", "_key", F.col("size"), "_r")
    return ranked.withColumn("in_a", F.col("_r") < F.floor(F.col("size") / 2)).drop("_r", "_key", "_hex")


#: Splits of an entity that are dealt together.
SPLITS_TOGETHER = 50


def _half_sums(kept: DataFrame, entity: str, unit: str, terms: dict[str, Column], splits: int, seed: int) -> DataFrame:
    """Per split and entity the sums of the terms in half A (``<term>a``) and in all: an entity's units meet once for
    ``SPLITS_TOGETHER`` splits, and their digests are made and compared where they lie, never shuffled."""
    laid = kept.select(entity, F.concat_ws("|", F.col(entity), F.col(unit)).alias("_key"), *[v.cast("double").alias(k) for k, v in terms.items()],
                       F.explode(F.sequence(F.lit(0), F.lit(splits - 1), F.lit(SPLITS_TOGETHER))).alias("_from"))

    names = list(terms)

    def each(rows: list[dict]) -> Iterator[dict]:
        keys = [r["_key"].encode() for r in rows]
        given = {k: np.array([r[k] is not None for r in rows]) for k in names}
        known = {k: np.array([0.0 if r[k] is None else r[k] for r in rows]) for k in names}
        for split in range(rows[0]["_from"], min(rows[0]["_from"] + SPLITS_TOGETHER, splits)):
            start = f"{seed}:{split}:".encode()
            words = np.frombuffer(b"".join(md5(start + k).digest() for k in keys), ">u8").reshape(-1, 2)
            in_a = np.lexsort((words[:, 1], words[:, 0]))[: len(rows) // 2]  # stable: equal digests by key
            out = {"split": split, entity: rows[0][entity]}
            for k in names:
                out[f"{k}a"] = float(known[k][in_a].sum()) if given[k][in_a].any() else None
                out[k] = float(known[k].sum()) if given[k].any() else None
            yield out

    kinds = ", ".join(f"{k}a double, {k} double" for k in terms)
    return per_group(laid, [entity, "_from"], ["_key"], each, f"split int, {entity} {kept.schema[entity].dataType.simpleString()}, {kinds}")


def split_half(units: DataFrame, entity: str, unit: str, values: dict[str, tuple[str, str | None]], splits: int,
               min_units: int = C.MIN_GAMES, seed: int = 0, held: int = HASH_PIECE) -> DataFrame:
    """Correlation of the two halves per split and measure.

    ``values`` maps a measure to (numerator, denominator): with a denominator the sums are
    pooled, without one the unit values are averaged. Half B is the total less half A. The units of an
    entity are held together; one of more than ``held`` is ranked in pieces instead.
    """
    kept = kept_entities(units, entity, min_units)
    terms: dict[str, Column] = {}
    for name, (num, den) in values.items():
        terms |= {f"{name}_n": F.col(num), f"{name}_d": F.col(den).cast("double") if den else F.when(F.col(num).isNotNull(), 1.0)}
    small = _half_sums(kept.filter(F.col("size") <= held), entity, unit, terms, splits, seed)
    halves = dealt_halves(kept.filter(F.col("size") > held), entity, unit, splits, seed)
    sums = halves.groupBy("split", entity).agg(
        *[x for k, v in terms.items() for x in (F.sum(F.when(F.col("in_a"), v)).cast("double").alias(f"{k}a"), F.sum(v).cast("double").alias(k))])
    sums = small.unionByName(sums)
    pairs = []
    for name in values:
        a = ratio(f"{name}_na", f"{name}_da")
        b = ratio(F.col(f"{name}_n") - F.col(f"{name}_na"), F.col(f"{name}_d") - F.col(f"{name}_da"))
        pairs.append(F.corr(a, b).alias(name))
    return sums.groupBy("split").agg(*pairs, F.count(F.lit(1)).alias("entities"))


def reliability(by_split: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Mean correlation, its spread over splits and the full-length reliability.

    One row per split: the percentile's state is bounded by the number of splits.
    """
    from contestry.operators.stats import spearman_brown

    long = by_split.unpivot(["split", "entities"], list(measures), "measure", "r")
    return long.groupBy("measure").agg(
        F.avg("r").alias("mean_r"), F.percentile("r", 0.055).alias("low"), F.percentile("r", 0.945).alias("high"),
        F.max("entities").alias("entities")).withColumn("full_length", spearman_brown(F.col("mean_r")))


def permuted_entities(units: DataFrame, entity: str, unit: str, reps: int, min_units: int = C.MIN_GAMES,
                      seed: int = 0) -> DataFrame:
    """Whole units dealt into synthetic entities of the same sizes, once per replicate.

    The slots are the real units in a fixed order; a replicate re-deals the units by hash
    rank, and slot and unit meet on that rank.
    """
    kept = kept_entities(units, entity, min_units)
    slots = with_positions(kept.select(entity, unit), [], [entity, unit], "_slot").select(
        F.col(entity).alias("_entity"), "_slot")
    key = F.concat_ws("|", F.col(entity), F.col(unit))
    laid = kept.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumns(
        {"_key": key, "_hex": digest("perm", seed, F.col("rep"), key)})
    total = kept.agg(F.count(F.lit(1))).scalar()
    ranked = hash_rank(laid, ["rep"], "_hex", "_key", total, "_slot").drop("_key", "_hex", entity, "size")
    return ranked.join(slots, "_slot").withColumnRenamed("_entity", entity).drop("_slot")


#: Cells (replicates times entities, or times digest bins) that one task holds.
CELLS_HELD = 1 << 22


def _digests(start: bytes, keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(md5(start + k).digest() for k in keys), ">u8").reshape(-1, 2).astype(np.uint64)


def permuted_sums(units: DataFrame, entity: str, unit: str, terms: dict[str, Column], reps: int,
                  min_units: int = C.MIN_GAMES, seed: int = 0, held: int = CELLS_HELD) -> DataFrame:
    """Per replicate and synthetic entity the sums of the terms (null counts as 0) over the units that
    ``permuted_entities`` deals to it.

    The slots of an entity are consecutive ranks, so a replicate is cut at the entities' ends. Two passes over the units,
    which are not shuffled: the first counts them by the leading bits of their digests, the second sums the bins up that
    lie within one entity. Only the units of the bins in which a cut falls are ranked one by one. Counts and sums are held
    for all replicates, so where entities times replicates are more than ``held``, the units are dealt as rows.
    """
    kept = cut_lineage(kept_entities(units, entity, min_units).select(
        entity, F.concat_ws("|", F.col(entity), F.col(unit)).alias("_key"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in terms.items()]))
    names, spark = list(terms), units.sparkSession
    sizes = kept.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    ends = with_prefix_sum(sizes, [], [entity], "_n", "_end").select(entity, F.col("_end").cast("long").alias("_end"))
    if sizes.count() * reps > held:
        dealt = permuted_entities(units.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in terms.items()}), entity, unit, reps, min_units, seed)
        return dealt.groupBy("rep", entity).agg(*[F.sum(k).alias(k) for k in names])
    cuts = np.array(sorted(r._end for r in ends.collect()), dtype=np.int64)  # at most ``held`` by ``reps``
    if not len(cuts):
        return spark.createDataFrame([], f"rep int, {entity} {kept.schema[entity].dataType.simpleString()}, " + ", ".join(f"{k} double" for k in names))
    bits = max(1, min(13, int(cuts[-1]).bit_length() - 4, (held // reps).bit_length() - 1))
    # (a number is given because the rows are few bytes and many digests: sized by bytes they would share one task; a task a
    # core, since each holds all bins)
    laid = kept.select("_key", *names).repartition(spark.sparkContext.defaultParallelism)

    def counted_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((reps, 1 << bits), dtype=np.int32)
        for batch in batches:
            keys = [k.encode() for k in batch.column(0).to_pylist()]
            for rep in range(reps if keys else 0):
                found[rep] += np.bincount((_digests(f"perm:{seed}:{rep}:".encode(), keys)[:, 0] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if found.any():
            yield pa.RecordBatch.from_pydict({"rep": pa.array(range(reps), pa.int32()), "found": [row.tobytes() for row in found]})

    def before(r: dict, total: np.ndarray, n: int) -> dict:
        return {"before": (np.cumsum(total) - total).tobytes()}

    bins = vector_totals(laid.mapInArrow(counted_bins, "rep int, found binary"), ["rep"], [], lambda r: np.frombuffer(r["found"], dtype=np.int32).astype(np.int64), before, "rep int, before binary")
    first = np.stack([np.frombuffer(r.before, dtype=np.int64) for r in sorted(bins.collect(), key=lambda r: r.rep)])  # replicates times bins
    ranks = spark.sparkContext.broadcast(first)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = ranks.value
        last = np.maximum(np.concatenate((starts[:, 1:], np.full((reps, 1), cuts[-1])), axis=1) - 1, starts)
        slot, whole = np.searchsorted(cuts, starts, side="right"), np.searchsorted(cuts, last, side="right")
        sums = {k: np.zeros((reps, len(cuts))) for k in names}
        told = lambda rep, slot, at, high, low, values: pa.RecordBatch.from_pydict({
            "rep": pa.array(np.full(len(slot), rep, dtype=np.int32)), "slot": pa.array(slot), "at": pa.array(at), "high": pa.array(high), "low": pa.array(low), **{k: pa.array(v) for k, v in values.items()}})
        for batch in batches:
            keys = [k.encode() for k in batch.column("_key").to_pylist()]
            values = {k: batch.column(k).to_numpy() for k in names}
            for rep in range(reps if keys else 0):
                words = _digests(f"perm:{seed}:{rep}:".encode(), keys)
                at = (words[:, 0] >> np.uint64(64 - bits)).astype(np.int64)
                inside = slot[rep, at] == whole[rep, at]
                for k in names:
                    sums[k][rep] += np.bincount(slot[rep, at[inside]], values[k][inside], minlength=len(cuts))
                if not inside.all():
                    out = ~inside
                    signed = words[out].view(np.int64) ^ np.int64(-(1 << 63))  # in the order of the unsigned words
                    yield told(rep, np.full(int(out.sum()), -1, dtype=np.int64), starts[rep, at[out]], signed[:, 0].copy(), signed[:, 1].copy(), {k: v[out] for k, v in values.items()})
        for rep in range(reps):
            yield told(rep, np.arange(len(cuts)), *[np.zeros(len(cuts), dtype=np.int64)] * 3, {k: v[rep] for k, v in sums.items()})

    kinds = ", ".join(f"{k} double" for k in names)
    parts = cut_lineage(laid.mapInArrow(summed, f"rep int, slot long, at long, high long, low long, {kinds}"))

    def ranked(rows: dict[str, np.ndarray]) -> Iterator[dict]:
        slots = np.searchsorted(cuts, rows["at"][0] + np.arange(len(rows["at"])), side="right")
        for one in np.unique(slots):
            yield {"rep": int(rows["rep"][0]), "slot": int(one)} | {k: float(rows[k][slots == one].sum()) for k in names}

    edges = per_group_arrays(parts.filter("slot = -1"), ["rep", "at"], ["high", "low"], ranked, f"rep int, slot long, {kinds}")
    whole = parts.filter("slot >= 0").select("rep", "slot", *names)
    sums = whole.unionByName(edges).groupBy("rep", "slot").agg(*[F.sum(k).alias(k) for k in names])
    named = ends.select(entity, F.udf(lambda end: int(np.searchsorted(cuts, end)), "long")("_end").alias("slot"))
    return sums.join(named, "slot").select("rep", entity, *names)


#: Units whose values one task holds, and replicates that it draws.
BLOCK, TOGETHER = 1 << 20, 50


def bootstrap(units: DataFrame, key: str, sums: dict[str, Column], stats: dict[str, Column], reps: int,
              seed: int = 0, group: Sequence[str] = ()) -> DataFrame:
    """Statistics of units drawn with replacement, one row per replicate.

    A draw is an index, made from the replicate and the draw's number alone. Units lie in blocks
    of consecutive indices; a task makes all draws of its replicates again and adds up those
    that fall into its block. No draw is ever shuffled: what moves are the blocks, once for each
    ``TOGETHER`` replicates, and one row of sums a block and replicate.
    """
    group, names = list(group), list(sums)
    placed = with_positions(units.select(*group, key, *[v.cast("double").alias(k) for k, v in sums.items()]), group, [key], "_i")
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    packed = placed.withColumn("_block", F.floor(F.col("_i") / BLOCK)).groupBy(*group, "_block").agg(
        F.array_sort(F.collect_list(F.struct("_i", *names))).alias("_rows"))
    met = packed.join(sizes, group) if group else packed.withColumn("_n", sizes.select("_n").scalar())
    laid = met.select(*group, "_block", "_n", *[F.col(f"_rows.{k}").alias(k) for k in names], F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(TOGETHER))).alias("_from"))
    laid = laid.repartition(4 * units.sparkSession.sparkContext.defaultParallelism, *group, "_block", "_from")
    kinds = ", ".join(f"{g} {units.schema[g].dataType.simpleString()}" for g in group)
    schema = ", ".join([*([kinds] if group else []), "rep int", *[f"{k} double" for k in names], "drawn long"])

    def draws(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            values = {k: np.array([np.nan if v is None else v for v in r[k]], dtype=float) for k in names}
            first, held, n = r["_block"] * BLOCK, len(next(iter(values.values()))), r["_n"]
            for rep in range(r["_from"], min(r["_from"] + TOGETHER, reps)):
                high, low = lanes_of(":".join([str(seed), str(rep), *[str(r[g]) for g in group]]))
                out = {g: r[g] for g in group} | {"rep": rep, "drawn": 0} | dict.fromkeys(names, 0.0)
                for at in range(0, n, BLOCK):
                    numbers = mix32(np.arange(at, min(at + BLOCK, n), dtype=np.uint32) * np.uint32(STEP))
                    spot = np.minimum(np.floor(uniforms(high, low, numbers) * n), n - 1).astype(np.int64) - first
                    spot = spot[(spot >= 0) & (spot < held)]
                    out["drawn"] += len(spot)
                    for k in names:
                        out[k] += float(np.nansum(values[k][spot]))
                yield out

    per = mapped(laid, schema, draws)
    return per.groupBy(*group, "rep").agg(*[F.sum(k).alias(k) for k in names], F.sum("drawn").alias("drawn")).withColumns(stats)


def summarize_draws(draws: DataFrame, value: str) -> DataFrame:
    """Mean and 95% interval of one number per replicate; the percentiles hold the replicates."""
    out = draws.agg(
        F.avg(value).alias("mean"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"),
        F.avg((F.col(value) < 0).cast("double")).alias("share_below_zero"), F.count(F.lit(1)).alias("reps"))
    return out

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is exponential, -ln(u) over its quality weight, with u from a digest. Within a
source, documents in key order are a weighted sample without replacement; their running sum of
words is cut at the source's budget. Whole epochs come first, the order decides only the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.llm.common import hashed_unit, staged

#: Bins of the key within a source; only the bin that a budget cuts is ever sorted.
BINS = 4096


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A weight in 0.1 to 1.1: the share of the text's characters that are no ASCII mark."""
    n = F.length(text)
    return F.coalesce(F.when(n > 0, F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", "")) / n), F.lit(0.0)) + F.lit(0.1)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from one row for each source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all
    words; no target exceeds ``most`` times its source's size, and what is above is shared anew
    by weight. The level at which that settles is read off running sums over sources in the
    order in which they fill up.
    """
    ranked = sizes.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("r") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    filling = Window.orderBy(F.col("cap") / F.col("w"), "r")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("cap") / F.col("w"), "r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    # the first source that the level of those after it no longer fills
    settled = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("r"), F.col("level")))).over(everything)
    settled = settled.getField("level")
    return levels.withColumn("at", settled).select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text: str, source: str, quality: Column | None, seed: int) -> DataFrame:
    t = F.col(text)
    weight = text_quality(t) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(1.0)), F.lit(1e-3))
    key = -F.log(hashed_unit(F.col(id_col), seed=seed)) / weight
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(t).alias("size"), key.alias("key"),
        F.xxhash64(F.coalesce(t, F.lit(""))).alias("text_hash"),
    )
    # a monotone map of the key to bins, nearly even whatever the weights are
    return keyed.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * BINS).cast("int"))


def _budgets(slim: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: its target, whole epochs, words left for the last, and the bin they end in."""
    bins = staged(slim.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").cast("long").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs)
    targets = targets.withColumn("left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")).withColumnRenamed("source", "s")
    targets = staged(targets)
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    begun = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(running), F.lit(0)))
    cut = begun.join(targets.select("s", "left"), F.col("source").eqNullSafe(F.col("s"))).filter("before <= left and left < before + bin_size")
    cut = cut.groupBy(F.col("s").alias("c")).agg(F.min("bin").alias("cut_bin"), F.min("before").alias("cut_before"))
    return staged(targets.join(cut, F.col("s").eqNullSafe(F.col("c")), "left").drop("c"))


def _taken(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``rows`` with their source's budget and ``taken``. Bins before the cut are taken whole and
    later ones not at all; only the rows of the cut bin are ordered."""
    met = rows.join(budgets, F.col("source").eqNullSafe(F.col("s")))
    at_cut = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    ordered = met.filter(at_cut).withColumn("room", F.col("left") - F.col("cut_before") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rest = met.filter(~at_cut).withColumn("room", F.when(F.col("bin") < F.col("cut_bin"), F.col("left")).otherwise(F.lit(0)))
    last = F.greatest(F.lit(0), F.least("size", "room"))
    return ordered.unionByName(rest).withColumn("taken", (F.col("epochs") * F.col("size") + last).cast("long")).withColumn("target", F.round(F.col("target") + F.lit(3e-10), 6))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """One row for each row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` counts the words that the mix takes of the document: its size for each whole epoch
    of its source, and in the last, partial epoch again its size, or nothing, or, for the one
    document in which the budget ends, what is left of it, so that a source's words are its
    target rounded down. Null texts and texts of white space have size 0 and give nothing; null
    sources are a source; rows that repeat an id are rows of their own, equal in key and told
    apart by size and text only, and a null id is an id. An empty table gives no rows.
    """
    slim = staged(_keyed(docs, id_col, text, source, quality, seed).drop("row"))
    return _taken(slim, _budgets(slim, weights, share, most)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_rows(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """The rows of which :func:`mix` takes words, with ``size``, ``source_size``, ``target`` and
    ``taken`` beside their own columns (columns of those names are replaced). No text is moved
    but that of the bins which a budget cuts."""
    keyed = _keyed(docs, id_col, text, source, quality, seed)
    budgets = _budgets(staged(keyed.select("source", "bin", "size")), weights, share, most)
    new = ["size", "source_size", "target", "taken"]
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    return _taken(keyed, budgets).filter("taken > 0").select(*own, *new)

"""Positions, prefix sums, quantiles and bounded frames that survive hot keys.

A window sorts one whole group in one task. Here a group may hold a third of all rows,
so order is made with a range exchange instead: rows are range-partitioned and sorted,
the sorted pieces are written to the checkpoint folder, and only the per-piece totals
(one row per piece and group) are combined. Hash-ordered ranks need no range exchange:
the leading hex digits of a digest already split any group evenly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestry.session import cut_lineage

_PIECE, _SEQ = "_piece", "_seq"
#: Rows of a group that one window of a hash rank holds, on average.
HASH_PIECE = 1 << 16


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, where a null group key equals a null."""
    other = right.withColumnsRenamed({k: f"_met_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_met_{k}"))
    return left.join(other, same).drop(*[f"_met_{k}" for k in keys])


def _pieces(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Sorted pieces on disk: rows carry their piece number and place inside it."""
    cols = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(width, *cols).sortWithinPartitions(*cols)
    # monotonically_increasing_id is the piece in the high bits and the place in the low 33
    ids = laid.withColumn("_id", F.monotonically_increasing_id())
    return cut_lineage(ids.withColumns({
        _PIECE: F.shiftright("_id", 33).cast("int"),
        _SEQ: F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
    }).drop("_id"))


def _piece_totals(pieces: DataFrame, group: Sequence[str], weight: str | None) -> DataFrame:
    """Rows and weight before each piece within a group; one row per group and piece."""
    before = W.partitionBy(*group).orderBy(_PIECE).rowsBetween(W.unboundedPreceding, -1)
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(_SEQ).alias("_first")]
    if weight:
        aggs.append(F.sum(weight).alias("_w"))
    totals = pieces.groupBy(*group, _PIECE).agg(*aggs)
    out = totals.withColumn("_rows_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if weight:
        out = out.withColumn("_weight_before", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    return out


def with_positions(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                   name: str = "pos") -> DataFrame:
    """0-based position inside each group (null keys are a group); ``order`` must break every tie."""
    pieces = _pieces(df, group, order)
    totals = _piece_totals(pieces, group, None)
    return (
        _met(pieces, totals, [*group, _PIECE])
        .withColumn(name, F.col("_rows_before") + F.col(_SEQ) - F.col("_first"))
        .drop(_PIECE, _SEQ, "_n", "_first", "_rows_before")
    )


def with_prefix_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                    weight: str, name: str = "cum") -> DataFrame:
    """Running total up to and including each row; a window spans one piece at a time."""
    pieces = _pieces(df, group, order)
    totals = _piece_totals(pieces, group, weight)
    inside = W.partitionBy(*group, _PIECE).orderBy(_SEQ).rowsBetween(W.unboundedPreceding, 0)
    return (
        _met(pieces.withColumn("_inside", F.sum(weight).over(inside)), totals.select(*group, _PIECE, "_weight_before"), [*group, _PIECE])
        .withColumn(name, F.col("_weight_before") + F.col("_inside"))
        .drop(_PIECE, _SEQ, "_inside", "_weight_before")
    )


def hash_rank(df: DataFrame, keys: Sequence[str], hex_col: str, tie: str,
              size: Column, name: str = "rank") -> DataFrame:
    """0-based rank of a digest inside its keys. ``size`` is the number of rows of the row's
    group, or near it: a group is split by as many leading digits as leave a window about
    ``HASH_PIECE`` rows, and every choice of digits gives the same ranks."""
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(size.cast("double"), F.lit(1.0)) / HASH_PIECE) / F.log(F.lit(16.0)))).cast("int")
    marked = df.withColumn("_split", F.substring(F.col(hex_col), F.lit(1), digits))
    before = W.partitionBy(*keys).orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_split").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    )
    inside = W.partitionBy(*keys, "_split").orderBy(hex_col, tie)
    return (
        _met(marked.withColumn("_in", F.row_number().over(inside) - 1), offsets, [*keys, "_split"])
        .withColumn(name, (F.col("_off") + F.col("_in")).cast("long"))
        .drop("_split", "_in", "_off")
    )


def bounded_frame(df: DataFrame, group: Sequence[str], pos: str, back: int, ahead: int,
                  chunk: int = 4096) -> tuple[DataFrame, W]:
    """Rows cut into chunks with copied edges, and the window that fits inside a chunk.

    Aggregate over the window, then keep rows where ``_copy`` is false.
    """
    here = F.floor(F.col(pos) / chunk)
    offset = F.col(pos) - here * chunk
    homes = [F.struct(here.alias("c"), F.lit(False).alias("copy"))]
    spans = F.array(*homes)
    if back:
        late = F.array(F.struct((here + 1).alias("c"), F.lit(True).alias("copy")))
        spans = F.when(offset >= chunk - back, F.concat(spans, late)).otherwise(spans)
    if ahead:
        early = F.array(F.struct((here - 1).alias("c"), F.lit(True).alias("copy")))
        spans = F.when((offset < ahead) & (here > 0), F.concat(spans, early)).otherwise(spans)
    laid = df.withColumn("_s", F.explode(spans)).withColumns({
        "_chunk": F.col("_s.c"), "_copy": F.col("_s.copy")}).drop("_s")
    return laid, W.partitionBy(*group, "_chunk").orderBy(pos)


def drop_copies(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_copy")).drop("_copy", "_chunk")


def exact_quantiles(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float],
                    group: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles of whole columns, ``(group.., measure, q, value)``.

    The built-in exact percentile gathers every distinct value in one task; here only the
    two rows beside each quantile survive the sort.
    """
    pairs = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns]
    keys = [*group, "measure"]
    long = (
        df.select(*group, F.explode(F.array(*pairs)).alias("p"))
        .select(*group, "p.measure", "p.value").filter(F.col("value").isNotNull())
    )
    placed = with_positions(long, keys, ["value"])  # its pieces are on disk already
    sizes = placed.groupBy(*keys).agg((F.max("pos") + 1).alias("n")).withColumn(
        "q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    spot = F.col("q") * (F.col("n") - 1)
    wanted = sizes.withColumns({"low": F.floor(spot), "part": spot - F.floor(spot)})
    both = wanted.withColumn("pos", F.explode(F.array("low", F.least(F.col("low") + 1, F.col("n") - 1))))
    both = both.distinct()
    hit = _met(both, placed, [*keys, "pos"])
    at_low = F.max(F.when(F.col("pos") == F.col("low"), F.col("value")))
    at_high = F.max("value")
    return (
        hit.groupBy(*keys, "q", "part").agg(at_low.alias("a"), at_high.alias("b"))
        .select(*keys, "q", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("value"))
    )


def quantile_row(df: DataFrame, spec: dict[str, tuple[str, float]], group: Sequence[str] = ()) -> DataFrame:
    """Named quantiles as one row per group: ``{name: (column, q)}``."""
    columns = sorted({c for c, _ in spec.values()})
    qs = sorted({float(q) for _, q in spec.values()})
    long = exact_quantiles(df, columns, qs, group)
    picks = [
        F.max(F.when((F.col("measure") == c) & (F.col("q") == float(q)), F.col("value"))).alias(name)
        for name, (c, q) in spec.items()
    ]
    return long.groupBy(*group).agg(*picks) if group else long.agg(*picks)


def equal_count_bins(df: DataFrame, value: str, tie: str, bins: int, name: str = "bin") -> DataFrame:
    """floor(rank * bins / N) over a stable order, so sizes never differ by remainders first."""
    ranked = with_positions(df, [], [value, tie], "_rank")
    total = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn(name, F.floor(F.col("_rank") * bins / total).cast("int")).drop("_rank")

"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points, in order. It enters the inverted list of
each; vectors meet where they share a list, and a pair goes on only if it shares enough pivots,
which the lists' bit masks count. What is left is verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import hashed_unit, staged
from contestry.llm.graph import components

#: Rows of one side of a comparison; a list is dealt to so many blocks of this size.
BLOCK = 512
#: Pivots are at most this many, so that a set of them is one 64-bit word.
MOST_PIVOTS = 64


def usable(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``(id, label, v)`` of the rows that may link: doubles, all finite, not all zero."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v"))
    rows = rows.filter("id is not null and label is not null and v is not null")
    return rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _unit(batch: list) -> list[np.ndarray]:
    """Each vector over its length, scaled first so that no square overflows or vanishes."""
    out = []
    for v in batch:
        a = np.asarray(v, dtype=np.float64)
        a = a / np.abs(a).max()
        out.append(a / sqrt(float(a @ a)))
    return out


def _pivots(reps: DataFrame, sample: int, pivots: int, seed: int) -> dict[int, np.ndarray]:
    """For each length of vector, reference points from a bounded sample: the farthest-first
    choice among about ``sample`` vectors, taken by a digest of the id."""
    n = reps.count()
    rows = reps.filter(hashed_unit(F.col("id"), seed=seed) < sample / max(1, n)).select("id", "v").collect()
    by_size: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for size, vs in by_size.items():
        x = np.array(_unit(vs))
        chosen = [0]
        near = x @ x[0]
        while len(chosen) < min(pivots, len(x)):
            nxt = int(np.argmin(near))
            if near[nxt] > 1 - 1e-9:
                break
            chosen.append(nxt)
            near = np.maximum(near, x @ x[nxt])
        out[size] = x[chosen]
    return out


def _compare(rows: pd.DataFrame, own_list: int, shared: int, threshold: float, square: bool) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of a block, met in this list and in no earlier one."""
    x = np.array(rows["u"].tolist())
    mask = rows["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    both = mask[:, None] & mask[None, :]
    few = np.zeros(both.shape, dtype=np.uint8)
    for shift in range(0, 64, 16):
        few += _POP16[((both >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)]
    first = (both & (~both + np.uint64(1))) == np.uint64(1 << own_list)
    meet = np.triu(first & (few >= shared), 1)
    if not square:
        side = rows["side"].to_numpy()
        meet &= side[:, None] != side[None, :]
    i, j = np.nonzero(meet)
    if not len(i):
        return i, j
    cosine = np.einsum("ij,ij->i", x[i], x[j])
    keep = cosine >= threshold
    return i[keep], j[keep]


_POP16 = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def link_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
    pivots: int = 32, nearest: int = 7, shared: int = 4, sample: int = 2000, seed: int = 3,
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label link if their cosine is at least ``threshold``; of what is retrieved no
    link is below it. Two vectors meet if they share ``shared`` of their ``nearest`` pivots (all
    they have, where there are fewer pivots). The pivots are chosen from about ``sample``
    vectors; every vector is indexed. Equal vectors are indexed once and always link. Vectors
    that are null, zero, or hold a null or non-finite component, and rows with a null label,
    link with nothing; vectors of different length never link; a null id gives no row, and an
    id with several rows counts with its least label and vector.
    """
    pivots = min(pivots, MOST_PIVOTS)
    good = usable(vectors, id_col, vector, label).groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.*")
    good = staged(good.withColumn("key", F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.col("v").cast("string")), 256)))
    reps = staged(good.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")))
    points = _pivots(reps, sample, pivots, seed)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = _unit(batch["v"].tolist())
            masks = np.zeros(len(units), dtype=np.uint64)
            for size in {len(u) for u in units}:
                at = [k for k, u in enumerate(units) if len(u) == size]
                refs = points.get(size)
                if refs is None:  # no vector of this length was sampled: one list takes them all
                    masks[at] = np.uint64(1)
                    continue
                order = np.argsort(-(np.array([units[k] for k in at]) @ refs.T), axis=1, kind="stable")[:, :nearest]
                masks[at] = np.bitwise_or.reduce(np.uint64(1) << order.astype(np.uint64), axis=1)
            yield pd.DataFrame({"id": batch["id"], "copies": batch["copies"], "label": batch["label"], "u": units, "mask": masks.view(np.int64), "size": [len(u) for u in units]})

    told = reps.select("id", "copies", F.col("label").cast("string").alias("label"), "v").mapInPandas(describe, "id long, copies long, label string, u array<double>, mask long, size int")
    told = staged(told)
    bits = F.filter(F.sequence(F.lit(0), F.lit(MOST_PIVOTS - 1)), lambda k: (F.call_function("shiftrightunsigned", F.col("mask"), k).bitwiseAND(F.lit(1)) == 1))
    listed = told.withColumn("pivot", F.explode(bits))
    # a long list is dealt to blocks by digest and its blocks met pairwise: no task holds a list
    sizes = staged(listed.groupBy("label", "size", "pivot").agg(F.count("*").alias("n")).withColumn("n_blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    dealt = listed.join(sizes, ["label", "size", "pivot"]).withColumn("side", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select("label", "size", "pivot", "id", "copies", "u", "mask", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, size, pivot, bi, bj = key
        refs = points.get(size)
        least = min(shared, nearest, len(refs)) if refs is not None else 1
        i, j = _compare(rows, pivot, least, threshold, bi == bj)
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        counts = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
        parent = np.arange(len(ids))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):  # a pair counts once, but only a forest of links is written
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        tied = np.flatnonzero((parent != np.arange(len(ids))) | (counts > 0))
        return pd.DataFrame({"u": ids[tied], "v": ids[parent[tied]], "n": counts[tied].astype(np.int64)})

    met = staged(dealt.groupBy("label", "size", "pivot", "i", "j").applyInPandas(verify, "u long, v long, n long"))
    counts = met.groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("linked"))
    groups = components(met.filter("u <> v").select("u", "v"))
    found = reps.select("key", "id", "copies").join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    found = found.select("key", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    every = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    done = every.join(good.select("id", "key"), "id", "left").join(found, "key", "left")
    return done.select(
        F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "id").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept")
    )

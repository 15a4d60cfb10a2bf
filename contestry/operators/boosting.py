"""Gradient-boosted regression trees over histograms: all folds and feature sets grow together.

Features are binned once. All that a tree sees of a row is its bins and its fold, so rows with equal bins
of a feature set are added up to one cell with a sum and a count for each fold; a model's own fold is
taken off the cell's total. A pass over the cells then sums residuals by (model, node, feature, bin)
in each partition, the sums of all partitions meet by model, and one best split per node comes
back: what a level costs does not depend on how many models there are. The driver holds trees,
never rows. Cells travel as blocks of arrays; their predictions are brought up to date each round where
they are kept, and written every ``RENEW`` rounds, so that a lost executor repeats at most those.

Where no set has more than ``ALONE`` cells, a model fits in one task whatever the number of rows. Models know
nothing of each other, so each then grows all its trees in a task of its own, without a job for every level.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.operators.ranking import exact_quantiles
from contestry.session import cut_lineage

#: Rounds between two writes of the predictions.
RENEW = 10
#: Residuals (cells times folds) that a task is worth starting for, and that one task holds at most
#: where that gives more tasks than there are cores.
TASK_RESIDUALS, FULL_TASK = 150_000, 2_000_000
#: Cells of a block.
BLOCK = 8192
#: Cells of a feature set, some 70 bytes each, that one task holds while it grows a model.
ALONE = 4_000_000


class Trees:
    """One tree for each fold, as heaps: node i has children 2i+1 (bin at most ``cut``) and 2i+2."""

    def __init__(self, folds: int, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full((folds, size), -1, dtype=np.int32)
        self.cut = np.zeros((folds, size), dtype=np.int32)
        self.value = np.zeros((folds, size))

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each cell (first axis) in each fold's tree, after so many levels (all)."""
        folds, size = self.feature.shape
        root = (np.arange(folds) * size)[None, :]
        first = (np.arange(len(bins)) * bins.shape[1])[:, None]
        flat = np.ascontiguousarray(bins).ravel()
        node = np.zeros((len(bins), folds), dtype=np.int64)
        for _ in range(self.depth if levels is None else levels):
            at = root + node
            feature = self.feature.take(at)
            right = flat.take(first + np.maximum(feature, 0)) > self.cut.take(at)
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node

    def added(self, bins: np.ndarray, predicted: np.ndarray) -> np.ndarray:
        folds, size = self.feature.shape
        return predicted + self.value.take((np.arange(folds) * size)[None, :] + self.nodes(bins))


def binned(rows: DataFrame, features: Sequence[str], max_bins: int) -> DataFrame:
    """``bins``: per feature the number of edges below the value, plus one; a missing value is bin 0.

    Edges are quantiles of the feature, so that a bin holds about equally many rows.
    """
    qs = [k / max_bins for k in range(1, max_bins)]
    edges = exact_quantiles(rows, features, qs).groupBy("measure").agg(F.sort_array(F.collect_set("value")).alias("edges"))
    at = {r.measure: r.edges for r in edges.collect()}  # at most max_bins numbers a feature

    def place(f: str) -> Column:
        value = F.col(f).cast("double")
        below = F.filter(F.lit(at.get(f, [])).cast("array<double>"), lambda edge: edge < value)
        return F.when(value.isNull(), 0).otherwise(F.size(below) + 1).cast("int")

    return rows.withColumn("bins", F.array(*[place(f) for f in features]))


def best_splits(sums: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[int, int, int, float, float, float, float]]:
    """``(node, feature, cut, left sum, left rows, right sum, right rows)`` for each node that has a split with at
    least ``least`` rows on both sides and a gain; of equal gains the first feature and cut."""
    gl, nl = np.cumsum(sums, axis=2)[:, :, :-1], np.cumsum(counts, axis=2)[:, :, :-1]
    g, n = sums.sum(axis=2)[:, :, None], counts.sum(axis=2)[:, :, None]
    gr, nr = g - gl, n - nl
    fine = (nl >= least) & (nr >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fine, gl * gl / nl + gr * gr / nr - g * g / n, -np.inf)
    out = []
    for node in range(len(sums)):
        flat = np.round(gain[node], 6).ravel()  # rounded: sums come in any order
        k = int(flat.argmax())
        if flat[k] > 0:
            f, cut = divmod(k, gain.shape[2])
            out.append((node, f, cut, float(gl[node, f, cut]), float(nl[node, f, cut]), float(gr[node, f, cut]), float(nr[node, f, cut])))
    return out


def cells_of(state: DataFrame, sets: list[list[int]], folds: int) -> DataFrame:
    """``set``, ``bins`` (those of the set's features), and per fold the sum ``t`` and the count ``w`` of the rows
    in it: one row for each set and each vector of bins that occurs."""
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), F.array(*[F.get("bins", F.lit(j)) for j in at]).alias("bins")) for i, at in enumerate(sets)]))
    by = state.select(own.alias("c"), "fold", "_y").groupBy("c.set", "c.bins")
    here = [F.col("fold") == k for k in range(folds)]
    cells = by.agg(*[F.sum(F.when(h, F.col("_y")).otherwise(0.0)).alias(f"t{k}") for k, h in enumerate(here)], *[F.count_if(h).alias(f"w{k}") for k, h in enumerate(here)])
    return cells.select("set", "bins", *[F.array(*[f"{c}{k}" for k in range(folds)]).alias(c) for c in "tw"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Cells as blocks: set, bins, what all but each fold sum up to and count, each fold's own count."""
    for batch in batches:
        of = batch["set"].to_numpy()
        for i in np.unique(of).tolist():
            mine = batch.filter(pa.array(of == i))
            n = mine.num_rows
            bins, t, w = (mine[c].flatten().to_numpy().reshape(n, -1) for c in ("bins", "t", "w"))
            for a in range(0, n, BLOCK):
                part = slice(a, a + BLOCK)
                rest = [x[part].sum(axis=1, keepdims=True) - x[part] for x in (t, w)]
                yield i, bins[part].astype(np.int32), rest[0], rest[1].astype(np.float64), w[part]


def _packed(start: list[np.ndarray]):
    """Blocks with the predictions that they start from."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, bins, t, w, _ in _blocks(batches):
            block = (i, bins, t, w, np.tile(start[i], (len(bins), 1)))
            yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(block)], pa.binary())})
    return work


def _by_model(folds: int, max_bins: int):
    """A block's share in each model: bins, what the model learns from, and which cells it predicts."""
    kind = np.min_scalar_type(max_bins)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, bins, t, w, own in _blocks(batches):
            parts = [(bins.astype(kind), t[:, k].copy(), w[:, k].copy(), own[:, k] > 0) for k in range(folds)]
            yield pa.RecordBatch.from_pydict({
                "model": pa.array([i * folds + k for k in range(folds)], pa.int32()), "part": pa.array([pickle.dumps(p) for p in parts], pa.binary())})
    return work


def grown_alone(bins: np.ndarray, t: np.ndarray, w: np.ndarray, first: float, rounds: int, rate: float, depth: int, least: int, width: int) -> np.ndarray:
    """What one model predicts for each of its cells, given by feature and cell, after all rounds."""
    n, p = bins.shape[1], np.full(bins.shape[1], first)
    spot, at = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for _ in range(rounds):
        rest = t - w * p
        node = np.zeros(n, dtype=np.int64)
        value = np.zeros(2 ** (depth + 1) - 1)
        for level in range(depth):
            begin, many = 2**level - 1, 2**level
            np.subtract(node, begin, out=spot)
            spot[spot < 0] = many  # a leaf above: counted where nobody looks
            spot *= width
            sums, counts = np.empty((2, many, len(bins), width))
            for j, of in enumerate(bins):
                np.add(spot, of, out=at)
                for table, x in ((sums, rest), (counts, w)):
                    table[:, j] = np.bincount(at, x, (many + 1) * width).reshape(many + 1, width)[:many]
            if level == 0:  # a tree that cannot split predicts the mean of its residuals
                value[0] = rate * sums[0, 0].sum() / max(1.0, counts[0, 0].sum())
            feature, cut = np.full(many + 1, -1), np.zeros(many + 1, dtype=np.int64)
            for k, f, c, gl, nl, gr, nr in best_splits(sums, counts, least):
                feature[k], cut[k], child = f, c, 2 * (begin + k) + 1
                value[child], value[child + 1] = rate * gl / nl, rate * gr / nr
            if (feature < 0).all():
                break
            spot //= width
            for f in np.unique(feature[feature >= 0]).tolist():
                mine = np.flatnonzero((feature == f)[spot])
                node[mine] = 2 * node[mine] + 1 + (bins[f, mine] > cut[spot[mine]])
        p += value[node]
    return p


def _alone(guess: np.ndarray, rounds: int, rate: float, depth: int, least: int, width: int):
    """A model's cells in which its fold has rows, and their predictions."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for m, part in zip(batch["model"].to_pylist(), batch["part"], strict=True):
                held.setdefault(m, []).append(pickle.loads(part.as_py()))
        for m in list(held):
            bins, t, w, own = (np.concatenate(x) for x in zip(*held.pop(m), strict=True))
            fold = m % len(guess)
            p = grown_alone(np.ascontiguousarray(bins.T), t, w, guess[fold], rounds, rate, depth, least, width)
            told = np.flatnonzero(own)
            for a in range(0, len(told), BLOCK):
                mine = bins[told[a:a + BLOCK]].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * mine.shape[1]), pa.array(mine.ravel()))
                fixed = [pa.array(np.full(len(mine), x, dtype=np.int32)) for x in (m // len(guess), fold)]
                yield pa.RecordBatch.from_arrays([*fixed, lists, pa.array(p[told[a:a + BLOCK]])], names=["set", "of", "bins", "p"])
    return work


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in batch["block"]:
            i, bins, _, _, p = pickle.loads(one.as_py())
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (bins, p)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), i, dtype=np.int32)), *lists], names=["set", "bins", "p"])


def _level_sums(trees: list[Trees], level: int, width: int):
    """Per model the sums and counts by node, feature and bin of a partition's cells."""
    first, many = 2**level - 1, 2**level

    def work(blocks: Iterator[tuple]) -> Iterator[tuple]:
        tables: dict[int, np.ndarray] = {}
        for i, bins, t, w, p in blocks:
            folds, features = w.shape[1], bins.shape[1]
            node = trees[i].nodes(bins, level) - first
            live = node >= 0
            rest, seen = (np.where(live, x, 0.0).ravel() for x in (t - w * p, w))
            spot = (np.arange(folds)[None, :] * many + np.maximum(node, 0)) * width
            table = tables.setdefault(i, np.zeros((2, folds, many, features, width)))
            for j in range(features):
                at = (spot + bins[:, j, None]).ravel()
                for side, x in enumerate((rest, seen)):
                    table[side, :, :, j] += np.bincount(at, x, folds * many * width).reshape(folds, many, width)
        for i, table in tables.items():
            for k in range(table.shape[1]):
                yield i * table.shape[1] + k, table[:, k]
    return work


def _renewed(trees: list[Trees]):
    def work(blocks: Iterator[tuple]) -> Iterator[tuple]:
        for i, bins, t, w, p in blocks:
            yield i, bins, t, w, trees[i].added(bins, p)
    return work


def _splits(level: int, least: int):
    def work(model: tuple[int, np.ndarray]) -> list[tuple]:
        m, (g, n) = model
        found = [(m, *split) for split in best_splits(g, n, least)]
        if level == 0:  # a tree that cannot split predicts the mean of its residuals
            found.append((m, -1, -1, 0, float(g[0, 0].sum()), float(n[0, 0].sum()), 0.0, 0.0))
        return found
    return work


def _level_by_level(cells: DataFrame, residuals: int, sets: list[list[int]], guess: np.ndarray, rounds: int, rate: float, depth: int,
                    least: int, max_bins: int, few: int) -> DataFrame:
    """Predictions of as many cells as there are: cells stay where they are, a level of all trees is one job."""
    folds, context = len(guess), cells.sparkSession.sparkContext
    tasks = max(1, min(math.ceil(residuals / TASK_RESIDUALS), context.defaultParallelism), math.ceil(residuals / FULL_TASK))
    parts = min(len(sets) * folds, tasks)
    blocks = cells.repartition(tasks, "set", "bins").mapInArrow(_packed([guess] * len(sets)), "block binary")
    held = blocks.rdd.map(lambda r: pickle.loads(r.block)).persist(StorageLevel.MEMORY_AND_DISK)
    older: RDD | None = None
    for k in range(rounds):
        trees = [Trees(folds, depth) for _ in sets]
        for level in range(depth):
            sums = held.mapPartitions(_level_sums(trees, level, max_bins + 1))
            if tasks <= few:  # a table a task, of one size whatever the rows
                merged: dict[int, np.ndarray] = {}
                for m, table in sums.collect():
                    merged[m] = merged[m] + table if m in merged else table
                found = [split for model in merged.items() for split in _splits(level, least)(model)]
            else:
                found = sums.reduceByKey(np.add, parts).flatMap(_splits(level, least)).collect()  # at most a split a node and model
            if older is not None:  # what came of it is kept by now
                older.unpersist()
                older = None
            for m, node, f, cut, gl, nl, gr, nr in sorted(found, key=itemgetter(0, 1)):
                tree, fold = trees[m // folds], m % folds
                if node < 0:
                    tree.value[fold, 0] = rate * gl / max(1.0, nl)
                    continue
                at = 2**level - 1 + node
                tree.feature[fold, at], tree.cut[fold, at] = f, cut
                tree.value[fold, 2 * at + 1], tree.value[fold, 2 * at + 2] = rate * gl / nl, rate * gr / nr
            if all(node < 0 for _, node, *_ in found):
                break
        older, held = held, held.mapPartitions(_renewed(trees)).persist(StorageLevel.MEMORY_AND_DISK)
        if (k + 1) % RENEW == 0:
            held.checkpoint()
    told = cells.sparkSession.createDataFrame(held.map(lambda b: (pickle.dumps(b),)), "block binary").mapInArrow(_unpacked, "set int, bins array<int>, p array<double>")
    told = cut_lineage(told)
    for x in (held, older):
        if x is not None:
            x.unpersist()
    return told.select("set", F.posexplode("p").alias("of", "p"), "bins")


def boosted_out_of_fold(rows: DataFrame, feature_sets: dict[str, Sequence[str]], target: str, folds: int, rounds: int = 200,
                        rate: float = 0.1, depth: int = 5, least: int = 100, max_bins: int = 32, few: int = 8, alone: int = ALONE) -> DataFrame:
    """The rows with ``predicted``, a struct of one out-of-fold prediction for each feature set.

    For every set and every ``fold`` a booster of squared loss learns from the other folds' rows;
    its first guess is their mean. Every row is learned from and every row is predicted; a missing
    feature is a value of its own, below all others. A null target counts as zero. The tables of up
    to ``few`` tasks are merged where the trees grow; those of more meet by model first. Neither is
    needed where every set has at most ``alone`` cells: a model then grows in one task.
    """
    names = list(dict.fromkeys(f for fs in feature_sets.values() for f in fs))
    sets = [[names.index(f) for f in fs] for fs in feature_sets.values()]
    kept = rows.columns
    y = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    rows = cut_lineage(rows)  # read for the means, the edges and the bins
    means = rows.groupBy("fold").agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("c")).collect()  # one row a fold
    s, c = sum(r.s for r in means), sum(r.c for r in means)
    own = {r.fold: (r.s, r.c) for r in means}
    guess = np.array([float((s - own.get(f, (0, 0))[0]) / max(1, c - own.get(f, (0, 0))[1])) for f in range(folds)])
    state = cut_lineage(binned(rows, names, max_bins).withColumn("_y", y))
    cells = cut_lineage(cells_of(state, sets, folds))

    sizes = {r["set"]: r["count"] for r in cells.groupBy("set").count().collect()}  # one row a set
    if max(sizes.values(), default=0) <= alone:
        models = len(sets) * folds
        parts = cells.mapInArrow(_by_model(folds, max_bins), "model int, part binary")
        # as many tasks as models, those of the last sets first: nested sets have more cells each time
        parts = parts.repartitionById(models, F.lit(models - 1) - F.col("model"))
        told = cut_lineage(parts.mapInArrow(_alone(guess, rounds, rate, depth, least, max_bins + 1), "set int, of int, bins array<int>, p double"))
    else:
        told = _level_by_level(cells, sum(sizes.values()) * folds, sets, guess, rounds, rate, depth, least, max_bins, few)
    out = state
    for i, (name, at) in enumerate(zip(feature_sets, sets, strict=True)):
        mine = told.filter(F.col("set") == i).select(F.col("bins").alias("_at"), F.col("of").alias("_of"), F.col("p").alias(f"_p{i}"))
        same = (F.array(*[F.get("bins", F.lit(j)) for j in at]) == F.col("_at")) & (F.col("fold") == F.col("_of"))
        out = out.join(mine, same, "left").drop("_at", "_of")  # a row of no fold stays, without a prediction
    return cut_lineage(out.select(*kept, F.struct(*[F.col(f"_p{i}").alias(name) for i, name in enumerate(feature_sets)]).alias("predicted")))

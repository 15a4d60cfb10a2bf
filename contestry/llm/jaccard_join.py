"""Similarity join on word shingles with Bayesian candidate pruning.

1. Equal texts form a class; one text of each class goes on.
2. Signatures of ``bands * rows`` MinHash values; texts that agree on a whole band meet.
3. Where they meet, signatures are compared a step at a time, and a pair goes once the
   posterior probability of reaching the threshold is below the tolerance. What is left only
   ties texts into clusters: no pair is written.
4. Within a cluster every pair is pruned in the same way and the rest is verified exactly on
   the shingle sets, in square blocks of bounded size. A block returns, for each text, how many
   rows its links stand for, and enough links to keep the group connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import mix, shingle_hashes, staged, word_hash_lists
from contestry.llm.graph import components

#: Signature values compared before the posterior is looked at again.
STEP = 16
#: Texts whose shingles are held at once.
SLICE = 500
#: Shingle columns of a verification block held at once.
COLUMNS = 1 << 15


def signature(shingles: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """The least of the mixed shingle hashes under each of ``size`` keys, 32 bits each."""
    keys = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(seed))
    out = np.empty(size, dtype=np.uint32)
    for i, k in enumerate(keys):
        out[i] = ((shingles * (k | np.uint64(1)) + (k >> np.uint64(7))) >> np.uint64(32)).min()
    return out


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of ``compared`` that keep a pair: under a uniform prior, the
    probability that the similarity reaches the threshold is then at least the tolerance."""
    n, tail = compared + 1, 0.0
    for m in range(compared + 1):
        tail += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if tail >= tolerance:
            return m
    return compared + 1


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs of rows of two signature matrices outlive the stepwise comparison."""
    equal = np.zeros((len(a), len(b)), dtype=np.int16)
    alive = np.ones((len(a), len(b)), dtype=bool)
    for start in range(0, a.shape[1], STEP):
        stop = min(start + STEP, a.shape[1])
        i, j = np.nonzero(alive)
        if not len(i):
            break
        for lo in range(0, len(i), 1 << 18):
            x, y = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
            equal[x, y] += (a[x, start:stop] == b[y, start:stop]).sum(axis=1, dtype=np.int16)
        alive[i, j] = equal[i, j] >= least_matches(stop, threshold, tolerance)
    return alive


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what ``(i, j)`` connects among ``n`` items: at most n - 1 of them."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _blocked(rows: DataFrame, keys: list[str], item: Column, most: int) -> DataFrame:
    """``rows`` with ``i`` and ``j``, the blocks of their group in which a row takes part, and
    ``side``, its own block. Groups of up to ``most`` rows are one block; larger ones are dealt
    by digest to n blocks and met pairwise, each row n times, so that no task holds a group."""
    large = staged(rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > most))
    met = rows.join(large, keys, "left").withColumn("n", F.coalesce(F.ceil(F.col("n_rows") / most), F.lit(1)).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64(item), F.col("n")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return met.select("*", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).drop("n_rows", "n", "other")


def join_similar(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8,
    bands: int = 20, rows: int = 4, tolerance: float = 1e-6, block: int = 64, bucket: int = 1024,
) -> DataFrame:
    """One row per id: ``doc_id``, ``class_id`` (least id reachable over links), ``n_links``
    (other ids linked directly) and ``text_class`` (least id of the same text).

    Texts link if the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``threshold``; a text of fewer words is one shingle, equal texts always link, and texts
    without a word link with nothing, not even with each other. Null ids are left out, null
    texts are empty, repeated rows of an id count once, and an id with several texts is joined
    by the text of least digest. At the threshold itself a pair of
    texts meets in some band with probability 1 - (1 - threshold**rows)**bands, 0.99997 here.
    """
    size = bands * rows

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                part = batch.iloc[lo : lo + SLICE]
                sets = [shingle_hashes(w, width) for w in word_hash_lists(list(part["t"]))]
                sigs = [signature(s, size).tobytes() if len(s) else b"" for s in sets]
                yield pd.DataFrame({"id": part["id"], "key": part["key"], "sig": sigs, "n_sh": [len(s) for s in sets]})

    ided = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    signed = ided.select("id", "t", F.md5("t").alias("key")).mapInPandas(sign, "id long, key string, sig binary, n_sh int")
    signed = staged(signed.groupBy("id").agg(F.min(F.struct("key", "n_sh", "sig")).alias("s")).select("id", "s.*"))
    classes = signed.filter("n_sh > 0").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min_by("sig", "id").alias("sig"))
    classes = staged(classes)

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch["sig"]), dtype=np.uint32).reshape(-1, bands, rows).astype(np.uint64)
            h = np.full(sigs.shape[:2], 1, dtype=np.uint64)
            for r in range(rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, r])
            h = mix(h + np.arange(bands, dtype=np.uint64))
            yield pd.DataFrame({"key": np.repeat(batch["key"].to_numpy(), bands), "band": h.view(np.int64).ravel()})

    met = classes.select("key", "sig").mapInPandas(banded, "key string, band long")
    shared = staged(met.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"))
    met = staged(met.join(shared, "band", "left_semi"))
    carried = classes.select("key", "rep", "sig").join(met, "key").select("band", "rep", "sig")
    blocked = _blocked(carried, ["band"], F.col("rep"), bucket)
    grouped = blocked.groupBy("band", "i", "j").agg(F.collect_list(F.struct("rep", "side", "sig")).alias("members"))

    def tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u: list[int] = []
            v: list[int] = []
            for members in batch["members"]:
                if len(members) < 2:
                    continue
                ids = np.array([m["rep"] for m in members], dtype=np.int64)
                sigs = np.frombuffer(b"".join(m["sig"] for m in members), dtype=np.uint32).reshape(-1, size)
                x, y = np.nonzero(np.triu(surviving(sigs, sigs, threshold, tolerance), 1))
                for p, q in _forest(x, y, len(ids)):
                    u.append(int(ids[p]))
                    v.append(int(ids[q]))
            yield pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})

    ties = grouped.filter(F.size("members") > 1).mapInPandas(tie, "u long, v long")
    clusters = staged(components(ties))
    members = clusters.join(classes, F.col("node") == F.col("rep")).select("component", "rep", "key", "copies", "sig")
    texts = ided.withColumn("key", F.md5("t")).join(members.withColumnRenamed("rep", "id"), ["id", "key"])
    texts = texts.dropDuplicates(["id", "key"]).select("component", "id", "copies", "sig", "t")
    pieces = _blocked(texts, ["component"], F.col("id"), block)

    def verify(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, bi, bj = key
        ids, side = part["id"].to_numpy(), part["side"].to_numpy()
        sigs = np.frombuffer(b"".join(part["sig"]), dtype=np.uint32).reshape(-1, size)
        alive = np.triu(surviving(sigs, sigs, threshold, tolerance), 1)
        if bi != bj:  # pairs inside one block are met in that block's own square
            alive &= side[:, None] != side[None, :]
        at = np.flatnonzero(alive.any(axis=0) | alive.any(axis=1))
        if not len(at):
            return pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")
        sets = [shingle_hashes(w, width) for w in word_hash_lists(list(part["t"].iloc[at]))]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(at)), sizes)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(at), len(at)))
        for lo in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, (lo, lo + COLUMNS))
            x = np.zeros((len(at), min(COLUMNS, int(column[-1]) + 1 - lo)), dtype=np.float32)
            x[owner[a:b], column[a:b] - lo] = 1
            both += x @ x.T
        linked = alive[np.ix_(at, at)] & (both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9)
        copies = part["copies"].to_numpy()[at]
        counts = linked @ copies + linked.T @ copies
        i, j = np.nonzero(linked)
        forest = _forest(i, j, len(at))
        names = ids[at]
        return pd.DataFrame({
            "u": np.concatenate([names, [names[p] for p, _ in forest]]).astype(np.int64),
            "v": np.concatenate([names, [names[q] for _, q in forest]]).astype(np.int64),
            "n": np.concatenate([counts, np.zeros(len(forest))]).astype(np.int64),
        })

    checked = staged(pieces.groupBy("component", "i", "j").applyInPandas(verify, "u long, v long, n long"))
    counts = checked.filter("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("linked"))
    groups = components(checked.filter("u <> v").select("u", "v"))
    per_class = classes.join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    per_class = per_class.select("key", "rep", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "rep").alias("class"))
    return signed.select("id", "key").join(per_class, "key", "left").select(
        F.col("id").alias("doc_id"), F.coalesce("class", "id").alias("class_id"),
        F.coalesce(F.col("linked") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("rep", "id").alias("text_class"),
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group; columns stay as they are. Of
    repeated rows of an id one stays for each text; rows with a null id all stay, as nothing
    can name them."""
    kept = join_similar(docs, id_col=id_col, text=text, **options).filter("doc_id = class_id").select(F.col("doc_id").alias("kept_id"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("kept_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("kept_text"))
    named = rows.join(kept, "kept_id", "left_semi").dropDuplicates(["kept_id", "kept_text"])
    return named.select("row.*").unionByName(rows.filter("kept_id is null").select("row.*"))

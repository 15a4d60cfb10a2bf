"""Language-model scores by stupid backoff, joined relationally.

Texts are dealt to chunks by digest. A chunk sends each distinct n-gram that it holds, with its
count, to the part of the count table that the n-gram's hash names; there the counts of all
chunks are added up, and the totals go back to the chunks that asked. A chunk then sums the
logarithms over each of its texts. N-grams travel in lists, one for each chunk and part: however
common an n-gram is, it is one entry a chunk, and however rare, it costs eight bytes.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import mix, word_hash_lists

#: Characters of text in a chunk, and words counted in a part of the table, on average.
CHUNK_CHARS, PART_WORDS = 8 << 20, 1 << 19


def _grams(lists: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each word, which text it is in, how many words of it come before, and, for each order,
    the hash of the n-gram that it ends; with fewer words before, that entry means nothing."""
    words = np.concatenate([np.zeros(0, np.uint64), *lists])
    sizes = np.array([len(w) for w in lists], dtype=np.int64)
    text = np.repeat(np.arange(len(lists)), sizes)
    before = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = [mix(words + np.uint64(1))]
    for k in range(2, order + 1):
        shorter = ends[-1]
        # the n-gram that ends here: the (n-1)-gram that ended one word ago, and this word
        ago = np.concatenate((shorter[:1], shorter[:-1]))
        ends.append(mix(ago * np.uint64(0x9E3779B97F4A7C15) + words * np.uint64(2) + np.uint64(k)))
    return text, before, ends


def _parts(grams: np.ndarray, parts: int) -> np.ndarray:
    return (mix(grams ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", order: int = 2, backoff: float = 0.4) -> DataFrame:
    """One row for each row: ``doc_id``, ``n_words``, ``n_backoff``, ``log_score``, ``mean_log_score``.

    A word's score is the count of the longest n-gram, up to ``order``, that ends in it and
    occurs elsewhere, over the count of that n-gram without its last word, times ``backoff`` for
    each order given up. Counts are those of all other rows: a text does not vouch for itself,
    its copies do. A word that occurs nowhere else counts one half. ``n_backoff`` words gave up an order
    at least. Words are runs of letters, digits and underscores, in lower case. Null, empty and
    wordless texts score 0 with a null mean; null and repeated ids are rows like others; where
    all other rows together have no word, each word scores as half of one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chars = rows.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    chunks, parts = max(1, ceil(chars / CHUNK_CHARS)), max(1, ceil(chars / 6 / PART_WORDS))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "t"), F.lit(chunks)).cast("int"))
    dealt = dealt.select("chunk", F.col("id").cast("string").alias("id"), "t")

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        lists = word_hash_lists(part["t"].tolist())
        _, before, ends = _grams(lists, order)
        chunk = int(part["chunk"].iloc[0])
        out = [(chunk, 0, 0, np.zeros(1, np.int64), np.array([len(before)], np.int32))]
        for k in range(order):
            u, n = np.unique(ends[k][before >= k], return_counts=True)
            p = _parts(u, parts)
            by = np.argsort(p, kind="stable")
            cuts = np.flatnonzero(np.diff(p[by])) + 1
            for at in np.split(by, cuts) if len(by) else []:
                out.append((chunk, k + 1, int(p[at[0]]), u[at].view(np.int64), n[at].astype(np.int32)))
        return pd.DataFrame(out, columns=["chunk", "n", "part", "grams", "counts"])

    def count(asked: pd.DataFrame) -> pd.DataFrame:
        grams = np.concatenate(asked["grams"].tolist())
        u, back = np.unique(grams, return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(asked["counts"].tolist())).astype(np.int64)[back]
        cuts = np.cumsum([len(g) for g in asked["grams"]])[:-1]
        return pd.DataFrame({"chunk": asked["chunk"], "n": asked["n"], "part": asked["part"], "totals": np.split(total, cuts)})

    def score(part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        lists = word_hash_lists(part["t"].tolist())
        where, before, ends = _grams(lists, order)
        answers = {(n, p): t for n, p, t in zip(told["n"], told["part"], told["totals"], strict=True)}
        words = np.bincount(where, minlength=len(lists))
        elsewhere = int(answers[0, 0][0]) - words[where]
        counts = []  # per order, of the n-gram that ends at each word: its count in other rows
        for k in range(order):
            at = np.flatnonzero(before >= k)
            u, back = np.unique(ends[k][at], return_inverse=True)
            p = _parts(u, parts)
            total = np.zeros(len(u), dtype=np.int64)
            for q in np.unique(p).tolist():
                total[p == q] = answers[k + 1, q]
            _, own, many = np.unique(where[at] * max(1, len(u)) + back, return_inverse=True, return_counts=True)
            c = np.zeros(len(before), dtype=np.int64)
            c[at] = total[back] - many[own]
            counts.append(c)
        value = np.log(np.maximum(counts[0], 0.5) / np.maximum(elsewhere, 1)) + (order - 1) * log(backoff)
        given_up = np.full(len(before), order > 1)
        for k in range(1, order):
            seen = counts[k] > 0
            context = np.concatenate((counts[k - 1][:1], counts[k - 1][:-1]))
            value[seen] = np.log(counts[k][seen] / context[seen]) + (order - 1 - k) * log(backoff)
            given_up[seen] = k < order - 1
        return pd.DataFrame({
            "id": part["id"], "n_words": words, "n_backoff": np.bincount(where[given_up], minlength=len(lists)),
            "log_score": np.bincount(where, weights=value, minlength=len(lists)).astype(float),
        })

    asked = dealt.groupBy("chunk").applyInPandas(ask, "chunk int, n int, part int, grams array<bigint>, counts array<int>")
    told = asked.groupBy("n", "part").applyInPandas(count, "chunk int, n int, part int, totals array<bigint>")
    done = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(score, "id string, n_words bigint, n_backoff bigint, log_score double")
    return done.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_words", "n_backoff", F.round(F.col("log_score") + F.lit(3e-10), 6).alias("log_score"),
        F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")) + F.lit(3e-10), 6).alias("mean_log_score"),
    )

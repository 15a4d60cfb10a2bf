"""Language identification by one bit-sliced Bloom filter over character n-grams.

A slot of the filter holds one bit per language. An n-gram reads ``hashes`` slots; the AND of
their masks names, at once, every language whose inventory has it. Per text and language the
hits are counted, the share that the filter would give by chance is taken out, and what is
left decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.llm.common import code_points, hashed_unit, letter_table, mix

#: n-gram sizes in characters; a word is padded with one space on each side.
SIZES = (2, 3, 4)
#: Characters handled at once; a stretch ends where no letter follows, so no n-gram is cut.
STRETCH = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    slices: np.ndarray  # (slots, words of 64 languages)
    prior: np.ndarray  # per language, its share of the labelled rows
    chance: np.ndarray  # per language, the filter's false-positive rate
    hashes: int


def _letters(text: str) -> np.ndarray:
    """Lower-case letters with every other run of characters turned into one space."""
    cp = letter_table()[code_points(text)]
    keep = (cp != 0) | (np.roll(cp, 1) != 0)
    if len(cp):
        keep[0] = True
    out = np.where(cp == 0, 32, cp)[keep].astype(np.uint64)
    return np.concatenate(([np.uint64(32)], out, [np.uint64(32)])) if len(out) else out


def gram_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each n-gram occurrence of the text; grams of spaces only are left out."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    s = _letters(text)
    out = []
    for size in SIZES:
        n = len(s) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, dtype=np.uint64)
        real = np.zeros(n, dtype=bool)
        inner = np.ones(n, dtype=bool)
        for j in range(size):
            part = s[j : j + n]
            h = h * np.uint64(0x100000001B3) + part
            real |= part != 32
            if 0 < j < size - 1:
                inner &= part != 32
        out.append(mix(h)[real & inner])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _slots(h: np.ndarray, hashes: int, slots: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(slots)).astype(np.int64) for i in range(hashes)]


def fit_languages(
    labelled: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    sample: int = 2000, inventory: int = 20000, hashes: int = 4, bits: int = 16, seed: int = 11,
) -> LanguageModel:
    """Fit on at most ``sample`` labelled rows of each language, chosen by a digest of the id.

    An n-gram enters a language's inventory if it is among the ``inventory`` grams that most of
    the language's sampled texts hold (ties by hash); grams of a single text never do unless the
    language has just one text. The filter has ``bits`` slots per member. Rows whose language or
    text is null teach nothing. The grams are counted on the executors; the driver receives at
    most ``inventory`` hashes for each language.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("t"), F.col(lang).alias("l"), hashed_unit(F.col(id_col), seed=seed).alias("k")
    )
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(10001).collect()}
    if len(sizes) > 10000:
        raise ValueError("more than 10,000 languages: this is no language column")
    # a digest below sample / n keeps about `sample` of a language's n rows, without a sort
    share = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, sample / n))]) if sizes else None
    rows = rows.filter(F.col("k") < share[F.col("l")] if sizes else F.lit(False)).select("l", "t")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, part in batch.groupby("l", sort=False):
                counted: dict[str, np.ndarray] = {}
                h = np.concatenate([np.unique(gram_hashes(t)) for t in part["t"]] or [np.zeros(0, np.uint64)])
                u, n = np.unique(h, return_counts=True)
                counted["g"], counted["n"] = u.view(np.int64), n.astype(np.int64)
                yield pd.DataFrame({"l": label, **counted})

    counts = rows.mapInPandas(grams, "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    # how many grams are as frequent: a small table, so no language's grams are ever sorted
    by_n = counts.groupBy("l", "n").agg(F.count("*").alias("c"))
    above = F.sum("c").over(Window.partitionBy("l").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    floors = by_n.withColumn("above", above - F.col("c")).filter(F.col("above") < inventory)
    floors = floors.groupBy("l").agg(F.min("n").alias("floor"), F.max("n").alias("top"))
    chosen = counts.join(floors, "l").filter((F.col("n") >= F.col("floor")) & ((F.col("n") > 1) | (F.col("top") == 1)))
    members: dict[str, list[tuple[int, int]]] = {}
    for r in chosen.select("l", "g", "n").toLocalIterator():
        members.setdefault(r["l"], []).append((-r["n"], r["g"]))
    languages = tuple(sorted(members))
    most = max([1, *(min(len(m), inventory) for m in members.values())])
    slots = max(64, most * bits)
    slices = np.zeros((slots, (len(languages) + 63) // 64 or 1), dtype=np.uint64)
    prior = np.array([sizes[name] for name in languages], dtype=float)
    for i, name in enumerate(languages):
        kept = np.array([g for _, g in sorted(members[name])[:inventory]], dtype=np.int64).view(np.uint64)
        for at in _slots(kept, hashes, slots):
            np.bitwise_or.at(slices[:, i // 64], at, np.uint64(1 << (i % 64)))
    bit = [(slices[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages))]
    chance = np.array([float(b.mean()) ** hashes for b in bit])
    return LanguageModel(languages, slices, prior / max(1.0, prior.sum()), chance, hashes)


def language_counts(model: LanguageModel, text: str) -> tuple[int, np.ndarray]:
    """How many n-grams the text has, and for each language how many of them its bits name."""
    total, hits = 0, np.zeros(len(model.languages), dtype=np.int64)
    start = 0
    while start < len(text):
        end = min(len(text), start + STRETCH)
        while end < len(text) and text[end].isalpha():
            end += 1
        h = gram_hashes(text[start:end])
        start = end
        total += len(h)
        if not len(h):
            continue
        masks = None
        for at in _slots(h, model.hashes, len(model.slices)):
            found = model.slices[at]
            masks = found if masks is None else masks & found
        for i in range(len(model.languages)):
            hits[i] += int(((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum())
    return total, hits


def decide(model: LanguageModel, text: str | None) -> tuple[str, float, float]:
    """The language, its share of the evidence, and the share of n-grams that it explains."""
    if not text or not model.languages or not any(c.isalpha() for c in text):
        return "und", 0.0, 0.0
    total, hits = language_counts(model, text)
    if not total:
        return "und", 0.0, 0.0
    true = np.clip((hits - total * model.chance) / (total * np.maximum(1e-9, 1 - model.chance)), 0, 1)
    # the explained shares as odds, firmer for longer texts; equal evidence falls to the commoner language
    odds = model.prior * np.exp(np.clip(8.0 * (true - true.max()) * min(4.0, np.sqrt(total / 8)), -60, 0))
    best = int(np.argmax(odds))
    return model.languages[best], float(odds[best] / odds.sum()), float(true[best])


def predicted(model: LanguageModel, text: Column) -> Column:
    """A struct of ``lang_pred``, ``score`` and ``explained`` for a text column.

    Null texts and texts without a letter get ``und`` and score 0, as does every text if no
    language was learned; a text whose letters no inventory has gets the commonest language
    and its share of the labelled rows as score. Other columns, repeated rows
    and equal ids play no part.
    """

    @F.pandas_udf("lang_pred string, score double, explained double")
    def decided(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decide(model, t) for t in texts], columns=["lang_pred", "score", "explained"])

    return decided(text)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """``(row, lang_pred, score, explained)``: the given row, packed, beside its language."""
    return docs.select(F.struct("*").alias("row"), predicted(model, F.col(text)).alias("found")).select("row", "found.*")


def accepted(docs: DataFrame, model: LanguageModel, *, text: str = "text", least: float = 0.05) -> DataFrame:
    """The rows in some learned language: a language was found, and it explains more than
    ``least`` of the text's n-grams beyond chance. Columns stay as they are; a frame in which
    nothing could be learned keeps every row that has a letter."""
    found = identify(docs, model, text=text)
    if not model.languages:
        return found.filter(F.col("row").getField(text).rlike(r"\p{L}")).select("row.*")
    return found.filter((F.col("lang_pred") != "und") & (F.col("explained") > least)).select("row.*")

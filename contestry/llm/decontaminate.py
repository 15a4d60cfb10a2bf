"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage of
the corpus with block-max WAND, and a check of question and answer on what it retrieves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import shingle_hashes, word_hash_lists

#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Postings that share one block maximum.
BLOCK = 64
#: Bytes of item text in one index; more text makes more indexes, each searched by all passages.
SHARD_BYTES = 16 << 20
END = 1 << 62
#: Texts whose words are held at once.
SLICE = 1000


@dataclass(frozen=True)
class Item:
    item_id: int
    question: np.ndarray  # distinct shingle hashes
    width: int
    answer: np.ndarray  # distinct word hashes


@dataclass(frozen=True)
class ItemIndex:
    items: tuple[Item, ...]
    vocabulary: np.ndarray  # sorted word hashes
    bounds: np.ndarray  # per word, its largest impact on any item
    postings: tuple[tuple[np.ndarray, np.ndarray], ...]  # per word: item positions, impacts
    blocks: tuple[tuple[np.ndarray, np.ndarray], ...]  # per word: last position and largest impact of each block
    window: int
    lean: "Lean"


@dataclass(frozen=True)
class Lean:
    """Postings of the telling words alone: what all other words can add to an item is known
    and small, so passages are first judged by these short lists."""

    offsets: np.ndarray  # per word of the vocabulary, where its postings begin; one more at the end
    positions: np.ndarray
    impacts: np.ndarray
    others: np.ndarray  # per item, what the words without lean postings can add at most


def build_index(items: list[tuple[int, str | None]], width: int = 5, answer_share: float = 1 / 3) -> ItemIndex:
    """Index the items. An impact is a word's BM25 weight as a share of the item's score against
    itself, so that one threshold fits items of all lengths. The last ``answer_share`` of an
    item's words is its answer, the rest its question. Items without a word are left out."""
    words = [(i, w) for (i, _), w in zip(items, word_hash_lists([t for _, t in items]), strict=True) if len(w)]
    if not words:
        empty = np.zeros(0, dtype=np.uint64)
        return ItemIndex((), empty, np.zeros(0), (), (), 2, Lean(np.zeros(1, int), np.zeros(0, int), np.zeros(0), np.zeros(0)))
    mean = sum(len(w) for _, w in words) / len(words)
    counted = [np.unique(w, return_counts=True) for _, w in words]
    vocabulary, df = np.unique(np.concatenate([u for u, _ in counted]), return_counts=True)
    idf = np.log(1 + (len(words) - df + 0.5) / (df + 0.5))
    lists: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
    made = []
    for pos, ((item_id, w), (u, tf)) in enumerate(zip(words, counted, strict=True)):
        at = np.searchsorted(vocabulary, u)
        impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
        for t, x in zip(at.tolist(), (impact / impact.sum()).tolist(), strict=True):
            lists[t].append((pos, x))
        cut = max(1, len(w) - max(1, round(len(w) * answer_share))) if len(w) > 1 else 1
        answer = w[cut:] if cut < len(w) else w
        made.append(Item(item_id, shingle_hashes(w[:cut], width), min(width, cut), np.unique(answer)))
    postings = tuple((np.array([p for p, _ in x]), np.array([v for _, v in x])) for x in lists)
    blocks = tuple(
        (np.array([p[min(k + BLOCK, len(p)) - 1] for k in range(0, len(p), BLOCK)]), np.array([v[k : k + BLOCK].max() for k in range(0, len(p), BLOCK)]))
        for p, v in postings
    )
    longest = max(len(w) for _, w in words)
    return ItemIndex(tuple(made), vocabulary, np.array([v.max() for _, v in postings]), postings, blocks, 2 * longest, _lean(postings, len(made)))


def _lean(postings: tuple[tuple[np.ndarray, np.ndarray], ...], items: int, spare: float = 0.3) -> Lean:
    """Leave out the words of most items first, as long as no item loses over ``spare`` of itself."""
    others = np.zeros(items)
    telling = np.ones(len(postings), dtype=bool)
    for t in sorted(range(len(postings)), key=lambda t: -len(postings[t][0])):
        pos, impact = postings[t]
        if (others[pos] + impact <= spare).all():
            others[pos] += impact
            telling[t] = False
    counts = np.array([len(p) if k else 0 for (p, _), k in zip(postings, telling, strict=True)])
    chosen = [postings[t] for t in np.flatnonzero(telling)]
    flat = [np.concatenate([x[k] for x in chosen] or [np.zeros(0)]) for k in (0, 1)]
    return Lean(np.concatenate(([0], np.cumsum(counts))), flat[0].astype(np.int64), flat[1], others)


class _Cursor:
    """A place in one word's postings."""

    __slots__ = ("bound", "doc", "impacts", "k", "last", "most", "positions")

    def __init__(self, index: ItemIndex, term: int):
        self.positions, self.impacts = index.postings[term]
        self.last, self.most = index.blocks[term]
        self.bound, self.k, self.doc = float(index.bounds[term]), 0, int(self.positions[0])

    def seek(self, target: int) -> None:
        self.k += int(np.searchsorted(self.positions[self.k :], target))
        self.doc = int(self.positions[self.k]) if self.k < len(self.positions) else END

    def block(self, target: int) -> tuple[float, int]:
        """Largest impact and last position of the block that would hold ``target``."""
        b = int(np.searchsorted(self.last, target))
        return (float(self.most[b]), int(self.last[b])) if b < len(self.last) else (0.0, END)


def search(index: ItemIndex, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items, as positions, whose score against the distinct query terms is at least the
    threshold, by block-max WAND: words in order of their next item; the first word at which
    the running bound reaches the threshold gives the pivot; block maxima may skip it."""
    live = [_Cursor(index, int(t)) for t in terms]
    out = []
    slack = threshold - 1e-12
    while True:
        live = sorted((c for c in live if c.doc < END), key=lambda c: c.doc)
        bound, pivot = 0.0, -1
        for n, c in enumerate(live):
            bound += c.bound
            if bound >= slack:
                pivot = n
                break
        if pivot < 0:
            return out
        target = live[pivot].doc
        while pivot + 1 < len(live) and live[pivot + 1].doc == target:
            pivot += 1
        reach = [c.block(target) for c in live[: pivot + 1]]
        if sum(r for r, _ in reach) < slack:
            # nothing before the end of the nearest block, or before the next word's item, can reach it
            jump = min([last + 1 for _, last in reach] + ([live[pivot + 1].doc] if pivot + 1 < len(live) else []))
            for c in live[: pivot + 1]:
                c.seek(max(jump, target + 1))
            continue
        if live[0].doc == target:
            score = float(sum(c.impacts[c.k] for c in live[: pivot + 1]))
            if score >= slack:
                out.append((target, score))
            for c in live[: pivot + 1]:
                c.seek(target + 1)
        else:
            for c in live[:pivot]:
                if c.doc < target:
                    c.seek(target)


def leaks_of(index: ItemIndex, texts: list[np.ndarray], threshold: float, overlap: float) -> list[list[tuple[int, float, float, float]]]:
    """``(item_id, score, question, answer)`` for each item that a text leaks, for each text.

    Passages of ``window`` words begin at every half window, so every item lies whole in one of
    them. The telling words of both its halves, and the most that all other words can add, bound what
    a passage can score on an item; an item's telling words may all lie in one half, whichever.
    The passages that may reach the threshold query the index.
    """
    out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
    sizes = np.array([len(w) for w in texts])
    if not len(index.vocabulary) or not sizes.sum():
        return out
    words = np.concatenate(texts)
    half = index.window // 2
    blocks_of = -(-sizes // half)
    first_block = np.cumsum(blocks_of + 1) - (blocks_of + 1)  # a gap after each text: no passage spans two
    first_word = np.cumsum(sizes) - sizes
    block = np.repeat(first_block, sizes) + (np.arange(len(words)) - np.repeat(first_word, sizes)) // half
    at = np.searchsorted(index.vocabulary, words)
    at[at == len(index.vocabulary)] = 0
    known = index.vocabulary[at] == words
    lean, n = index.lean, len(index.items)
    told = np.flatnonzero(known)
    told = told[lean.offsets[at[told] + 1] > lean.offsets[at[told]]]
    # a word counts once in a half window, as it does in a query
    once = np.unique(block[told] * len(index.vocabulary) + at[told])
    told, term = once // len(index.vocabulary), once % len(index.vocabulary)
    begin = lean.offsets[term]
    count = lean.offsets[term + 1] - begin
    place = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    key, back = np.unique(np.repeat(told, count) * n + lean.positions[place], return_inverse=True)
    mass = np.bincount(back, weights=lean.impacts[place], minlength=len(key))
    after = np.minimum(np.searchsorted(key, key + n), max(0, len(key) - 1))
    with_next = mass + np.where(key[after] == key + n, mass[after], 0.0) if len(key) else mass
    hopeful = key[with_next + lean.others[key % n] >= threshold - 1e-9] // n
    # passages whose first half has no telling word of the item; none begins before its text
    alone = ~np.isin(key - n, key) & ~np.isin(key // n, first_block)
    late = key[alone & (mass + lean.others[key % n] >= threshold - 1e-9)] // n - 1
    hopeful = np.unique(np.concatenate((hopeful, late)))
    for b in hopeful.tolist():
        doc = int(np.searchsorted(first_block, b, side="right")) - 1
        lo = int(first_word[doc]) + (b - int(first_block[doc])) * half
        hi = min(lo + index.window, int(first_word[doc] + sizes[doc]))
        passage = words[lo:hi]
        for pos, score in search(index, np.unique(at[lo:hi][known[lo:hi]]), threshold):
            item = index.items[pos]
            question = float(np.isin(item.question, shingle_hashes(texts[doc], item.width)).mean())
            answer = float(np.isin(item.answer, passage).mean())
            if question >= overlap - 1e-9 and answer >= overlap - 1e-9:
                out[doc].append((item.item_id, score, question, answer))
    best = []
    for hits in out:
        per_item: dict[int, tuple[int, float, float, float]] = {}
        for h in sorted(hits):  # the last is the best passage's
            per_item[h[0]] = h
        best.append(list(per_item.values()))
    return best


def _in_parts(index: ItemIndex, texts: list[np.ndarray], threshold: float, overlap: float, words: int = 1 << 20) -> Iterator[list[tuple]]:
    """:func:`leaks_of` over stretches of texts of about ``words`` words together."""
    held: list[np.ndarray] = []
    size = 0
    for w in texts:
        held.append(w)
        size += len(w)
        if size > words:
            yield from leaks_of(index, held, threshold, overlap)
            held, size = [], 0
    yield from leaks_of(index, held, threshold, overlap)


def item_shards(benchmark: DataFrame, id_col: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most ``SHARD_BYTES`` of text (one item at least), dealt by
    digest, so that what a task holds never grows with the benchmark. Null ids are left out."""
    named = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = named.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    shards = max(1, ceil(size / SHARD_BYTES))
    for k in range(shards):
        yield [(r["i"], r["t"]) for r in named.filter(F.pmod(F.xxhash64("i"), F.lit(shards)) == k).orderBy("i", "t").collect()]


def leaks(docs_text: Column, benchmark: DataFrame, *, threshold: float = 0.5, overlap: float = 0.8, width: int = 5) -> Column:
    """An array of ``(item_id, score, question, answer)`` for a text column.

    An item is leaked if some passage scores at least ``threshold`` of the item's score against
    itself, the text holds at least ``overlap`` of the question's distinct ``width``-word
    shingles, and the passage at least ``overlap`` of the answer's distinct words. Null and
    empty texts leak nothing; an empty benchmark leaks nothing; rows that repeat an id report as one.
    """
    kind = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"
    def searcher(index: ItemIndex):
        @F.pandas_udf(kind)
        def searched(texts: pd.Series) -> pd.Series:
            return pd.Series([
                [{"item_id": i, "score": s, "question": q, "answer": a} for i, s, q, a in found]
                for lo in range(0, len(texts), SLICE)
                for found in _in_parts(index, word_hash_lists(list(texts.iloc[lo : lo + SLICE])), threshold, overlap)
            ])

        return searched

    found = [searcher(build_index(shard, width))(docs_text) for shard in item_shards(benchmark)]
    return found[0] if len(found) == 1 else F.concat(*found)


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each document and item that it leaks."""
    pairs = docs.select(F.col(id_col).alias("doc_id"), F.explode(leaks(F.col(text), benchmark, **options)).alias("hit"))
    return pairs.select("doc_id", "hit.*")


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows that leak no item; columns stay as they are."""
    rows = docs.select(F.struct("*").alias("row"), F.size(leaks(F.col(text), benchmark, **options)).alias("n"))
    return rows.filter("n = 0").select("row.*")

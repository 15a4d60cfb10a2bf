"""Benchmark passages: nothing is lost between the bound on telling words and the search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from contestry.llm import decontaminate
from contestry.llm.common import shingle_hashes, word_hashes


def every_passage(index, words, threshold, overlap):
    """All passages search the index; no bound comes first."""
    found, half = set(), index.window // 2
    for lo in range(0, max(1, len(words)), half):
        passage = words[lo : lo + index.window]
        terms = np.flatnonzero(np.isin(index.vocabulary, passage))
        for pos, _ in decontaminate.search(index, terms, threshold):
            item = index.items[pos]
            if np.isin(item.question, shingle_hashes(words, item.width)).mean() >= overlap - 1e-9 and np.isin(item.answer, passage).mean() >= overlap - 1e-9:
                found.add(item.item_id)
    return found


def benchmark(seed, n, shared):
    """Items of common words with few rare ones, which stand at the beginning, the end or nowhere."""
    r = random.Random(seed)
    common = [f"common{k}" for k in range(40)]
    items = []
    for i in range(n):
        body = r.choices(common, k=r.randint(12, 40))
        rare = [f"rare{i}x{k}" for k in range(r.randint(1, 3))] if i >= shared else []
        items.append((i, " ".join(r.choice([rare + body, body + rare, body[:5] + rare + body[5:]]))))
    return items


@pytest.mark.parametrize("seed", range(3))
def test_verbatim_copies_at_all_offsets(seed):
    r = random.Random(seed)
    items = benchmark(seed, 60, 12)
    index = decontaminate.build_index(items)
    texts, holds = [], []
    for offset in range(0, index.window + 1, 2):
        for i, text in r.sample(items, 6):
            filler = [f"fill{r.randint(0, 400)}" for _ in range(offset)]
            after = [f"fill{r.randint(0, 400)}" for _ in range(r.randint(0, 50))]
            texts.append(word_hashes(" ".join([*filler, text, *after])))
            holds.append(i)
    got = [{hit[0] for hit in hits} for hits in decontaminate.leaks_of(index, texts, 0.5, 0.8)]
    assert all(i in found for i, found in zip(holds, got, strict=True))
    assert got == [every_passage(index, words, 0.5, 0.8) for words in texts]


def test_texts_next_to_each_other_share_no_passage():
    items = benchmark(9, 30, 5)
    index = decontaminate.build_index(items)
    halves = [text.split() for _, text in items]
    texts = [word_hashes(" ".join(part)) for w in halves for part in (w[: len(w) // 2], w[len(w) // 2 :])]
    got = [{hit[0] for hit in hits} for hits in decontaminate.leaks_of(index, texts, 0.5, 0.8)]
    assert got == [every_passage(index, words, 0.5, 0.8) for words in texts]


def test_a_copy_without_the_rarest_words_is_still_retrieved(spark):
    """0.8 of the question's shingles and of the answer's words, but neither of the two rare ones."""
    common = [f"common{k}" for k in range(13)]
    item = " ".join([*common[:9], "rarest", *common[9:], "scarcest"])
    fill = [" ".join(common[::-1]) if k < 20 else f"other{k} thing{k}" for k in range(39)]
    bench = spark.createDataFrame([(1, item), *((100 + k, x) for k, x in enumerate(fill))], "item_id long, text string")
    docs = spark.createDataFrame([(7, " ".join([*common[:9], "plain", *common[9:], "usual"]))], "doc_id long, text string")
    found = lambda **o: {r.item_id for r in decontaminate.leaked_pairs(docs, bench, **o).collect()}
    assert 1 in found() and 1 not in found(threshold=0.6)

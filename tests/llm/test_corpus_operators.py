"""Operators on documents against brute force, with nulls, empties, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.llm import backoff, decontaminate, jaccard_join, language, mixing, pii, toxicity
from contestry.llm.common import held_out, shingle_hashes, word_hash_lists, word_hashes
from contestry.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, taken long"


def frame(spark, rows):
    """Documents with two columns whose names operators use for their own."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "own", 7) for i, t, g, s in rows], SCHEMA)


def prose(seed, n, letters="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def test_word_hashes_follow_words():
    texts = ["Größe größe GRÖSSE x_1", "", None, "...", "a" * 3000 + " b", "naïve, naïve"]
    together = word_hash_lists(texts)
    for t, h in zip(texts, together, strict=True):
        assert h.tolist() == word_hashes(t).tolist()
        seen = {}
        assert len(h) == len(words_of(t))
        for w, x in zip(words_of(t), h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(together[0].tolist())) == len(set(words_of(texts[0])))
    assert len(shingle_hashes(word_hashes("a b"))) == 1 and len(shingle_hashes(word_hashes("a b c d e f"))) == 2


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 7), (5, 5), (None, 4), (20, 21), (21, 22), (22, 23), (23, 24)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, 5 + i % 40), None, s) for i, s in enumerate(["a", "a", "a", "b", None, "c"] * 30)]
    rows += [(500, None, None, "a"), (501, " \t ", None, "b"), (502, "", None, "empty"), (7, prose(7, 12), None, "b"), (7, prose(7, 12), None, "b"), (None, "x y", None, "c")]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, closed = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in closed)
        level = left / sum(weight[s] for s in order if s not in closed)
        above = {s for s in order if s not in closed and level * weight[s] > 2 * size[s]} | {s for s in order if not size[s] and s not in closed}
        if not above:
            break
        closed |= above
    for s in order:
        target[s] = 2 * size[s] if s in closed else level * weight[s]
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and abs(r.target - target[s]) < 1e-5 and 0 <= r.taken <= 2 * r["size"] for r in mine)
        assert sum(r.taken for r in mine) == math.floor(target[s] + 1e-9)
    kept = mixing.mixed_rows(docs)
    assert kept.count() == sum(r.taken > 0 for r in got) and set(docs.columns) < set(kept.columns)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_quality_weighs_the_partial_epoch(spark):
    rows = [(i, "clean words of prose here" if i % 2 else "### *** $$$ %%% &&&", None, "one") for i in range(2000)] + [(5000 + i, "w " * 50, None, "two") for i in range(2000)]
    got = mixing.mix(frame(spark, rows), weights=(1.0, 40.0)).filter("source = 'one'").collect()
    taken = [sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert taken[1] > 2 * taken[0] > 0


@pytest.fixture(scope="module")
def tongues(spark):
    rows = []
    for k, (lang, letters) in enumerate((("xx", "abcdef"), ("yy", "ghijkl"), ("zz", "mnopqr"))):
        rows += [(1000 * k + i, prose((k, i).__hash__(), 30 + i, letters), lang, "s") for i in range(60)]
    odd = [(9000, None, "xx", "s"), (9001, "123 ... 456", "xx", "s"), (9002, "", "yy", "s"), (9003, "ab", None, "s"), (9004, "日本語の文章", None, "s"), (None, prose(1, 50, "ghijkl"), "yy", "s")]
    return frame(spark, rows + odd)


def test_language(spark, tongues):
    model = language.fit_languages(tongues.filter(~held_out(5, 0)))
    assert model.languages == ("xx", "yy", "zz")
    got = {r.row.doc_id: r for r in language.identify(tongues, model).collect()}
    held = [r for r in got.values() if r.row.lang and r.row.text and r.row.text[0].isalpha() and (r.row.doc_id is None or zlib_held(r.row.doc_id))]
    assert len(held) > 20 and all(r.lang_pred == r.row.lang for r in held)
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and got[9004].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.accepted(tongues, model)
    assert kept.columns == tongues.columns and {9000, 9001, 9002}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() >= 180
    long = "abc def " * 200_000
    assert language.decide(model, long)[0] == "xx"
    assert language.fit_languages(tongues.limit(0)).languages == () and language.accepted(tongues.limit(0), model).count() == 0


def zlib_held(i, m=5, r=0):
    import zlib

    return zlib.crc32(str(i).encode()) % m == r


def test_bloom_false_positives_are_taken_out():
    model = language.LanguageModel(("a",), np.zeros((64, 1), dtype=np.uint64), np.array([1.0]), np.array([0.3]), 2)
    assert language.decide(model, "some letters")[2] == 0.0


def similar(rows, width=5, threshold=0.8):
    sets, texts = {}, {}
    for i, t, *_ in rows:
        if i is None:
            continue
        w = words_of(t)
        k = min(width, len(w))
        sets[i] = {(k, *w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        texts[i] = t or ""
    ids, links, least = sorted(sets), Counter(), {i: i for i in sets}
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    for _ in ids:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (least[i], links[i]) for i in ids}


def near_copies():
    rows = []
    for g in range(8):
        base = prose(g, 120).split()
        for c in range(12):
            w = list(base)
            for k in range(c // 2):
                w[(17 * k + 11 * g) % len(w)] = f"edit{c}x{k}"
            rows.append((100 * g + c, " ".join(w), "en", "s"))
    rows += [(900, "", "en", "s"), (901, None, "en", "s"), (902, "...", "en", "s"), (903, "Two words", "en", "s"), (904, "two WORDS", "en", "s"), (905, "two words more", "en", "s")]
    rows += [(906, rows[0][1], "en", "s"), (907, rows[0][1], "en", "s"), (0, rows[0][1], "en", "s"), (None, rows[0][1], "en", "s"), (None, "lonely", "en", "s")]
    return rows


def test_jaccard_join(spark):
    rows = near_copies()
    want = similar(rows)
    for block in (64, 5):  # the second deals every cluster to several blocks
        got = jaccard_join.join_similar(frame(spark, rows), block=block, bucket=8 if block == 5 else 1024).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    assert {r.doc_id: r.text_class for r in got}[907] == 0
    assert jaccard_join.join_similar(frame(spark, []).limit(0)).count() == 0


def test_one_of_each(spark):
    rows = near_copies()
    docs = frame(spark, rows)
    kept = jaccard_join.one_of_each(docs)
    want = similar(rows)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (c, _) in want.items() if c == i) and ids.count(None) == 2


def test_pruning_bounds():
    p = (np.arange(200_000) + 0.5) / 200_000
    for n in (16, 32, 80):
        def posterior(m, n=n):
            density = np.exp(m * np.log(p) + (n - m) * np.log1p(-p))
            return density[p >= 0.8].sum() / density.sum()

        least = jaccard_join.least_matches(n, 0.8, 1e-6)
        assert posterior(least) >= 1e-6 > posterior(least - 1)
    a = np.tile(np.arange(80, dtype=np.uint32), (2, 1))
    b = a.copy()
    b[1, :60] += 1000
    assert jaccard_join.surviving(a, b, 0.8, 1e-6).tolist() == [[True, False], [True, False]]


def test_decontamination(spark):
    items = [(i, prose(("item", i).__hash__() % 1000, 20 + i, "stuvwxyzab")) for i in range(60)] + [(90, None), (91, ""), (None, "x y z"), (92, "one"), (5, prose(("item", 5).__hash__() % 1000, 25, "stuvwxyzab"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {i: t for i, t in items if i is not None and t}
    near = texts[7].split()
    near[1] = "changed"
    rows = [(1, prose(1, 300) + " " + texts[3] + " " + prose(2, 300), "en", "s"), (2, texts[8].upper() + "! " + texts[9], "en", "s"), (3, " ".join(near), "en", "s"), (4, prose(3, 5000), "en", "s"),
            (5, None, "en", "s"), (6, "", "en", "s"), (7, " ".join(texts[20].split()[:12]), "en", "s"), (8, " ".join(reversed(texts[30].split())), "en", "s"), (1, texts[40], "en", "s")]
    docs = frame(spark, rows)
    got = decontaminate.leaked_pairs(docs, bench)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 3), (1, 40), (2, 8), (2, 9), (3, 7)]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8]
    assert decontaminate.leaked_pairs(docs, bench.limit(0)).count() == 0 and decontaminate.leaked_pairs(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_wand_finds_all_above_the_threshold(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(4, 14)))) for i in range(400)]
    index = decontaminate.build_index(items)
    for _ in range(20):
        query = np.unique(word_hashes(" ".join(r.choices(vocabulary, weights, k=12))))
        terms = np.flatnonzero(np.isin(index.vocabulary, query))
        full = np.zeros(len(items))
        for t in terms:
            pos, impact = index.postings[t]
            full[pos] += impact
        for threshold in (0.2, 0.5, 0.8):
            assert dict(decontaminate.search(index, terms, threshold)) == pytest.approx({i: full[i] for i in np.flatnonzero(full >= threshold - 1e-12)})


HOSTILE = [
    "mail a.b+c@x-y.example.com, ip 10.0.0.255 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "+1 (017) 555-7713 +49 30 1234567 +1 2 +(1)", "é😀 x@y.z 😀 +44 20 7946 0958",
    "a@b.c_d@e.f @@ x@y x@y.", "1" * 5000, "9.9.9.9" * 400, "0 " * 4000, "+1" + "(" * 3000, "a" * 5000 + "@", "", None, "0010.002.3.4 ip", "5500000000000004 5500005555555559 visa 5500000000000005", "joe (at) mail [.] example",
]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0


def strict(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    good = {"email": lambda m, d: True, "ip": lambda m, d: all(int(x) <= 255 for x in m.split(".")), "card": lambda m, d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 9 <= len(d) <= 15}
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good[k](m[0], re.sub("[^0-9]", "", m[0]))] for k, p in patterns.items()}


def test_personal_data(spark):
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(HOSTILE)] + [(100 + i, f"pay by card 4{i:03d} 1111 now", "en", "s") for i in range(20)] + [(0, HOSTILE[1], "en", "s"), (None, HOSTILE[0], "en", "s")])
    trees = pii.fit_trees(docs)
    got = pii.span_report(docs, trees).collect()
    assert len(got) == docs.count()
    texts = [r.text for r in docs.collect()]
    for r, t in zip(got, texts, strict=True):
        want = strict(t)
        written = [f"{k}:{a}:{b}" for k, v in want.items() for a, b in v]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert set(written) <= set(spans) and spans == sorted(spans, key=lambda x: (list(want).index(x.split(":")[0]), int(x.split(":")[1])))
    clean = pii.redacted(docs, trees).collect()
    assert [c for c in clean[0].asDict()] == docs.columns
    assert clean[0].text.startswith("mail <EMAIL>, ip <IP> and ") and clean[11].text is None and clean[2].text.startswith("<PHONE> <PHONE>")
    assert all(r.n_chars == len(r.text) for r in clean if r.text is not None)
    assert pii.span_report(docs.limit(0), pii.fit_trees(docs.limit(0))).count() == 0


def test_trees_add_what_looks_alike(spark):
    cards = [f"{4000000000000000 + 7919 * i}" for i in range(3000)]
    good = [c for c in cards if luhn(c)]
    rows = [(i, f"my card {c} ok", "en", "s") for i, c in enumerate(good)] + [(10_000, f"my card {next(c for c in cards if not luhn(c))} ok", "en", "s")] + [(20_000 + i, f"lot 7{i:013d}9x", "en", "s") for i in range(2000)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in pii.span_report(docs, pii.fit_trees(docs)).collect()}
    assert got[10_000].n_card == 0 and got[10_000].spans == "card:8:24"
    assert sum(r.spans != "" for i, r in got.items() if i >= 20_000 and not r.n_card) == 0


def test_toxicity(spark):
    r = random.Random(4)
    insults = ["zonker", "blimpface", "blimphead"]
    rows, labels = [], []
    for i in range(600):
        w = prose(i, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(insults) + r.choice(["", "en", "er"]))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    labels += [(1, 1, None), (None, 1, 1), (99_999, 1, 1), (0, 1, 1)]
    rows += [(9000, None, "en", "s"), (9001, "", "en", "s"), (9002, "a zonkeren. " * 3, "en", "s")]
    docs = frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fold = held_out(4, 2)
    model = toxicity.fit_toxicity(docs, lab.filter(~fold))
    got = {x.doc_id: x.score for x in docs.select("doc_id", toxicity.scored(model, F.col("text")).alias("score")).collect()}
    held = [(got[i], y) for i, _, y in labels if i in got and y is not None and i < 600 and zlib_held(i, 4, 2)]
    assert sum((s >= 0.3) == y for s, y in held) / len(held) > 0.95
    assert got[9000] == got[9001] < 0.3 < got[9002] and all(0 <= s <= 1 for s in got.values())
    nothing = toxicity.fit_toxicity(docs, lab.limit(0))
    assert toxicity.clause_scores(nothing, "zonker") == []


def test_grammar_composes():
    machine = toxicity.grammar()

    def read(*symbols):
        state, out = machine.start, []
        for s in symbols:
            state, o = machine.step(state, s)
            out.append(o)
        return out

    assert read("insult") == ["insult"]
    assert read("target", "word", "insult") == ["word", "word", "aimed insult"]
    assert read("negation", "word", "insult", "word", "insult") == ["word", "word", "muted insult", "word", "insult"]
    assert read("target", "report", "word", "threat") == ["word", "word", "word", "muted threat"]


def scored(rows, order=2, alpha=0.4):
    docs = [words_of(t) for _, t, *_ in rows]
    grams = [[tuple(w[max(0, j - k) : j + 1]) for j in range(len(w)) for k in range(min(order, j + 1))] for w in docs]
    total = Counter(g for x in grams for g in x)
    n = sum(map(len, docs))
    out = []
    for w, own in zip(docs, map(Counter, grams), strict=True):
        value, given_up = 0.0, 0
        for j in range(len(w)):
            for k in range(order - 1, -1, -1):
                g = tuple(w[max(0, j - k) : j + 1])
                if len(g) == k + 1 and (k == 0 or total[g] - own[g] > 0):
                    below = total[g[:-1]] - own[g[:-1]] if k else max(1, n - len(w))
                    value += math.log(max(total[g] - own[g], 0.5) / below) + (order - 1 - k) * math.log(alpha)
                    given_up += k < order - 1
                    break
        out.append((len(w), given_up, value))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(spark, order, monkeypatch):
    monkeypatch.setattr(backoff, "CHUNK_CHARS", 400)
    monkeypatch.setattr(backoff, "PART_WORDS", 20)
    rows = [(i, prose(i % 7, 30, "ab"), "en", "s") for i in range(12)] + [(50, None, "en", "s"), (51, "", "en", "s"), (52, "unheard", "en", "s"), (None, "ab ab ab", "en", "s"), (3, "ab ba", "en", "s")]
    got = backoff.score_texts(frame(spark, rows), order=order).collect()
    want = scored(rows, order)
    assert sorted((r.n_words, r.n_backoff, round(r.log_score, 4)) for r in got) == sorted((n, b, round(v, 4)) for n, b, v in want)
    assert backoff.score_texts(frame(spark, []).limit(0)).count() == 0

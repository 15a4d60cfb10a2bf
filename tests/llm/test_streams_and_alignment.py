"""Conversation repair, streaming deduplication and token alignment against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from contestry.llm import conversation_repair as repair
from contestry.llm import stream_dedup, token_alignment

SPACE = " \t\n\x0b\x0c\r"


# --- conversation repair ------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, times string"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest edits by trying every script of every row, one state at a time with whole strings."""
    best = {"": (0, "", [])}  # the last two role initials say all that the pattern needs: here, the whole initials
    well = re.compile(r"(s?(ua)*u?)?\Z")  # beginnings of well-formed wholes
    for (_, role, text), fault in zip(rows, faults_of(rows), strict=True):
        after = {}
        for fill in ("", "u", "a", "ua", "au"):
            for initials, (cost, edits, lines) in best.items():
                base = initials + fill
                if not well.match(base):
                    continue
                cost_, edits_ = cost + 3 * len(fill), edits + "I" * len(fill)
                lines_ = lines + [{"u": "user:", "a": "assistant:"}[c] for c in fill]
                offers = [(base, cost_ + 4, edits_ + "D", lines_)]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    if role[:1] in ("s", "u", "a"):
                        offers.append((base + role[:1], cost_ + more, edits_ + "K", lines_ + [f"{role}:{text}"]))
                    offers += [(base + n[0], cost_ + more + 3, edits_ + "R", lines_ + [f"{n}:{text}"]) for n in ("user", "assistant")]
                for key, *value in offers:
                    if well.match(key) and (key not in after or tuple(value) < after[key]):
                        after[key] = tuple(value)
        # of initials only the last and whether there are any matter for what may follow
        kept = {}
        for key, value in after.items():
            short = key[-1:]
            if short not in kept or value < kept[short][1]:
                kept[short] = (key, value)
        best = {key: value for key, value in kept.values()}
    done = []
    for initials, (cost, edits, lines) in best.items():
        for fill in ("", "a", "ua"):
            if re.fullmatch(r"(s?(ua)+)?", initials + fill):
                done.append((cost + 3 * len(fill), edits + "I" * len(fill), lines + [{"u": "user:", "a": "assistant:"}[c] for c in fill]))
    return min(done)


def plain_report(rows):
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    fault = Counter(faults_of(rows))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, edits, lines = plain_repair(rows)
    return (gaps, fault["blank"], fault["duplicate"], fault["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Well. \n", "!\x85", "Ünder."]
    out = []
    for conv in [*range(n), None]:
        for k in range(r.randint(1, 9)):
            turn = r.choice([k, k, k, k + 3, None, k // 2])
            row = (conv, turn, r.choice(roles), r.choice(texts), "own")
            out += [row] * r.choice([1, 1, 1, 2])
    return out


def by_conversation(rows):
    held = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        held[conv].append((turn, role, text))
    return held


@pytest.mark.parametrize("segment", [2, 4096])
def test_repair_against_all_scripts(spark, segment):
    """Small segments cut nearly every conversation; the answers are the same."""
    rows = conversations(segment, 120)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(spark.createDataFrame(rows, TURNS), segment=segment).collect()}
    want = {conv: plain_report(held) for conv, held in by_conversation(rows).items()}
    assert got == want


def test_one_long_conversation_is_worked_on_in_pieces(spark):
    r = random.Random(3)
    rows = [(1, k, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "c!", f"text {k}.", f"open {k}"]), "x") for k in range(3000)]
    rows += [(2, 0, "user", "a.", "x"), (2, 1, "assistant", "b.", "x")]
    frame = spark.createDataFrame(rows, TURNS).repartition(6)
    got = {x.conv_id: tuple(x)[1:] for x in repair.repair_conversations(frame, segment=64).collect()}
    assert got == {conv: plain_report(held) for conv, held in by_conversation(rows).items()}


def test_repair_of_nothing(spark):
    assert repair.repair_conversations(spark.createDataFrame([], TURNS)).collect() == []


def test_ties_hold_when_hashes_collide():
    """With hashes of three values nearly every comparison meets a collision."""
    r = random.Random(5)
    for modulus in (1, 3, (1 << 61) - 1):
        for _ in range(60):
            made, base = [], None
            for c in "".join(r.choice("DIKR") for _ in range(r.randint(0, 6))):
                base = repair.Trail(base, c, modulus)
            for _ in range(2):
                node = base
                for c in "".join(r.choice("KR") for _ in range(r.randint(0, 9))):
                    node = repair.Trail(node, c, modulus)
                made.append(node)
            x, y = made
            assert repair.precedes(x, y) == (repair.script(x) < repair.script(y))


def test_query_keeps_conversations_that_lose_every_row(spark, tmp_path):
    from contestry.llm.queries import damaged, op11_conversation_repair

    rows = [(k, 0, "user", "Hm.") for k in range(200)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    left = {r.conv_id for r in damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect()}
    got = {r.conv_id: r for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert len(got) == 201 and None in got and len(left) < 201
    for conv in set(got) - left:
        assert tuple(got[conv])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- exact deduplication ------------------------------------------------------------------

DOCS = "doc_id long, text string, norm string, digest long"


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups["".join(c for c in text or "" if c not in SPACE)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        members.sort()
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=repr)


def documents(seed, n):
    r = random.Random(seed)
    texts = ["", None, " ", "a b", "ab", " a\tb ", "A b", "a\x0bb", "a b", "long " * 4000, "long" * 4000 + " ", "é", "é"]
    texts += ["".join(r.choice("ab \n") for _ in range(r.randint(1, 6))) for _ in range(30)]
    rows = [(k, r.choice(texts)) for k in range(n)]
    return [*rows, *rows[:5], (None, "a b"), (None, "unique 1"), (None, None)]


def written(spark, path, rows, mode="overwrite"):
    spark.createDataFrame([(i, t, "own", 5) for i, t in rows], DOCS).repartition(3).write.mode(mode).parquet(str(path))


@pytest.mark.parametrize("weak", [False, True])
def test_dedup_against_plain_groups(spark, tmp_path, weak):
    """A digest of three values makes nearly every hit a collision: bytes decide."""
    rows = documents(1, 150)
    written(spark, tmp_path / "docs", rows)
    options = {"digest": lambda t: F.base64((F.crc32(t.cast("binary")) % 3).cast("string").cast("binary")).cast("binary")} if weak else {}
    got = stream_dedup.deduplicate(spark, str(tmp_path / "docs"), **options)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(rows)


def test_state_outlives_a_call(spark, tmp_path):
    """The second call takes in the new files alone; batches of one file each change nothing."""
    first, second = documents(2, 60), documents(3, 60)
    path, state = tmp_path / "docs", str(tmp_path / "state")
    written(spark, path, first)
    one = stream_dedup.deduplicate(spark, str(path), state=state, bytes_per_trigger=1)
    assert sorted((tuple(r) for r in one.collect()), key=repr) == plain_groups(first)
    batches = len(list((tmp_path / "state" / "groups").glob("batch=*")))
    written(spark, path, second, "append")
    two = stream_dedup.deduplicate(spark, str(path), state=state, bytes_per_trigger=1)
    assert sorted((tuple(r) for r in two.collect()), key=repr) == plain_groups(first + second)
    assert len(list((tmp_path / "state" / "groups").glob("batch=*"))) - batches in (3, 4)


def test_dedup_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "docs"))
    assert stream_dedup.deduplicate(spark, str(tmp_path / "docs")).collect() == []


# --- token alignment ----------------------------------------------------------------------


def plain_alignment(rows):
    """Byte ranges met pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_BPE)
    byte_of = token_alignment.byte_level_alphabet()

    def spans(tokens):
        at, out = 0, []
        for k, raw in tokens:
            out.append((k, at, at + len(raw)))
            at += len(raw)
        return out

    told = []
    for doc_id, text in rows:
        left = right = []
        if text:
            left = [(k, bytes(byte_of[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
            right = [(k, bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
            whole = (" " + text).encode()
            if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
                left = right = []
        left, right = spans(left), spans(right)
        links = [(x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in left} & {y[2] for y in right})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(k) for k, s, e in side if start <= s and e <= cut) for side in (left, right)))
            start = cut
        told.append((doc_id, len(left), len(right), len(groups), links, ";".join(groups)))
    counts = Counter(pair for _, _, _, _, links, _ in told for pair in set(links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(i, n_a, n_b, g, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(t.encode()).hexdigest() if t else "")
            for i, n_a, n_b, g, links, t in told]


@pytest.mark.parametrize("sizes", [{}, {"together": 40, "chunk_entries": 30}])
def test_alignment_against_byte_ranges(spark, sizes):
    r = random.Random(4)
    texts = ["", None, " ", "  two  spaces\n\n\tand tabs ", "<|endoftext|> is plain, so is <s> and <0x41>", "naïve façade — 東京 🙂🙂", "▁ a lower block", "\x00\x01\x7f",
             "é ﬁ Ⅷ ½", "internationalisation of tokenisers", "a" * 3000, "word " * 2000, " nbsp　wide"]
    words = ["align", "alignment", "Token", "izer", "izers", "un", "believable", "ed", "3.1415", "x=1;", "Straße"]
    texts += [" " * 2000 + "x", "line\n" + "\n\t" * 900 + "end", "it's WE'LL they'd", "\u0085 \u2028\u200d\ufeff"]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(40)]
    rows = [*enumerate(texts), (None, "a null id"), (3, texts[3]), (3, texts[3]), (7, "other text of a repeated id")]
    docs = spark.createDataFrame([(i, t, "own", 3) for i, t in rows], "doc_id long, text string, chunk string, n_a int").repartition(3)
    got = token_alignment.align_texts(docs, **sizes)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(plain_alignment(rows), key=repr)


def test_both_ways_of_merging_give_the_same_ids():
    a = token_alignment.ByteLevelTokenizer(token_alignment.BYTE_BPE)
    r = random.Random(6)
    pool = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + list(" '\n\t0aA") * 200
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(500)]
    fast = a.encode(texts)
    assert a._fast is not None
    a._fast = None
    assert fast == a.encode(texts)


def test_invalid_text_and_empty_table(spark):
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.unhex(F.lit("41FF42")).cast("string").alias("text"))
    assert [tuple(x) for x in token_alignment.align_texts(broken).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]
    assert token_alignment.align_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []

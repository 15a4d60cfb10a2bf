"""Cross-tokenizer alignment on Arrow columns: which tokens of one vocabulary cover which of another.

Each task encodes texts with both tokenizers and works on the flattened id lists: parent indices
say whose token an id is, segmented running sums of token lengths say where in the text it ends,
and a hash join of both sides on (text, end) finds the common ends. Read in order of the ends,
each row of the outer join is one stretch of bytes that one token of either side covers, so the
rows are exactly the overlapping pairs. Partial counts of id pairs are grouped in the task and
merged by Spark; the merged counts go back to the chunks of texts that hold the pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import staged

#: Characters encoded at once, and entries (text, id pair) of a chunk; a longer text is taken alone.
TOGETHER, CHUNK_ENTRIES = 1 << 20, 1 << 20

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: bytes that print in
    Latin-1 stand for themselves, the others are numbered on from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(prints))
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


#: How a byte-level vocabulary of this kind parts a text before merging, and the merging library's
#: limit on white space in one run (longer ones exhaust the stack of its pattern search).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST_SPACE = 500


class ByteLevelTokenizer:
    """A byte-level vocabulary (tokenizers); special tokens in texts are plain text.

    Where the file's merges come in the order of the ids that they make, which makes an id its
    rank, and its words are parted by ``WORDS``, tiktoken merges by those ranks: the same ids, at
    about three times the speed. Texts with a very long run of white space, and files
    of another kind, are left to tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._model.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        entries = self._model.get_vocab(with_added_tokens=True)
        of = [b""] * (max(entries.values()) + 1)
        for token, k in entries.items():
            of[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes = pa.array(of, pa.binary())
        self._long_space = re.compile(rf"\s{{{LONGEST_SPACE},}}")
        self._fast = self._ranked(json.loads(self._model.to_str()), alphabet)

    @staticmethod
    def _ranked(told: dict, alphabet: dict[str, int]):
        model, parted = told["model"], told["pre_tokenizer"] or {}
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        plain = model["type"] == "BPE" and parted.get("type") == "ByteLevel" and parted.get("use_regex", True) and not parted.get("add_prefix_space")
        if not plain or told["normalizer"] or merged != sorted(set(merged)) or merged[:1] < [0] or any(model.get(k) for k in ("dropout", "ignore_merges", "end_of_word_suffix")):
            return None
        import tiktoken

        special = {t["id"] for t in told["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): k for token, k in model["vocab"].items() if k not in special}
        return tiktoken.Encoding(str(len(ranks)), pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = [k for k, t in enumerate(texts) if self._fast is None or self._long_space.search(t)]
        left = set(slow)
        out = [None if k in left else self._fast.encode_ordinary(" " + t) for k, t in enumerate(texts)]
        for k, e in zip(slow, self._model.encode_batch_fast([" " + texts[k] for k in slow], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out


class PieceTokenizer:
    """A piece vocabulary with byte fallback (sentencepiece), which puts a space first itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        piece = self._model.id_to_piece
        self.bytes = pa.array(
            [bytes([int(piece(k)[3:-1], 16)]) if self._model.is_byte(k) else piece(k).replace("▁", " ").encode() for k in range(len(self._model))], pa.binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@cache
def tokenizers_at(byte_bpe: str, piece_bpe: str) -> tuple[ByteLevelTokenizer, PieceTokenizer]:
    return ByteLevelTokenizer(byte_bpe), PieceTokenizer(piece_bpe)


def _offsets(sizes: pa.Array | np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.asarray(sizes, dtype=np.int64)))).astype(np.int32))


def _encoded(tokenizer, texts: list[str]) -> pa.ListArray:
    lists = tokenizer.encode(texts)
    flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=sum(map(len, lists)))
    return pa.ListArray.from_arrays(_offsets([len(x) for x in lists]), pa.array(flat))


def _tokens(ids: pa.ListArray, entries: pa.BinaryArray, lossless: pa.Array, before: pa.Array, place: str) -> tuple[pa.Array, pa.Table]:
    """The ids of lossless texts in one column, and for each the text it is in and the byte at
    which it ends there, from a running sum that each text starts anew."""
    parent = pc.list_parent_indices(ids)
    mine = pc.take(lossless, parent)
    flat, parent = ids.flatten().filter(mine), parent.filter(mine)
    run = pc.cumulative_sum(pc.take(pc.cast(pc.binary_length(entries), pa.int64()), flat))
    end = pc.subtract(run, pc.take(before, parent))
    return flat, pa.table({"doc": parent, "end": end, place: pa.array(np.arange(len(flat), dtype=np.int32))})


def aligned(texts: pa.Array, a, b) -> tuple[dict[str, pa.Array], pa.Table]:
    """Columns with an entry for each text (``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``groups_sha256``), and the links as ``doc`` (place of the text), ``a``, ``b`` (ids)."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    given = texts.to_pylist()
    ids_a, ids_b = _encoded(a, given), _encoded(b, given)
    whole = pc.cast(pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" ")), pa.binary())
    lossless = pc.greater(pc.binary_length(texts), 0)
    for ids, entries in ((ids_a, a.bytes), (ids_b, b.bytes)):
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.take(entries, ids.flatten())), b"")
        lossless = pc.and_(lossless, pc.equal(joined, whole))
    size = np.where(lossless.to_numpy(zero_copy_only=False), pc.binary_length(whole).to_numpy(), 0).astype(np.int64)
    before = pa.array(np.cumsum(size) - size)
    flat_a, ends_a = _tokens(ids_a, a.bytes, lossless, before, "at_a")
    flat_b, ends_b = _tokens(ids_b, b.bytes, lossless, before, "at_b")

    met = ends_a.join(ends_b, keys=["doc", "end"], join_type="full outer", use_threads=False).combine_chunks()
    place = pc.add(pc.take(before, met["doc"]), met["end"])  # the ends of all texts, one after the other
    met = met.take(pc.sort_indices(place)).combine_chunks()
    doc, at_a, at_b = (met[c].combine_chunks() for c in ("doc", "at_a", "at_b"))
    # the token that covers a stretch is the one of its side that ends next
    links = pa.table({"doc": doc, "a": pc.take(flat_a, pc.fill_null_backward(at_a)), "b": pc.take(flat_b, pc.fill_null_backward(at_b))})

    common = pc.and_(pc.is_valid(at_a), pc.is_valid(at_b))
    per_doc = lambda where: np.bincount(where.to_numpy(), minlength=n).astype(np.int64)
    n_groups = per_doc(doc.filter(common))

    def side(flat: pa.Array, at: pa.Array) -> pa.Array:
        ends = np.concatenate(([0], at.filter(common).to_numpy() + 1)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pc.cast(flat, pa.string())), ",")

    groups = pc.binary_join_element_wise(side(flat_a, at_a), side(flat_b, at_b), "|")
    told = pc.binary_join(pa.ListArray.from_arrays(_offsets(n_groups), groups), ";")
    count = lambda ids: np.where(size > 0, pc.list_value_length(ids).to_numpy(), 0).astype(np.int64)
    columns = {
        "n_a": count(ids_a), "n_b": count(ids_b), "n_groups": n_groups, "n_links": per_doc(doc),
        "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told.to_pylist()],
    }
    return {k: pa.array(v) for k, v in columns.items()}, links


DOC_COLUMNS = {"id": "string", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string", "entries": "bigint"}
CHUNK_SCHEMA = "chunk bigint, " + ", ".join(f"{k} array<{v}>" for k, v in DOC_COLUMNS.items()) + ", entry array<int>, times array<int>, pair array<bigint>, docs array<int>"


def _one(values: pa.Array) -> pa.Array:
    """A list column with one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class _Chunk:
    """Texts with their distinct id pairs, until they are enough for a row of the staged table."""

    def __init__(self):
        self.columns: list[dict[str, pa.Array]] = []
        self.pairs: list[pa.Table] = []
        self.entries = 0

    def add(self, ids: pa.Array, columns: dict[str, pa.Array], links: pa.Table, width: int) -> None:
        pair = pc.add(pc.multiply(pc.cast(links["a"], pa.int64()), width), pc.cast(links["b"], pa.int64()))
        held = pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        held = held.take(pc.sort_indices(held["doc"]))
        entries = np.bincount(held["doc"].to_numpy(), minlength=len(ids)).astype(np.int64)
        self.columns.append({"id": ids} | columns | {"entries": pa.array(entries)})
        self.pairs.append(held.select(["pair", "count_all"]))
        self.entries += held.num_rows

    def row(self, number: int) -> pa.RecordBatch:
        held = pa.concat_tables(self.pairs).combine_chunks()
        coded = pa.array(held["pair"].combine_chunks()).dictionary_encode()
        # a text has each of its pairs once here, so rows of a pair are documents
        partial = pa.table({"k": coded.indices}).group_by("k", use_threads=False).aggregate([([], "count_all")]).sort_by("k")
        cells = {k: pa.concat_arrays([c[k] for c in self.columns]) for k in DOC_COLUMNS}
        cells |= {"entry": coded.indices, "times": pc.cast(held["count_all"].combine_chunks(), pa.int32()),
                  "pair": coded.dictionary, "docs": pc.cast(partial["count_all"].combine_chunks(), pa.int32())}
        return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64())} | {k: _one(v) for k, v in cells.items()})


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come chunk by chunk as a row of lists for each chunk; a task holds one at a time."""
    held: list[pa.RecordBatch] = []

    def row() -> pa.RecordBatch:
        n, best = (pa.concat_arrays([h[c] for h in held]) for c in ("n", "best"))
        return pa.RecordBatch.from_pydict({"chunk": held[0]["chunk"].slice(0, 1), "n": _one(n), "best": _one(best)})

    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch["chunk"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for start, stop in pairwise(cuts):
            if held and held[0]["chunk"][0].as_py() != chunk[start]:
                yield row()
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield row()


def align_texts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE,
                together: int = TOGETHER, chunk_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """One row for each row: ``doc_id``, ``n_a``, ``n_b`` tokens, ``n_groups`` between common ends,
    ``n_links`` overlapping token pairs, ``n_best`` of them between ids whose count is the highest
    of their left id, ``count_sum`` over the links, ``groups_sha256`` of the groups.

    A text is encoded with a space before it, whole and without special tokens. The count of an id
    pair is the number of rows in which it is linked, over all rows; repeated rows and rows
    that repeat an id count like any other. Null, empty and invalid texts, and texts that either
    tokenizer does not give back byte by byte, have no tokens: zeros and an empty digest. Null ids
    are kept; other columns are not read; an empty table gives no rows. The tokenizer files are
    read by each worker from the given paths.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.when(F.is_valid_utf8(text), F.col(text)).alias("t"))
    width = len(tokenizers_at(byte_bpe, piece_bpe)[1].bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers_at(byte_bpe, piece_bpe)
        chunk, number = _Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch["t"]), 0).to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                done = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + together, side="right")))
                part = batch.slice(start, stop - start)
                chunk.add(part["id"], *aligned(part["t"], a, b), width)
                start = stop
                if chunk.entries >= chunk_entries:
                    yield chunk.row(number)
                    chunk, number = _Chunk(), number + 1
        if chunk.columns:
            yield chunk.row(number)

    chunks = staged(rows.mapInArrow(encode, CHUNK_SCHEMA), 1)  # a chunk is a large row
    partial = chunks.select("chunk", F.posexplode(F.arrays_zip("pair", "docs")).alias("place", "p")).select("chunk", "place", "p.pair", "p.docs")
    counts = staged(partial.groupBy("pair").agg(F.sum("docs").alias("n")))
    left = F.floor(F.col("pair") / F.lit(width))
    top = counts.groupBy(left.alias("left")).agg(F.max("n").alias("top"))
    ranked = counts.withColumn("left", left).join(top, "left").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    answers = partial.join(ranked, "pair").select("chunk", "place", "n", "best").repartition("chunk").sortWithinPartitions("chunk", "place")
    told = chunks.drop("pair", "docs").join(answers.mapInArrow(_gathered, "chunk bigint, n array<bigint>, best array<boolean>"), "chunk", "left")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = {name: batch[name].slice(k, 1).flatten() for name in batch.schema.names if name != "chunk"}
                owner = np.repeat(np.arange(len(cell["id"])), cell["entries"].to_numpy())
                sums = {"n_best": np.zeros(len(cell["id"]), np.int64), "count_sum": np.zeros(len(cell["id"]), np.int64)}
                if len(owner):
                    times = pc.cast(cell["times"], pa.int64())
                    best = pc.multiply(times, pc.cast(pc.take(cell["best"], cell["entry"]), pa.int64()))
                    total = pc.multiply(times, pc.take(cell["n"], cell["entry"]))
                    got = pa.table({"doc": owner, "best": best, "total": total}).group_by("doc", use_threads=False).aggregate([("best", "sum"), ("total", "sum")])
                    at = got["doc"].to_numpy()
                    sums["n_best"][at], sums["count_sum"][at] = got["best_sum"].to_numpy(), got["total_sum"].to_numpy()
                yield pa.RecordBatch.from_pydict({k: cell[k] for k in DOC_COLUMNS if k != "entries"} | {k: pa.array(v) for k, v in sums.items()})

    done = told.mapInArrow(add_up, "id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

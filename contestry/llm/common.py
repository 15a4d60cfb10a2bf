"""Shared pieces of the training-data operators: staged tables, packed rows, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = 0xFFFFFFFFFFFFFFFF


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame, together: int | None = None) -> DataFrame:
    """The frame written once to the shared folder and read back: lineage ends there, lost
    executors cost no recomputation, and its size is known to the planner. The folder goes
    when the session's file system closes. ``together`` rows at most make a row group: a task
    holds those of one, and Parquet looks at a group's size every hundred rows only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if together is not None:
        writer = writer.option("parquet.block.row.count.limit", together)
    writer.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """Whether the row belongs to the fold that no model may learn from (null ids: to it)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def hashed_unit(*parts: Column, seed: int = 0) -> Column:
    """A uniform number in (0, 1) from the digest of the parts; the same in every run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


@cache
def word_table() -> np.ndarray:
    """Per code point: is it part of a word (letter, digit or underscore)."""
    table_ = np.zeros(0x110000, dtype=bool)
    table_[[i for i in range(0x110000) if chr(i).isalnum() or i == 95]] = True
    return table_


@cache
def letter_table() -> np.ndarray:
    """Per code point: the lower-case letter, or 0 for anything that is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (wrapping arithmetic)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_POWERS = [np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> np.ndarray:
    """1, B, B², … for hashing a word by its characters; grown when a longer word comes."""
    if len(_POWERS[0]) < n:
        steps = np.full(max(n, 2 * len(_POWERS[0])), 0x9E3779B97F4A7C15, dtype=np.uint64)
        steps[0] = 1
        _POWERS[0] = np.multiply.accumulate(steps)
    return _POWERS[0]


def _hashed_words(low: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a lower-case text and where the word starts."""
    cp = code_points(low)
    inside = word_table()[cp]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    lengths = ends - starts
    chars = cp[inside].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths  # where each word starts among the word characters
    at = np.arange(len(chars)) - np.repeat(first, lengths)
    value = chars * _powers(int(lengths.max()) + 1)[at]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of the text, in order; words are runs of letters, digits
    and underscores in lower case. Null and wordless texts give an empty array."""
    return _hashed_words((text or "").lower())[0]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The distinct hashes of all runs of ``width`` words, sorted; a shorter text counts as
    one run of what it has, an empty one as none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return np.unique(h)


#: Characters of text hashed at once when texts are taken together.
TOGETHER = 1 << 21


def word_hash_lists(texts: list[str | None]) -> list[np.ndarray]:
    """:func:`word_hashes` of each text, with short texts hashed together."""
    out: list[np.ndarray] = []
    held: list[str] = []
    chars = 0

    def flush() -> None:
        nonlocal chars
        joined = "\n".join(held)
        ends = np.cumsum([len(t) + 1 for t in held])
        h, starts = _hashed_words(joined)
        out.extend(np.split(h, np.searchsorted(starts, ends[:-1])))
        held.clear()
        chars = 0

    for text in texts:
        low = (text or "").lower()
        held.append(low)
        chars += len(low)
        if chars > TOGETHER:
            flush()
    if held:
        flush()
    return out

"""Replicated random numbers from a key and a counter, the same in numpy and in SQL.

A key is hashed once (md5, cut into 32-bit lanes); a replicate then costs a few shifts and
multiplications on its number and the lane. Every product stays below 2**63, so plain 64-bit
integers give the same numbers as wrapping 32-bit ones.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from contestry.functions.columns import digest

STEP, FIRST, SECOND = 0x1B56C4E9, 0x21F0AAAD, 0x735A2D97
WORD = 0xFFFFFFFF


def mix32(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit words; one to one."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(FIRST)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(SECOND)
    return x ^ (x >> np.uint32(15))


@lru_cache(maxsize=8)
def counted(n: int) -> np.ndarray:
    """The mixed numbers of n replicates; a key's lanes are laid over them."""
    return mix32(np.arange(n, dtype=np.uint32) * np.uint32(STEP))


def words(lane: int, numbers: np.ndarray) -> np.ndarray:
    return mix32(numbers ^ np.uint32(lane))


def uniforms(high: int, low: int, numbers: np.ndarray) -> np.ndarray:
    """52-bit numbers in [0, 1), one for each replicate, from two lanes of a key."""
    top = words(high, numbers).astype(np.float64) * 1048576.0
    return (top + (words(low, numbers) >> np.uint32(12)).astype(np.float64)) / 4503599627370496.0


def lanes_of(text: str) -> tuple[int, int]:
    h = hashlib.md5(text.encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16)


def lanes(name: str, *parts) -> dict[str, Column]:
    """Two columns ``<name>_high`` and ``<name>_low`` for the key that the parts spell."""
    h = digest(*parts)
    word = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return {f"{name}_high": word(1), f"{name}_low": word(9)}


# --- the same in SQL --------------------------------------------------------------------------


def mixed_sql(name: str, start: str) -> str:
    """Columns ``<name>0`` to ``<name>5``, each made of the one before; the last is mixed."""
    return (f"{start} as {name}0, xor({name}0, {name}0 >> 16) as {name}1, ({name}1 * {FIRST}) & {WORD} as {name}2, xor({name}2, {name}2 >> 15) as {name}3, "
            f"({name}3 * {SECOND}) & {WORD} as {name}4, xor({name}4, {name}4 >> 15) as {name}5")


def counted_sql(n: int) -> str:
    """``rep`` and its mixed number ``num`` for n replicates."""
    return f"(select rep, m5 as num from (select rep, {mixed_sql('m', f'((rep * {STEP}) & {WORD})')} from (select unnest(generate_series(0, {n - 1}))::bigint as rep)))"


def lanes_sql(name: str, key: str) -> str:
    word = lambda at: f"cast('0x' || substr(md5({key}), {at}, 8) as bigint)"
    return f"{word(1)} as {name}_high, {word(9)} as {name}_low"


def uniform_sql(name: str, number: str = "num") -> str:
    """A column ``<name>`` from ``<name>_high``, ``<name>_low`` and a mixed number."""
    return (f"{mixed_sql(f'{name}_h', f'xor({name}_high, {number})')}, {mixed_sql(f'{name}_l', f'xor({name}_low, {number})')}, "
            f"({name}_h5 * 1048576 + ({name}_l5 >> 12)) / 4503599627370496e0 as {name}")


def mixed_list_sql(numbers: str) -> str:
    """A list of words, each mixed."""
    steps = ["x -> xor(x, x >> 16)", f"x -> (x * {FIRST}) & {WORD}", "x -> xor(x, x >> 15)", f"x -> (x * {SECOND}) & {WORD}", "x -> xor(x, x >> 15)"]
    for step in steps:
        head, body = step.split(" -> ")
        numbers = f"list_transform({numbers}, lambda {head}: {body})"
    return numbers

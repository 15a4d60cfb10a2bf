"""Small column builders shared by every operator. All stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry import constants as C


def flag(col: str | Column) -> Column:
    """A 0/1 flag as a boolean; null counts as not set."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c == 1, F.lit(False))


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def sum_where(value: str | Column, cond: Column) -> Column:
    """Sum over matching rows, 0 when there are none."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))


def mean_where(value: str | Column, cond: Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.avg(F.when(cond, v))


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that yields null, never an error, on a zero denominator."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.try_divide(n.cast("double"), d.cast("double"))


def floor_bin(col: str | Column, width: float) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (F.floor(c / F.lit(float(width))) * int(width)).cast("int")


def remap(col: str, mapping: dict[str, str]) -> Column:
    """Replace listed codes; everything else, null included, is unchanged."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(col)), F.col(col))


def modern_code(col: str) -> Column:
    return remap(col, C.RELOCATIONS)


def era_code(col: str, season: str = "season") -> Column:
    """The code a club carried that season; an unknown season leaves it alone."""
    out = F.col(col)
    for modern, last, old in C.ERA_CODES:
        out = F.when((F.col(col) == modern) & (F.col(season) <= last), old).otherwise(out)
    return out


def keyed(*parts: str | Column, sep: str = "_") -> Column:
    """A composite text key that is null when any part is null."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    joined = F.concat_ws(sep, *[c.cast("string") for c in cols])
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), joined)


def labelled(bins, value: str, inclusive_high: bool = True) -> Column:
    """A label from ordered (low, high, label) bins; null outside them."""
    out = None
    for low, high, label in bins:
        hit = F.col(value).between(low, high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def in_sets(sets, value: str) -> Column:
    out = None
    for members, label in sets:
        hit = F.col(value).isin(*members)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def guarded(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """The frame, whose rows raise where ``bad`` holds. The check is a filter: selecting few
    columns later cannot prune it, as it can a check that hangs on one column."""
    return df.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def normal_cdf(x: Column) -> Column:
    """Normal distribution function through a rational error function (|err| < 1.5e-7)."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(C.ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(C.ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(x) * erf)


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def seed_hex(seed: int, key: str | Column) -> Column:
    """A seed as 16 hex digits: the head of sha-256 over ``seed:key``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), k), 256), 1, 16)


def digest(*parts) -> Column:
    """md5 over the parts joined by ``:``; the portable source of every random pick."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(hex_col: Column) -> Column:
    """The first 13 hex digits, 52 bits, as a number in [0, 1): exact in a double."""
    return F.conv(F.substring(hex_col, 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def pick(hex_col: Column, size: Column) -> Column:
    """An index in [0, size) from a digest."""
    return F.least(F.floor(uniform(hex_col) * size.cast("double")), size.cast("long") - 1)


def ln_gamma(x: Column) -> Column:
    """Log gamma for x > 0: Stirling's series eight steps up, stepped back down (|err| < 1e-11)."""
    y = x + 8.0
    steps = x
    for i in range(1, 8):
        steps = steps * (x + float(i))
    tail = F.lit(1.0) / (F.lit(12.0) * y) - F.lit(1.0) / (F.lit(360.0) * y * y * y) + F.lit(1.0) / (F.lit(1260.0) * y * y * y * y * y)
    return (y - 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + tail - F.ln(steps)

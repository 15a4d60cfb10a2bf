"""Personal data: strict patterns, wider candidate generators, and boosted trees between them.

Everything that touches rows is a column expression. The trees are fitted on counts: candidates
are grouped by their (small, categorical) feature vector on the cluster, and only the table of
vectors, bounded by the product of the feature ranges, reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The strict patterns of the contract. Runs are possessive and guarded by what
# stands before them, which finds the same leftmost matches in time linear in the text.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Wider generators: spelled-out addresses, dotted numbers of any length, digit groups of any
# kind, numbers without a plus.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?+(?:@|\(at\)|\[at\]) ?+[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,}+",
    "phone": r"(?<![0-9+])\+?[(]?[0-9][ ().0-9-]{6,}[0-9]",
}
#: What must be in a text for a kind's patterns to be tried at all.
HINT = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ .-]?[0-9]", "phone": r"[0-9]"}
#: Words before a candidate that speak for its kind.
CUES = {"email": r"(?i)mail|contact|write to", "ip": r"(?i)\bip\b|host|address|server", "card": r"(?i)card|visa|account|credit", "phone": r"(?i)tel|phone|call|mobile|fax"}
#: Feature names and how many values each takes.
FEATURES = {"kind": 4, "digits": 6, "length": 5, "separators": 4, "before": 3, "after": 3, "cue": 2, "plus": 2}
SPAN = "array<struct<start:int,end:int,text:string>>"


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches with their places, in code points, end exclusive. The pieces between the
    matches give the places: both come from the same leftmost search."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("text")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = (acc["at"] + x["gap"]).cast("int")
        last = (first + F.length(x["text"])).cast("int")
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), last.alias("end"), x["text"].alias("text")))).alias("out"))

    placed = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(HINT[kind]), placed).otherwise(F.array().cast(SPAN))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def strict_spans(text: Column, kind: str) -> Column:
    """The contract's spans of one kind: leftmost, non-overlapping, failing matches dropped."""
    return F.filter(_matches(text, kind, STRICT[kind]), lambda x: _valid(kind, x["text"]))


def _char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}0-9]"), 1).otherwise(2)


def candidates(text: Column, kind: str) -> Column:
    """The wide generator's spans of one kind, each with its features; none says whether the
    span passes the strict check."""
    code = KINDS.index(kind)

    def described(x: Column) -> Column:
        match, first = x["text"], x["start"]
        digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
        seps = F.length(F.regexp_replace(match, r"[^ ().@\[\]-]", ""))
        before = F.substring(text, F.greatest(first - 23, F.lit(1)), F.least(first, F.lit(24)))
        after = F.substring(text, x["end"] + 1, F.lit(1))
        bucket = lambda v, cuts: sum(((v >= c).cast("int") for c in cuts), F.lit(0))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(code).alias("kind"), bucket(digits, (1, 9, 13, 16, 20)).alias("digits"),
            bucket(F.length(match), (10, 16, 20, 32)).alias("length"), bucket(seps, (1, 3, 4)).alias("separators"),
            _char_class(F.substring(before, -1, 1)).alias("before"), _char_class(after).alias("after"),
            before.rlike(CUES[kind]).cast("int").alias("cue"), match.startswith("+").cast("int").alias("plus"),
        )

    return F.transform(_matches(text, kind, WIDE[kind]), described)


def _with_spans(docs: DataFrame, text: str) -> DataFrame:
    """``row``, the text, one array of strict spans per kind, and all candidates."""
    base = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = base.select("row", "t", *[strict_spans(F.col("t"), k).alias(k) for k in KINDS])
    return base.withColumn("wide", F.concat(*[candidates(F.col("t"), k) for k in KINDS]))


def _is_strict(c: Column) -> Column:
    """Whether the candidate is exactly a strict span of its kind."""
    same = lambda k: F.exists(F.col(k), lambda b: (b["start"] == c["start"]) & (b["end"] == c["end"]))
    return F.when(c["kind"] == 0, same("email")).when(c["kind"] == 1, same("ip")).when(c["kind"] == 2, same("card")).otherwise(same("phone"))


@dataclass(frozen=True)
class Trees:
    """Two-level trees ``(feature, cut, feature, cut, feature, cut, four leaves)``, the first
    split on the left branch and the second on the right; ``least`` is the calibrated score."""

    base: float
    trees: tuple[tuple, ...]
    least: float

    def score(self, feature) -> Column:
        def one(tree: tuple) -> Column:
            f, c, lf, lc, rf, rc, a, b, d, e = tree
            left = F.when(feature(lf) <= lc, F.lit(a)).otherwise(F.lit(b))
            right = F.when(feature(rf) <= rc, F.lit(d)).otherwise(F.lit(e))
            return F.when(feature(f) <= c, left).otherwise(right)

        return sum((one(t) for t in self.trees), F.lit(self.base))


def _boost(x: np.ndarray, n: np.ndarray, pos: np.ndarray, rounds: int, rate: float) -> tuple[float, list[tuple]]:
    """Newton boosting of two-level trees on grouped rows: ``n`` rows and ``pos`` positives each."""
    names = list(FEATURES)
    base = log((pos.sum() + 1) / (n.sum() - pos.sum() + 1))
    f = np.full(len(n), base)
    trees = []

    def split(mask: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        best = (-1.0, 0, 99)
        for j, name in enumerate(names):
            for cut in range(FEATURES[name] - 1):
                left = mask & (x[:, j] <= cut)
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[mask].sum() - g[left].sum(), h[mask].sum() - h[left].sum()
                gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, j, cut)
        return best

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = pos - n * p, n * p * (1 - p)
        everything = np.ones(len(n), dtype=bool)
        _, j, cut = split(everything, g, h)
        low = x[:, j] <= cut
        tree: list = [names[j], cut]
        leaves = []
        for side in (low, ~low):
            _, k, c = split(side, g, h)
            tree += [names[k], c]
            for leaf in (side & (x[:, k] <= c), side & (x[:, k] > c)):
                v = float(rate * g[leaf].sum() / (h[leaf].sum() + 1))
                leaves.append(v)
                f[leaf] += v
        trees.append((*tree, *leaves))
    return base, trees


def fit_trees(docs: DataFrame, *, text: str = "text", rounds: int = 24, rate: float = 0.3, precision: float = 0.9) -> Trees:
    """Learn, from format and context alone, which candidates look like strict spans.

    All candidates of all rows count: four fifths of them, by a digest of place and text, teach
    the trees; the rest calibrate the least score at which the share of strict spans among the
    selected is ``precision``, going no further down than a score of which most are strict. If no score reaches it, nothing beyond the strict spans is selected.
    """
    spans = _with_spans(docs.select(F.col(text).alias("text")), "text")
    marked = F.transform("wide", lambda c: F.struct(*[c[f].alias(f) for f in FEATURES], _is_strict(c).alias("strict"), c["start"].alias("at")))
    rows = spans.select(F.xxhash64("t").alias("h"), F.explode(marked).alias("c")).select("h", "c.*")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("h", "at"), F.lit(5)))
    counted = rows.groupBy((F.col("fold") == 0).alias("calibrate"), *FEATURES).agg(F.count("*").alias("n"), F.sum(F.col("strict").cast("int")).alias("pos")).collect()
    learn = [r for r in counted if not r["calibrate"]]
    if not learn:
        return Trees(0.0, (), float("inf"))
    x = np.array([[r[f] for f in FEATURES] for r in learn])
    base, trees = _boost(x, np.array([r["n"] for r in learn], float), np.array([r["pos"] for r in learn], float), rounds, rate)

    def value(r) -> float:
        out = base
        for f, c, lf, lc, rf, rc, a, b, d, e in trees:
            out += (a if r[lf] <= lc else b) if r[f] <= c else (d if r[rf] <= rc else e)
        return out

    levels: dict[float, list[int]] = {}
    for r in counted:
        if r["calibrate"]:
            level = levels.setdefault(round(value(r), 9), [0, 0])
            level[0] += r["n"]
            level[1] += r["pos"]
    n = pos = 0
    least = float("inf")
    for score, (rows_here, pos_here) in sorted(levels.items(), reverse=True):
        n, pos = n + rows_here, pos + pos_here
        if (pos_here + 1) / (rows_here + 2) < 0.5:
            break
        if pos / n >= precision:
            least = score
    return Trees(base, tuple(trees), least - 1e-9)


def with_personal_spans(docs: DataFrame, trees: Trees, *, text: str = "text") -> DataFrame:
    """``row``, the text, one array of strict spans per kind, and ``added``: candidates of at
    least the calibrated score that touch no strict span and no better candidate (higher score,
    then earlier, then longer)."""
    spans = _with_spans(docs, text)
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    scored = F.transform("wide", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), trees.score(lambda f: c[f]).alias("score")))
    high = F.filter(scored, lambda c: c["score"] >= trees.least)
    free = F.filter(high, lambda c: ~F.exists("all", lambda b: touches(b, c)))
    pair = lambda k: F.transform(k, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    spans = spans.withColumn("all", F.concat(*[pair(k) for k in KINDS])).withColumn("free", free)
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & ((a["end"] > b["end"]) | ((a["end"] == b["end"]) & (a["kind"] < b["kind"]))))))
    best = F.filter("free", lambda c: ~F.exists("free", lambda d: touches(d, c) & better(d, c)))
    return spans.select("row", "t", *KINDS, best.alias("added"))


def _of_kind(kind: str):
    return lambda c: c["kind"] == KINDS.index(kind)


def _marked(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _written(items: Column, kind: str) -> Column:
    return F.transform(items, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def span_report(docs: DataFrame, trees: Trees, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of the strict spans and the list of all spans, one row for each row.

    A null text counts as empty: no spans, the digest of the empty string. Rows are independent
    of each other, so repeated ids and rows each report what they hold.
    """
    spans = with_personal_spans(docs, trees, text=text)
    base = F.concat(*[_written(F.col(k), k) for k in KINDS])
    both = []
    place = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    for k in KINDS:
        more = F.filter("added", _of_kind(k))
        both.append(_written(F.array_sort(F.concat(F.transform(k, place), F.transform(more, place))), k))
    return spans.select(
        F.col("row").getField(id_col).alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(*both), ",").alias("spans"),
    )


def redacted(docs: DataFrame, trees: Trees, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets (spans that overlap
    become one mark, of the kind that begins first); null texts stay null. ``n_chars``, where
    it is a column, is counted anew for changed rows; other columns and rows stay as they are."""
    spans = with_personal_spans(docs, trees, text=text)
    every = F.array_sort(F.concat(*[F.transform(k, _marked(k)) for k in KINDS], *[F.transform(F.filter("added", _of_kind(k)), _marked(k)) for k in KINDS]))
    t = F.col("t")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(t, acc["at"] + 1, x["start"] - acc["at"])
        add = F.concat(acc["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], x["end"]).cast("int").alias("at"), F.when(x["start"] >= acc["at"], add).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("every", start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    done = spans.withColumn("every", every).withColumn("clean", F.when(F.size("every") > 0, clean))
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == text:
            columns.append(F.coalesce("clean", old).alias(c))
        elif c == n_chars:
            columns.append(F.when(F.col("clean").isNull(), old).otherwise(F.length("clean")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(old.alias(c))
    return done.select(*columns)

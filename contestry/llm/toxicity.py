"""Toxicity by a weighted finite-state pattern grammar.

Words and word stems that mark toxic texts are learned as the insult class of an alphabet whose
other classes (threat, target, negation, report) are short closed lists. Three transducers, for
reported speech, negation and target, are composed into one machine, which reads a clause's
classes and says how much each insult or threat in it weighs. Clause scores, not words, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import _powers, code_points, hashed_unit, mix, staged, word_table

#: Stem lengths that may stand for a family of inflected words.
STEMS = (4, 5, 6, 7, 8)
# Closed classes, in the languages of the corpus.
THREAT = "kill hurt destroy burn beat attack töten schlagen tuer frapper detruire matar golpear quemar"
TARGET = "you your yours youre u they them he she him du dich dir euch sie tu te toi vous tú ti usted ustedes vosotros"
NEGATION = "not no never nobody isnt arent dont nicht kein keine keinen nie niemals pas jamais aucun ningún nunca tampoco"
REPORT = "said says say wrote writes quoted called claimed reported sagt sagte schrieb dit disait écrit dijo dice escribió"
CLAUSE_ENDS = ".!?;:\n\r"
#: What the composed machine's outputs weigh; an insult's own learned weight is multiplied in.
WEIGHTS = {"insult": 1.0, "aimed insult": 1.3, "muted insult": 0.6, "threat": 0.3, "aimed threat": 0.8, "muted threat": 0.1}


@dataclass(frozen=True)
class Transducer:
    """Letter-to-letter: ``arcs[state, symbol] = (state, output)``; a missing arc copies the
    symbol and keeps the state. ``start`` is also the state after a clause ends."""

    start: object
    arcs: dict

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, alphabet: tuple[str, ...]) -> Transducer:
    """The machine that feeds the first's output to the second, over the states it can reach."""
    start = (first.start, second.start)
    arcs: dict = {}
    todo, seen = [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in alphabet:
            x, middle = first.step(a, symbol)
            y, out = second.step(b, middle)
            arcs[state, symbol] = ((x, y), out)
            if (x, y) not in seen:
                seen.add((x, y))
                todo.append((x, y))
    return Transducer(start, arcs)


SYMBOLS = ("word", "insult", "threat", "target", "negation", "report")


@cache
def grammar() -> Transducer:
    mute = {"insult": "muted insult", "threat": "muted threat"}
    reported = Transducer("plain", {("plain", "report"): ("told", "word"), **{("told", s): ("told", m) for s, m in mute.items()}})
    arcs: dict = {}
    for left in range(4):  # words that a negation still reaches
        for s in (*SYMBOLS, *mute.values()):
            arcs[left, s] = (3, "word") if s == "negation" else (max(0, left - 1), mute.get(s, s) if left else s)
    negated = Transducer(0, arcs)
    aimed = Transducer("open", {("open", "target"): ("aimed", "word"), ("aimed", "insult"): ("aimed", "aimed insult"), ("aimed", "threat"): ("aimed", "aimed threat")})
    return compose(compose(reported, negated, SYMBOLS), aimed, SYMBOLS)


@dataclass(frozen=True)
class Tokens:
    """A text's words: full hashes, stem hashes by length (0 where a word is no longer), and
    the clause that each stands in."""

    words: np.ndarray
    stems: dict[int, np.ndarray]
    clause: np.ndarray


def tokens(text: str | None, lengths: tuple[int, ...] = STEMS) -> Tokens:
    cp = code_points((text or "").lower())
    inside = word_table()[cp] if len(cp) else np.zeros(0, dtype=bool)
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, size = edge[::2], edge[1::2] - edge[::2]
    none = np.zeros(0, dtype=np.uint64)
    if not len(starts):
        return Tokens(none, dict.fromkeys(lengths, none), starts)
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    value = (cp[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 1)[at]
    upto = np.concatenate(([np.uint64(0)], np.cumsum(value)))
    hashed = lambda n: mix(upto[first + n] - upto[first] + np.asarray(n).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    stems = {}
    for n in lengths:
        # a stem is told from the word of the same letters by one more bit of its hash
        stems[n] = np.where(size > n, hashed(np.minimum(size, n)) ^ np.uint64(1), np.uint64(0))
    ends = np.isin(cp, np.array([ord(c) for c in CLAUSE_ENDS], dtype=np.uint32))
    return Tokens(hashed(size), stems, np.cumsum(ends)[starts])


@dataclass(frozen=True)
class ToxicityModel:
    units: np.ndarray  # sorted hashes of insults and insult stems
    weights: np.ndarray
    coefficients: tuple[float, float, float]  # intercept, best clause, all clauses


@cache
def _closed() -> tuple[np.ndarray, np.ndarray]:
    found = {}
    for code, listed in ((2, THREAT), (3, TARGET), (4, NEGATION), (5, REPORT)):
        for h in tokens(listed).words.tolist():
            found.setdefault(h, code)
    keys = np.array(sorted(found), dtype=np.uint64)
    return keys, np.array([found[int(k)] for k in keys])


def _looked_up(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), dtype=values.dtype)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0)


def clause_scores(model: ToxicityModel, text: str | None) -> list[float]:
    """The scores of the clauses in which the grammar matches an insult or a threat."""
    tk = tokens(text)
    if not len(tk.words):
        return []
    weight = _looked_up(model.units, model.weights, tk.words)
    for h in tk.stems.values():
        weight = np.maximum(weight, _looked_up(model.units, model.weights, h))
    codes = np.where(weight > 0, 1, _looked_up(*_closed(), tk.words))
    machine = grammar()
    out = []
    for c in np.unique(tk.clause[(codes == 1) | (codes == 2)]).tolist():
        lo, hi = np.searchsorted(tk.clause, (c, c + 1))
        state, score = machine.start, 0.0
        for code, w in zip(codes[lo:hi].tolist(), weight[lo:hi].tolist(), strict=True):
            state, said = machine.step(state, SYMBOLS[code])
            score += WEIGHTS.get(said, 0.0) * (w if code == 1 else 1.0)
        out.append(score)
    return out


def _features(model: ToxicityModel, text: str | None) -> tuple[float, float]:
    s = clause_scores(model, text)
    return (max(s), float(np.log1p(sum(s)))) if s else (0.0, 0.0)


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, label: str, sample: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """About ``sample`` toxic documents and four times as many clean ones, each text once, and how
    many rows each label has."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, sample / max(1, n.get(1, 0))).otherwise(4 * sample / max(1, n.get(0, 0)))
    chosen = rows.filter(hashed_unit(F.col(id_col), seed=seed) < share).select(F.col(id_col).alias("chosen"), "y")
    # about five times the sample of two narrow columns, whatever the tables' sizes
    sampled = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("chosen")).select("y", F.coalesce("text", F.lit("")).alias("t"))
    return staged(sampled.dropDuplicates(["y", "t"])), n


def _evidence(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The log-likelihood ratio that ``a`` of n1 and ``b`` of n0 texts have different shares."""
    both = (a + b) / (n1 + n0)
    part = lambda k, n: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / n / np.maximum(both, 1e-12)), 0.0)
    rest = lambda k, n: np.where(k < n, (n - k) * np.log(np.maximum(n - k, 1e-9) / n / np.maximum(1 - both, 1e-12)), 0.0)
    return 2 * (part(a, n1) + part(b, n0) + rest(a, n1) + rest(b, n0))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 2000, least_z: float = 2.5, least_evidence: float = 10.8, seed: int = 5) -> ToxicityModel:
    """Learn insult words and stems, then the weights of clause scores, from at most about
    ``sample`` toxic rows and four times as many clean ones, chosen by a digest of the id.

    A unit is an insult if its share of toxic texts exceeds its share of clean ones by
    ``least_z`` standard errors of the log odds and by a factor of five at least, and if the
    evidence for it (a log-likelihood ratio) reaches ``least_evidence`` on those toxic texts
    alone that no stronger insult explains. Repeated labels of an
    id count once (toxic if any is); null labels and ids teach nothing. With one label only, or
    none, nothing is learned and every text gets that label's share, or one half.
    """
    rows, n = _sampled(docs.select(id_col, F.col(text).alias("text")), labels, id_col, label, sample, seed)
    share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
    prior = float(np.log(share / (1 - share)))
    empty = ToxicityModel(np.zeros(0, dtype=np.uint64), np.zeros(0), (prior, 0.0, 0.0))
    if not n.get(0) or not n.get(1):
        return empty
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def units(t: str) -> np.ndarray:
        tk = tokens(t)
        found = np.unique(np.concatenate([tk.words, *tk.stems.values()]))
        return found[found != 0]

    def counted(only: np.ndarray | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                each = [units(t) for t in batch["t"]]
                if only is not None:
                    each = [u[_looked_up(only, np.ones(len(only), dtype=np.int8), u) == 1] for u in each]
                u, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_counts=True)
                yield pd.DataFrame({"u": u.view(np.int64), "c": c.astype(np.int64)})

        return run

    def totals(y: int, only: np.ndarray | None, least: float) -> dict[int, int]:
        df = rows.filter(F.col("y") == y).select("t").mapInPandas(counted(only), "u long, c long")
        # a text has few thousand units, so few units can be in one of a hundred texts
        return {r["u"]: r["c"] for r in df.groupBy("u").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).toLocalIterator()}

    toxic = totals(1, None, max(3, n1 / 100))
    keys = np.sort(np.array(list(toxic), dtype=np.int64).view(np.uint64))
    clean = totals(0, keys, 1) if len(keys) else {}
    names = keys.view(np.int64).tolist()
    a = np.array([toxic[k] for k in names], dtype=float)
    b = np.array([clean.get(k, 0) for k in names], dtype=float)
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    marked = (odds >= least_z * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))) & (odds >= np.log(5))
    keys, odds, b = keys[marked], odds[marked], b[marked]

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"u": [np.searchsorted(keys, np.intersect1d(units(t), keys)).astype(np.int32) for t in batch["t"]]})

    # which marked units each sampled toxic text holds: the sample bounds it
    texts = [np.asarray(r["u"], dtype=int) for r in rows.filter("y = 1").select("t").mapInPandas(held, "u array<int>").collect()] if len(keys) else []
    holds = np.zeros((len(texts), len(keys)), dtype=bool)
    for i, u in enumerate(texts):
        holds[i, u] = True
    chosen = np.zeros(len(keys), dtype=bool)
    for _ in range(len(keys)):
        # a unit must explain toxic texts that no chosen unit explains; words that merely stand
        # beside insults, as in groups of near copies, run out of texts
        fresh = holds[~holds[:, chosen].any(axis=1)].sum(axis=0)
        g = np.where(chosen | (fresh < 3), -np.inf, _evidence(fresh, b, n1, n0))
        best = int(np.argmax(g))
        pure = share * (fresh[best] + 0.5) / (n1 + 1) / max(1e-12, share * (fresh[best] + 0.5) / (n1 + 1) + (1 - share) * (b[best] + 0.5) / (n0 + 1))
        if g[best] < least_evidence:
            break
        if pure < 0.5:
            holds[:, best] = False  # never an insult: most texts that hold it are clean
            continue
        chosen[best] = True
    raw = ToxicityModel(keys[chosen], odds[chosen], (prior, 0.0, 0.0))
    if not chosen.any():
        return raw

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f = [_features(raw, t) for t in batch["t"]]
            yield pd.DataFrame({"y": batch["y"], "f1": [x for x, _ in f], "f2": [x for _, x in f]})

    seen = rows.mapInPandas(measured, "y int, f1 double, f2 double").collect()  # about five times the sample, three numbers each
    x = np.array([[1.0, r["f1"], r["f2"]] for r in seen])
    y = np.array([r["y"] for r in seen], dtype=float)
    # each label weighs what it weighs in the table, not in the sample
    w = np.where(y == 1, share / max(1, n1), (1 - share) / max(1, n0)) * len(y)
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - 0.1 * beta * np.array([0, 1, 1])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(raw.units, raw.weights, tuple(float(v) for v in beta))


def scored(model: ToxicityModel, text: Column) -> Column:
    """The probability of the toxic label for a text column; null and empty texts match no
    clause and get what such texts have in the sample. Other columns play no part."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        a, b, c = model.coefficients
        return pd.Series([float(1 / (1 + np.exp(-np.clip(a + b * f1 + c * f2, -30, 30)))) for f1, f2 in (_features(model, t) for t in texts)], dtype=float)

    return score(text)

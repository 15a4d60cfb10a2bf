"""Placement of value inside a contest: cells, scores, leave-one-out baselines, nulls."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions.columns import keyed, ratio
from contestry.functions.counters import counted, lanes, mix32
from contestry.functions.plays import placement_cell, scrimmage_with_down
from contestry.operators.replicates import per_group_arrays, sorted_quantile
from contestry.session import cut_lineage

UNIT = ["game_id", "posteam"]
CELLS = ("rz", "ld", "other")


def priced_plays(pbp: DataFrame, ledger: DataFrame, games: DataFrame) -> DataFrame:
    """Scrimmage plays with luck taken out of their value, in adjudicated contests only.

    Ledger luck is signed to home, play values to the side with the ball; they meet here.
    """
    per_play = ledger.filter("play_id is not null").groupBy("game_id", "play_id").agg(F.sum("luck_epa").alias("luck_home"))
    # a contest's luck is one row, so that plays meet it, and are grouped later, by contest alone: one shuffle
    luck = per_play.groupBy("game_id").agg(F.map_from_entries(F.collect_list(F.struct("play_id", "luck_home"))).alias("_luck"))
    contests = games.select("game_id").distinct().join(luck, "game_id", "left")
    joined = scrimmage_with_down(pbp).join(contests, "game_id").withColumn("luck_home", F.try_element_at("_luck", F.col("play_id"))).drop("_luck")
    home = F.col("posteam") == F.col("home_team")
    signed = F.coalesce("luck_home", F.lit(0.0))
    return joined.withColumns({
        "luck_pos": F.when(home, signed).otherwise(-signed), "cell": placement_cell(),
        "is_home": home.cast("int"), "team_season": keyed("season", "posteam"),
    }).withColumn("epa_priced", F.col("epa") - F.col("luck_pos"))


def reconciliation(plays: DataFrame) -> DataFrame:
    return plays.agg(
        F.count(F.lit(1)).alias("plays"), F.count_if(F.col("luck_pos") != 0).alias("priced"),
        F.avg(F.abs("luck_pos")).alias("mean_abs"), F.sum("luck_pos").alias("total"))


def cell_table(plays: DataFrame, value: str = "epa_priced") -> DataFrame:
    """Counts and value sums per contest side and cell."""
    in_cell = lambda c: F.col("cell") == c
    return plays.groupBy("game_id", "posteam", "season", "team_season").agg(
        F.max("is_home").alias("is_home"), F.count(F.lit(1)).alias("n_all"), F.sum(value).alias("epa_all"),
        F.count_if(in_cell("red_zone")).alias("n_rz"), F.count_if(in_cell("late_down")).alias("n_ld"),
        F.coalesce(F.sum(F.when(in_cell("red_zone"), F.col(value))), F.lit(0.0)).alias("epa_rz"),
        F.coalesce(F.sum(F.when(in_cell("late_down"), F.col(value))), F.lit(0.0)).alias("epa_ld"),
    ).withColumns({"n_other": F.col("n_all") - F.col("n_rz") - F.col("n_ld"),
                   "epa_other": F.col("epa_all") - F.col("epa_rz") - F.col("epa_ld")})


def placement_scores(table: DataFrame) -> DataFrame:
    """(sum of the cell - n * mean) in points; an empty cell is exactly 0, the three sum to 0."""
    mean = ratio("epa_all", "n_all")
    out = table.withColumns({
        f"score_{c}": (F.col(f"epa_{c}") - F.col(f"n_{c}") * mean) * C.POINTS_PER_EPA for c in CELLS})
    return out.withColumn("score", F.col("score_rz") + F.col("score_ld"))


def with_rest_of_season(table: DataFrame) -> DataFrame:
    """Each row's value per play over the same side's other contests of the season."""
    totals = table.groupBy("team_season").agg(F.sum("epa_all").alias("_e"), F.sum("n_all").alias("_n"))
    return table.join(totals, "team_season").withColumns({
        "epa_rest": F.col("_e") - F.col("epa_all"), "n_rest": F.col("_n") - F.col("n_all"),
    }).withColumn("s0_loo", ratio("epa_rest", "n_rest")).drop("_e", "_n")


def leave_group_out_fit(rows: DataFrame, group: str, fits: dict[str, tuple[Column, Column]], x: str) -> DataFrame:
    """Weighted line per name, fitted without the row's own group: ``{name: (y, weight)}``.

    Five weighted sums per group, the league's from the group table, and a subtraction;
    every fit shares one aggregate and one join.
    """
    # a row per contest side, read by several sums and the join: computed once
    rows = cut_lineage(rows)
    xs = F.col(x)
    parts = {}
    for name, (y, w) in fits.items():
        w = w.cast("double")
        parts |= {f"{name}_w": w, f"{name}_wx": w * xs, f"{name}_wxx": w * xs * xs, f"{name}_wy": w * y, f"{name}_wxy": w * y * xs}
    sums = rows.groupBy(group).agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    total = sums.agg(F.struct(*[F.sum(k).alias(k) for k in parts])).scalar()
    rest = sums.select(group, *[(total[k] - F.col(k)).alias(k) for k in parts])
    lines = {}
    for name in fits:
        w, wx, wxx, wy, wxy = (F.col(f"{name}_{s}") for s in ("w", "wx", "wxx", "wy", "wxy"))
        slope = ratio(w * wxy - wx * wy, w * wxx - wx * wx)
        lines |= {f"_{name}_b": slope, f"_{name}_a": ratio(wy - slope * wx, w)}
    rest = rest.select(group, *[v.alias(k) for k, v in lines.items()])
    joined = rows.join(rest, group)
    return joined.withColumns({n: F.col(f"_{n}_a") + F.col(f"_{n}_b") * xs for n in fits}).drop(*lines)


def cell_mean(c: str) -> Column:
    return F.when(F.col(f"n_{c}") > 0, F.col(f"epa_{c}") / F.col(f"n_{c}")).otherwise(0.0)


def redesigned_scores(table: DataFrame, group: str = "posteam") -> DataFrame:
    """Cells against the profile a side of this quality is expected to show."""
    fits = {f"mu_{c}": (cell_mean(c), F.col(f"n_{c}")) for c in CELLS}
    rows = leave_group_out_fit(table, group, fits, "s0_loo")
    centred = {f"_c_{c}": F.when(F.col(f"n_{c}") > 0, F.col(f"epa_{c}") - F.col(f"n_{c}") * F.col(f"mu_{c}")).otherwise(0.0) for c in CELLS}
    rows = rows.withColumns(centred).withColumn("_base", ratio(F.col("_c_rz") + F.col("_c_ld") + F.col("_c_other"), "n_all"))
    rows = rows.withColumns({f"points_{c}": (F.col(f"_c_{c}") - F.col(f"n_{c}") * F.col("_base")) * C.POINTS_PER_EPA for c in CELLS})
    mix = ratio(sum((F.col(f"n_{c}") * F.col(f"mu_{c}") for c in CELLS[1:]), F.col("n_rz") * F.col("mu_rz")), "n_all")
    inside = F.col("n_rz") * F.col("mu_rz") + F.col("n_ld") * F.col("mu_ld")
    return rows.withColumns({
        "score": F.col("points_rz") + F.col("points_ld"),
        "profile_shift": (inside - (F.col("n_rz") + F.col("n_ld")) * mix) * C.POINTS_PER_EPA,
    }).drop("_base", *centred)


def expected_mix_points(redesigned: DataFrame, group: str = "posteam") -> DataFrame:
    """The reweighted arm: plays count by expected over realised share of their cell."""
    fits = {f"q_{c}": (ratio(f"n_{c}", "n_all"), F.col("n_all")) for c in CELLS}
    rows = leave_group_out_fit(redesigned, group, fits, "s0_loo")
    some = lambda c: F.col(f"n_{c}") > 0
    rows = rows.withColumns({f"_w_{c}": F.when(some(c), F.col("n_all") * F.col(f"q_{c}")).otherwise(0.0) for c in CELLS})
    rows = rows.withColumns({
        f"_k_{c}": F.when(some(c), F.col(f"_w_{c}") * ratio(F.col(f"epa_{c}") - F.col(f"n_{c}") * F.col(f"mu_{c}"), f"n_{c}")).otherwise(0.0)
        for c in CELLS})
    total = lambda p: F.col(f"{p}_rz") + F.col(f"{p}_ld") + F.col(f"{p}_other")
    base = ratio(total("_k"), total("_w"))
    return rows.withColumns({f"mix_{c}": (F.col(f"_k_{c}") - F.col(f"_w_{c}") * base) * C.POINTS_PER_EPA for c in CELLS}).drop(
        *[f"{p}_{c}" for p in ("_w", "_k") for c in CELLS])


def season_table(scores: DataFrame) -> DataFrame:
    """Per side-season: score mean and SD, quality, quality in the franchise's other seasons."""
    per = scores.groupBy("team_season", F.col("posteam").alias("team"), "season").agg(
        F.count(F.lit(1)).alias("games"), F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("sd_score"),
        F.sum("epa_all").alias("epa_sum"), F.sum("n_all").alias("plays"),
        F.avg("score_rz").alias("mean_rz"), F.avg("score_ld").alias("mean_ld"), F.sum("n_rz").alias("n_rz"), F.sum("n_ld").alias("n_ld"))
    whole = per.groupBy("team").agg(F.sum("epa_sum").alias("_e"), F.sum("plays").alias("_n"))
    return per.join(whole, "team").withColumns({
        "s0_quality": ratio("epa_sum", "plays"),
        "s0_other_seasons": ratio(F.col("_e") - F.col("epa_sum"), F.col("_n") - F.col("plays")),
        "mean_sampling_sd": ratio("sd_score", F.sqrt("games")),
    }).drop("_e", "_n")


def differentials(scores: DataFrame, value: str = "score") -> DataFrame:
    home = F.col("is_home") == 1
    both = scores.groupBy("game_id", "season").agg(
        F.max(F.when(home, F.col(value))).alias("home_score"), F.max(F.when(~home, F.col(value))).alias("away_score"))
    return both.withColumn("differential", F.col("home_score") - F.col("away_score")).filter("differential is not null")


def within_season_spread(table: DataFrame, plays: DataFrame, value: str = "epa_priced") -> DataFrame:
    """Observed spread of quality inside seasons less what sampling alone would give."""
    var = plays.agg(F.struct(*[
        F.var_samp(F.when(F.col("cell") == name, F.col(value))).alias(c)
        for c, name in zip(CELLS, ("red_zone", "late_down", "other"), strict=True)])).scalar()
    q = ratio("epa_all", "n_all")
    sampling = ratio(F.col("n_rz") * var["rz"] + F.col("n_ld") * var["ld"] + F.col("n_other") * var["other"],
                     F.col("n_all") * F.col("n_all"))
    means = table.groupBy("team_season").agg(ratio(F.sum("epa_all"), F.sum("n_all")).alias("_m"), F.count(F.lit(1)).alias("_g"))
    rows = table.join(means, "team_season")
    dev = (q - F.col("_m")) * (q - F.col("_m")) * ratio("_g", F.greatest(F.col("_g") - 1, F.lit(1)))
    return rows.agg(
        F.count_distinct("team_season").alias("n_team_seasons"), F.avg(dev).alias("observed_var"), F.avg(sampling).alias("sampling_var")
    ).withColumns({"true_var": F.col("observed_var") - F.col("sampling_var")}).withColumn(
        "true_sd", F.sqrt(F.greatest("true_var", F.lit(0.0))))


def quality_channels(seasons: DataFrame, min_games: int = C.MIN_GAMES) -> DataFrame:
    """Each channel's correlation with quality, and the reliability implied by variance components."""
    s = seasons.filter(F.col("games") >= min_games)
    one = s.agg(
        F.count(F.lit(1)).alias("team_seasons"), F.corr("mean_score", "s0_quality").alias("r_score"),
        F.corr("sd_score", "s0_quality").alias("r_spread"), F.corr("mean_rz", "s0_quality").alias("r_red_zone"),
        F.corr("mean_ld", "s0_quality").alias("r_late_down"),
        F.corr(ratio("n_rz", "plays"), "s0_quality").alias("r_rz_share"), F.corr(ratio("n_ld", "plays"), "s0_quality").alias("r_ld_share"),
        F.stddev_samp("mean_score").alias("between_sd"), F.avg("sd_score").alias("within_sd"), F.avg("games").alias("games"))
    within = F.col("within_sd") * F.col("within_sd")
    signal = F.greatest(F.col("between_sd") * F.col("between_sd") - ratio(within, "games"), F.lit(0.0))
    return one.withColumn("implied_split_half", ratio(signal, signal + ratio(within, F.col("games") / 2.0)))


# --- permutation null ---------------------------------------------------------------------------

RUNGS = ("raw", "down_stratified", "raw_var_matched", "down_stratified_var_matched")
#: Keys (plays times draws) that are ordered at once.
KEYS_TOGETHER = 1 << 17


def _least(top: np.ndarray, low: Callable[[int], np.ndarray], cuts: Sequence[int]) -> list[np.ndarray]:
    """Per draw (row of ``top``), the places of the least keys up to each cut, from cut to cut.

    ``top`` is the upper 32 bits of the keys, and ``low`` gives a draw's lower bits: they are made only for the
    draws in which two keys on both sides of a cut agree in the upper ones. A key is ordered with its
    place behind it in one word, so the words are sorted and no index is.
    """
    n = top.shape[1]
    words = top.astype(np.uint64)
    words <<= np.uint64(32)
    words |= np.arange(n, dtype=np.uint64)
    words.sort(axis=1)
    order = (words[:, : cuts[-1]] & np.uint64(0xFFFFFFFF)).view(np.int64)
    for cut in cuts:
        if 0 < cut < n:
            for draw in np.flatnonzero(words[:, cut - 1] >> np.uint64(32) == words[:, cut] >> np.uint64(32)):
                order[draw] = np.lexsort((low(draw), top[draw]))[: cuts[-1]]
    return [order[:, a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def _null(plays: DataFrame, reps: int, rungs: Sequence[str], seed: int, value: str, rz_scale: float, scales: Sequence[float],
          told: Callable[[np.ndarray, float], dict], columns: str) -> DataFrame:
    """One row per side and rung: what ``told`` makes of the draws and of the side's own score."""
    if unknown := set(rungs) - set(RUNGS):
        raise ValueError(f"unknown rung {sorted(unknown)}")
    event = F.concat_ws("|", "game_id", F.col("play_id").cast("long").cast("string"), F.col("mix").cast("string"))
    place = F.when(F.col("cell") == "red_zone", 1).when(F.col("cell") == "late_down", 2).otherwise(0)
    rows = plays.select(*UNIT, "play_id", "mix", "down", place.alias("place"), F.col(value).cast("double").alias("v"),
                        *[c.alias(k) for k, c in lanes("key", seed, event).items()])
    raw, stratified = {"raw", "raw_var_matched"} & set(rungs), {"down_stratified", "down_stratified_var_matched"} & set(rungs)

    def dealt(unit: dict[str, np.ndarray]) -> Iterator[dict]:
        v, down = unit["v"], unit["down"]
        high, low = (unit[k].astype(np.uint32) for k in ("key_high", "key_low"))
        red, late = unit["place"] == 1, unit["place"] == 2
        n, n_rz, n_ld = len(v), int(red.sum()), int(late.sum())
        k, mean = n_rz + n_ld, float(v.mean())
        share, dev = k / n, v - mean
        own = float((v[red].sum() - n_rz * mean) + (v[late].sum() - n_ld * mean)) * C.POINTS_PER_EPA
        weight = lambda scale: (1.0 - share) * scale + share * scales[2]
        scores: dict[str, list[np.ndarray]] = {rung: [] for rung in rungs}
        step = max(1, KEYS_TOGETHER // n)
        for at in range(0, reps if 0 < k < n else 0, step):
            numbers = counted(reps)[at : at + step]
            top = mix32(numbers[:, None] ^ high)
            if raw == {"raw"}:
                scores["raw"].append(dev[_least(top, lambda draw: mix32(numbers[draw] ^ low) >> np.uint32(12), [k])[0]].sum(axis=1) * C.POINTS_PER_EPA)
            elif raw:
                reds, lates = (dev[x].sum(axis=1) for x in _least(top, lambda draw: mix32(numbers[draw] ^ low) >> np.uint32(12), [n_rz, k]))
                for rung, total in (("raw", reds + lates), ("raw_var_matched", weight(scales[0]) * reds + weight(scales[1]) * lates)):
                    if rung in scores:
                        scores[rung].append(total * C.POINTS_PER_EPA)
            if stratified:
                plain, stretched = np.full(len(top), -k * mean), np.full(len(top), -k * mean)
                for d in np.unique(down):
                    at_down = down == d
                    s_rz, values, tails = int(red[at_down].sum()), v[at_down], low[at_down]
                    if d in C.LATE_DOWNS and stratified == {"down_stratified"}:
                        plain += values.sum()  # both parts of a late down count, however they are dealt
                        continue
                    if s_rz in (0, len(values)):
                        chosen = np.full(len(top), values.sum() if s_rz else 0.0)
                    else:
                        chosen = values[_least(top[:, at_down], lambda draw: mix32(numbers[draw] ^ tails) >> np.uint32(12), [s_rz])[0]].sum(axis=1)
                    rest = values.sum() - chosen if d in C.LATE_DOWNS else 0.0
                    centre = s_rz * values.mean()
                    plain += chosen + rest
                    stretched += centre + rz_scale * (chosen - centre) + rest
                for rung, total in (("down_stratified", plain), ("down_stratified_var_matched", stretched)):
                    if rung in scores:
                        scores[rung].append(total * C.POINTS_PER_EPA)
        for rung, parts in scores.items():
            yield {c: unit[c][0] for c in UNIT} | {"rung": rung} | told(np.concatenate(parts) if parts else np.zeros(reps), own)

    return per_group_arrays(rows, UNIT, ["play_id", "mix"], dealt, f"game_id string, posteam string, rung string, {columns}")


def placement_null(plays: DataFrame, reps: int, rungs: Sequence[str] = ("raw",), seed: int = 0, value: str = "epa_priced",
                   rz_scale: float = 1.0, scales=(1.0, 1.0, 1.0)) -> DataFrame:
    """Placement scores with play values dealt at random inside each contest side: one row per
    side and rung, ``scores`` holding one number a draw.

    A draw gives each play a key from its own name and the draw's number, and the plays with the
    least keys take the places; the stratified rungs deal within each down. Plays are dealt to
    tasks by side, once for all draws and rungs; a side has the plays of one contest.
    """
    return _null(plays, reps, rungs, seed, value, rz_scale, scales, lambda drawn, own: {"scores": drawn.tolist()}, "scores array<double>")


def null_summary(plays: DataFrame, reps: int, rungs: Sequence[str] = ("raw",), seed: int = 0, value: str = "epa_priced",
                 rz_scale: float = 1.0, scales=(1.0, 1.0, 1.0)) -> DataFrame:
    """Per side and rung of ``placement_null``: the draws' number, mean, spread, extremes and 89% band,
    taken where they are drawn."""

    def told(drawn: np.ndarray, own: float) -> dict:
        ordered = np.sort(drawn)
        return {"draws": len(drawn), "mean": float(drawn.mean()), "sd": float(drawn.std(ddof=1)), "least": float(ordered[0]), "most": float(ordered[-1]),
                "low": sorted_quantile(ordered, 0.055), "high": sorted_quantile(ordered, 0.945)}

    return _null(plays, reps, rungs, seed, value, rz_scale, scales, told, "draws long, mean double, sd double, least double, most double, low double, high double")


def null_band(plays: DataFrame, reps: int, seed: int = 0, value: str = "epa_priced") -> DataFrame:
    """Per side: 89% band of its raw draws, its own score, whether that is inside, mid-P percentile. Draws
    within 1e-9 of the side's own score count as equal to it."""

    def told(drawn: np.ndarray, own: float) -> dict:
        ordered = np.sort(drawn)
        less, equal = int((drawn < own - 1e-9).sum()), int((np.abs(drawn - own) <= 1e-9).sum())
        low, high = sorted_quantile(ordered, 0.055), sorted_quantile(ordered, 0.945)
        return {"low": low, "high": high, "realized": own, "pit": (less + 0.5 * equal) / len(drawn), "inside": int(low <= own <= high)}

    return _null(plays, reps, ("raw",), seed, value, 1.0, (1.0, 1.0, 1.0), told, "low double, high double, realized double, pit double, inside int")

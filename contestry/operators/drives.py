"""Drive tables, conditional points, donor-bin resampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions.columns import digest, flag, floor_bin, keyed, ratio
from contestry.functions.counters import counted, lanes, mix32
from contestry.functions.plays import drive_explosive, is_scrimmage
from contestry.operators.ranking import hash_rank
from contestry.operators.replicates import per_group_arrays, sorted_quantile
from contestry.session import cut_lineage

FEATURES = ("start_yardline_100", "depth", "scrimmage_plays", "net_yards", "max_gain",
            "explosive_plays", "first_downs", "penalty_aid_yards")


def drive_table(pbp: DataFrame) -> DataFrame:
    """One row per drive from one scan and one aggregate.

    Depth is the deepest yard line at the snap of a run or pass, so a drive that scored
    from the 3 and one stopped at the 3 look alike. First values follow the play key.
    """
    snap = F.col("posteam").isNotNull() & is_scrimmage() & F.col("yardline_100").isNotNull()
    at = lambda c: F.when(snap, F.col(c))
    first_snap = F.when(snap, F.struct("play_id", "posteam", "yardline_100"))
    aid = F.when(flag("penalty") & (F.col("penalty_team") == F.col("defteam")), F.coalesce("penalty_yards", F.lit(0.0)))
    result = F.when(F.col("fixed_drive_result").isNotNull(), F.struct("play_id", "fixed_drive_result"))
    grouped = pbp.filter(F.col("fixed_drive").isNotNull()).groupBy("game_id", "fixed_drive").agg(
        F.min(first_snap).alias("_f"), F.min(at("yardline_100")).alias("depth"),
        F.count(F.when(snap, 1)).alias("scrimmage_plays"), F.sum(at("yards_gained")).alias("net_yards"),
        F.max(at("yards_gained")).alias("max_gain"),
        F.count_if(F.coalesce(snap & drive_explosive(), F.lit(False))).alias("explosive_plays"),
        F.sum(F.when(snap, F.coalesce("first_down", F.lit(0)))).alias("first_downs"),
        F.max(F.when(snap, (F.col("yardline_100") <= C.RED_ZONE_YARDS).cast("int"))).alias("reached_red_zone"),
        F.coalesce(F.sum(aid), F.lit(0.0)).alias("penalty_aid_yards"),
        F.min(result).alias("_r"),
        F.max(F.coalesce(F.col("extra_point_result") == "good", F.lit(False)).cast("int")).alias("_xp"),
        F.max(F.coalesce(F.col("two_point_conv_result") == "success", F.lit(False)).cast("int")).alias("_two"),
        F.max("home_team").alias("home_team"), F.max("season").alias("season"), F.max("week").alias("week"))
    res = F.col("_r.fixed_drive_result")
    points = F.when(res == "Touchdown", 6 + F.col("_xp") + 2 * F.col("_two")).when(res == "Field goal", 3).otherwise(0)
    return (
        grouped.filter(F.col("scrimmage_plays") > 0)
        .withColumns({"posteam": F.col("_f.posteam"), "start_yardline_100": F.col("_f.yardline_100"), "result": res,
                      "points": points.cast("double")})
        .withColumns({
            "is_home": (F.col("posteam") == F.col("home_team")).cast("int"),
            "depth_bin": floor_bin("depth", C.DEPTH_BIN_WIDTH),
            "resampled": F.coalesce(F.col("result").isin(*C.RESAMPLED_RESULTS), F.lit(False)).cast("int"),
            "team_season": keyed("season", "posteam"),
            **{c: F.col(c).cast("double") for c in FEATURES if c != "start_yardline_100"},
        })
        .drop("_f", "_r", "_xp", "_two")
    )


def conditional_points(drives: DataFrame, minimum: int = C.MIN_BIN_DRIVES) -> DataFrame:
    """Mean points per depth bin; a thin bin borrows the nearest populated one.

    The table has at most one row per depth bin (twenty), so each bin can carry the list
    of populated bins and choose from it.
    """
    bins = drives.filter("resampled = 1").groupBy("depth_bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("points").alias("mean_points"))
    full = bins.agg(F.sort_array(F.collect_list(F.when(F.col("n") >= minimum, F.col("depth_bin"))))).scalar()
    here = F.col("depth_bin")
    nearest = F.array_min(F.transform("_full", lambda b: F.struct(F.abs(b - here).alias("gap"), b.alias("bin"))))
    held = bins.withColumn("_full", full)
    return held.withColumn("donor_bin", F.when(F.col("n") >= minimum, here).otherwise(nearest["bin"])).drop("_full")


def _marked(drives: DataFrame, table: DataFrame) -> DataFrame:
    return drives.filter("resampled = 1").join(table.select("depth_bin", "donor_bin", "mean_points"), "depth_bin")


def expected_delta(drives: DataFrame, table: DataFrame) -> DataFrame:
    sign = F.when(F.col("is_home") == 1, 1.0).otherwise(-1.0)
    return _marked(drives, table).groupBy("game_id").agg(
        F.sum(sign * (F.col("mean_points") - F.col("points"))).alias("expected_delta"))


def resampled_drives(drives: DataFrame) -> DataFrame:
    """What a resample reads of the drives, made once: bins, pools and draws all read it."""
    return cut_lineage(drives.filter("resampled = 1").select("game_id", "fixed_drive", "is_home", "points", "depth", "depth_bin", "resampled"))


def _bars(upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each running total but the last, the least 52-bit number whose place in the pool lies at or above it,
    as its upper 32 and its lower 20 bits. A place is the floor of number / 2**52 * pool size in doubles."""
    size, bars = float(upto[-1]), upto[:-1].astype(np.float64)
    near = np.ceil(bars / size * 4503599627370496.0).astype(np.int64)[:, None] + np.arange(-3, 4)
    near = np.maximum(near, 0)
    least = near[np.arange(len(bars)), ((near / 4503599627370496.0) * size >= bars[:, None]).argmax(axis=1)]
    return (least >> 20).astype(np.uint32), (least & 0xFFFFF).astype(np.uint32)


def _resampled(drives: DataFrame, table: DataFrame, reps: int, seed: int, red_zone_only: bool,
               told: Callable[[np.ndarray, float, float, int], dict], columns: str) -> DataFrame:
    """One row per contest: what ``told`` makes of its deltas, its redrawn points of all replicates, its actual ones and
    its drives.

    A drive's replacement is a place in its donor bin's pool, and the pool is every league
    drive of the bin. Points take a handful of values, so a pool is stored as the value
    counts of its bin with running totals: the draw is a lookup in that small list and no
    pool is ever gathered, however many drives it holds. The lookup is one comparison a value: the
    number's upper 32 bits against those of the least number that reaches it. The lower bits are made
    only where the upper ones are equal.
    """
    league = _marked(drives, table)
    counts = league.groupBy("donor_bin", "points").agg(F.count(F.lit(1)).alias("c"))
    below = W.partitionBy("donor_bin").orderBy("points").rowsBetween(W.unboundedPreceding, 0)
    ladder = counts.withColumn("upto", F.sum("c").over(below)).groupBy("donor_bin").agg(
        F.sort_array(F.collect_list("upto")).alias("upto"), F.sort_array(F.collect_list("points")).alias("steps"))
    rows = league.filter(F.col("depth") <= C.RED_ZONE_YARDS) if red_zone_only else league
    key = lanes("place", seed, F.col("game_id"), F.col("fixed_drive").cast("long"))
    laid = rows.join(ladder, "donor_bin").select("game_id", "fixed_drive", "donor_bin", "is_home", "points", "upto", "steps", *[v.alias(k) for k, v in key.items()])
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def redrawn(contest: dict[str, np.ndarray]) -> Iterator[dict]:
        n, bins = len(contest["points"]), contest["donor_bin"].tolist()
        for at, donor in enumerate(bins):
            if donor not in known:
                known[donor] = (*_bars(contest["upto"][at]), contest["steps"][at])
        signs = np.where(contest["is_home"] == 1, 1.0, -1.0)
        first = np.array([known[b][2][0] for b in bins])
        words = mix32(counted(reps) ^ contest["place_high"].astype(np.uint32)[:, None])
        deltas, drawn = np.full(reps, float((signs * (first - contest["points"])).sum())), float(first.sum()) * reps
        for step in range(max(len(known[b][0]) for b in bins)):
            has = np.array([at for at, b in enumerate(bins) if step < len(known[b][0])])
            high, low = (np.array([known[bins[at]][part][step] for at in has], dtype=np.uint32) for part in (0, 1))
            gaps = np.array([known[bins[at]][2][step + 1] - known[bins[at]][2][step] for at in has])
            of = words[has] if len(has) < n else words
            reached = of > high[:, None]
            for row, rep in zip(*np.nonzero(of == high[:, None]), strict=True):
                tail = mix32(counted(reps)[rep : rep + 1] ^ np.uint32(contest["place_low"][has[row]])) >> np.uint32(12)
                reached[row, rep] = tail[0] >= low[row]
            deltas += (signs[has] * gaps) @ reached
            drawn += float(gaps @ np.count_nonzero(reached, axis=1))
        yield {"game_id": contest["game_id"][0]} | told(deltas, drawn, float(contest["points"].sum()), n)

    return per_group_arrays(laid, ["game_id"], ["fixed_drive"], redrawn, f"game_id string, {columns}")


def resample_points(drives: DataFrame, table: DataFrame, reps: int, seed: int = 0,
                    red_zone_only: bool = False) -> DataFrame:
    """Per contest: redrawn minus actual points, home minus away, as one ``deltas`` array over all
    replicates, with the redrawn points of all replicates, the actual ones and the drives."""
    told = lambda deltas, drawn, observed, n: {"deltas": deltas.tolist(), "drawn": drawn, "observed": observed, "n": n}
    return _resampled(drives, table, reps, seed, red_zone_only, told, "deltas array<double>, drawn double, observed double, n long")


def resample_summary(drives: DataFrame, table: DataFrame, reps: int, seed: int = 0, red_zone_only: bool = False) -> DataFrame:
    """Per contest the replicates' number and the mean, spread and 89% band of its deltas, taken where they are drawn."""

    def told(deltas: np.ndarray, drawn: float, observed: float, n: int) -> dict:
        ordered = np.sort(deltas)
        return {"reps": len(deltas), "mean_delta": float(deltas.mean()), "sd_delta": float(deltas.std(ddof=1)),
                "low": sorted_quantile(ordered, 0.055), "high": sorted_quantile(ordered, 0.945)}

    return _resampled(drives, table, reps, seed, red_zone_only, told, "reps long, mean_delta double, sd_delta double, low double, high double")


def unbiased(drives: DataFrame, table: DataFrame, reps: int, seed: int = 0, tolerance: float = 0.05) -> DataFrame:
    """Redrawn against actual points per drive over all contests and replicates."""
    told = lambda deltas, drawn, observed, n: {"drawn": drawn, "observed": observed, "n": n}
    one = _resampled(drives, table, reps, seed, False, told, "drawn double, observed double, n long").agg(
        ratio(F.sum("observed"), F.sum("n")).alias("observed_mean"), ratio(F.sum("drawn"), F.sum("n") * reps).alias("resampled_mean"))
    gap = F.col("resampled_mean") - F.col("observed_mean")
    return one.withColumns({"difference": gap, "pass": (F.abs(gap) < tolerance).cast("int")})


def fold_by_hash(rows: DataFrame, unit: list[str], folds: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Balanced random folds: rank of a digest over the distinct units, modulo the folds."""
    key = F.concat_ws("|", *[F.col(u).cast("string") for u in unit])
    units = rows.select(*unit).distinct().withColumns({
        "_key": key, "_hex": digest(seed, key), "_all": F.lit(0)})
    total = rows.select(*unit).distinct().agg(F.count(F.lit(1))).scalar()
    ranked = hash_rank(units, ["_all"], "_hex", "_key", total, "_rank")
    table = ranked.withColumn(name, (F.col("_rank") % folds).cast("int")).select(*unit, name)
    return rows.join(table, unit)


def out_of_fold_means(rows: DataFrame, cell: str, value: str, fold: str, minimum: int = C.MIN_BIN_DRIVES) -> DataFrame:
    """Cell mean from the other folds, the overall mean from them where the cell is thin.

    Totals minus the own fold: two small aggregates instead of a fit per fold.
    """
    sums = rows.groupBy(cell, fold).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    cells = sums.groupBy(cell).agg(F.sum("s").alias("cs"), F.sum("c").alias("cc"))
    folds = sums.groupBy(fold).agg(F.sum("s").alias("fs"), F.sum("c").alias("fc"))
    total = sums.agg(F.struct(F.sum("s").alias("s"), F.sum("c").alias("c"))).scalar()
    table = sums.join(cells, cell).join(folds, fold)
    rest_c, rest_s = F.col("cc") - F.col("c"), F.col("cs") - F.col("s")
    overall = ratio(total["s"] - F.col("fs"), total["c"] - F.col("fc"))
    table = table.select(cell, fold, F.when(rest_c >= minimum, ratio(rest_s, rest_c)).otherwise(overall).alias("predicted"))
    return rows.join(table, [cell, fold])


def spread_retention(rows: DataFrame, predicted: str = "predicted") -> DataFrame:
    """Between-team spread per drive: observed, modelled, their ratio, and the residual's correlation."""
    per = rows.groupBy("team_season").agg(F.avg("points").alias("o"), F.avg(predicted).alias("m"))
    return per.agg(
        F.stddev_samp("o").alias("sd_observed"), F.stddev_samp("m").alias("sd_modelled"),
        ratio(F.stddev_samp("m"), F.stddev_samp("o")).alias("retention"),
        F.corr("o", F.col("o") - F.col("m")).alias("quality_residual_r"))


def retention_per_game(rows: DataFrame, predicted: str = "predicted") -> DataFrame:
    per_game = rows.groupBy("team_season", "game_id").agg(F.sum("points").alias("p"), F.sum(predicted).alias("m"))
    per = per_game.groupBy("team_season").agg(
        ratio(F.sum("p"), F.count(F.lit(1))).alias("o"), ratio(F.sum("m"), F.count(F.lit(1))).alias("a"))
    return per.agg(F.stddev_samp("o").alias("sd_observed"), F.stddev_samp("a").alias("sd_adjusted"),
                   ratio(F.stddev_samp("a"), F.stddev_samp("o")).alias("retention"))

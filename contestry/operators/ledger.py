"""The luck ledger: class tables, swing tables, ledger rows, editions and drive caps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions import plays as P
from contestry.functions.columns import floor_bin, in_sets, labelled, normal_cdf, ratio
from contestry.functions.counters import counted, lanes, uniforms
from contestry.operators.joins import override
from contestry.operators.kicks import kick_table
from contestry.operators.replicates import per_group, vector_totals
from contestry.session import cut_lineage

LEDGER = ["component", "game_id", "play_id", "season", "event_class", "charged_team",
          "actual", "expected", "swing", "luck_epa", "class_n"]


def class_table(rows: DataFrame, klass: str, outcome: str, epa: str, minimum: int = C.MIN_CLASS) -> DataFrame:
    """Per class: n, rate, both branch means, swing. Thin classes borrow the pooled rate,
    missing branches the pooled mean. One scan; the pooled row comes from the class sums."""
    won, lost = F.col(outcome) == 1, F.col(outcome) == 0
    sums = rows.groupBy(klass).agg(
        F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("k"),
        F.sum(F.when(won, F.col(epa))).alias("sw"), F.count(F.when(won, F.col(epa))).alias("nw"),
        F.sum(F.when(lost, F.col(epa))).alias("sl"), F.count(F.when(lost, F.col(epa))).alias("nl"))
    pooled = sums.agg(F.struct(
        ratio(F.sum("k"), F.sum("n")).alias("p"), ratio(F.sum("sw"), F.sum("nw")).alias("w"),
        ratio(F.sum("sl"), F.sum("nl")).alias("l"))).scalar()
    return sums.select(
        klass, "n",
        F.when(F.col("n") >= minimum, ratio("k", "n")).otherwise(pooled["p"]).alias("p"),
        F.coalesce(ratio("sw", "nw"), pooled["w"]).alias("epa_won"),
        F.coalesce(ratio("sl", "nl"), pooled["l"]).alias("epa_lost"),
    ).withColumn("swing_value", F.col("epa_won") - F.col("epa_lost"))


def all_fumbles(pbp: DataFrame) -> DataFrame:
    """Fumbles with the kickoff muffs moved into their own class, each play once."""
    muffs = P.muff_frame(pbp).select(
        "game_id", "play_id", "season", "home_team", F.col("muffing_team").alias("fumbled_1_team"),
        "epa_fumbler", "retained", F.lit("kickoff/muff").alias("fumble_class"))
    return override(P.fumble_frame(pbp), muffs, ["game_id", "play_id"])


def eligible_blocks(pbp: DataFrame) -> DataFrame:
    fumbles = P.fumble_frame(pbp, widened=False).select("game_id", "play_id")
    return P.blocked_frame(pbp).join(fumbles, ["game_id", "play_id"], "left_anti")


def field_goals(pbp: DataFrame) -> DataFrame:
    fg = kick_table(pbp, exclude_blocked=True).filter("is_xp = 0")
    return fg.withColumn("kick_class", F.concat(F.lit("fg/"), floor_bin("distance", 5).cast("string")))


def ledger_rows(rows: DataFrame, table: DataFrame, component: str, klass: str, outcome: str, team: str,
                dial: float = 0.0) -> DataFrame:
    """luck = (actual - expected) * swing, signed to home. ``dial`` blends the class rate
    with the charged side's own season rate."""
    priced = rows.join(table.select(klass, "p", "swing_value", F.col("n").alias("class_n")), klass)
    expected = F.col("p")
    if dial:
        own = rows.groupBy("season", team).agg(F.avg(outcome).alias("own"))
        priced = priced.join(own, ["season", team], "left")
        expected = F.coalesce(F.lit(dial) * F.col("own") + F.lit(1.0 - dial) * F.col("p"), F.col("p"))
    sign = F.when(F.col(team) == F.col("home_team"), 1.0).otherwise(-1.0)
    return priced.filter(F.col("p").isNotNull() & F.col("swing_value").isNotNull()).select(
        F.lit(component).alias("component"), "game_id", "play_id", "season", F.col(klass).alias("event_class"),
        F.col(team).alias("charged_team"), F.col(outcome).cast("double").alias("actual"),
        expected.alias("expected"), (F.col("swing_value") * sign).alias("swing"), "class_n",
    ).withColumn("luck_epa", (F.col("actual") - F.col("expected")) * F.col("swing"))


_EVENT = ("kind", "game_id", "play_id", "season", "home_team", "team", "outcome", "value", "klass", "live")


def luck_events(pbp: DataFrame) -> DataFrame:
    """Fumbles, muffs, blocked kicks and field goals in a few columns, each from one scan of the plays and written
    once: class tables, their pooled rows and the priced rows all read them."""
    none = F.lit(False).alias("live")
    keys = ["game_id", "play_id", "season", "home_team"]
    told = lambda rows, kind, team, outcome, value, klass, live=none: rows.select(
        F.lit(kind).alias("kind"), *keys, F.col(team).alias("team"), F.col(outcome).cast("int").alias("outcome"), F.col(value).alias("value"), klass.alias("klass"), live)
    parts = [
        told(P.fumble_frame(pbp), "fumble", "fumbled_1_team", "retained", "epa_fumbler", F.col("fumble_class"), F.col("fumble_recovery_1_team").isNotNull().alias("live")),
        told(P.muff_frame(pbp), "muff", "muffing_team", "retained", "epa_fumbler", F.lit("kickoff/muff")),
        told(P.blocked_frame(pbp), "blocked", "kicking_team", "retained", "epa_kicker", F.col("kick_class")),
        told(field_goals(pbp), "field_goal", "posteam", "made", "epa", F.col("kick_class")),
    ]
    return cut_lineage(reduce(DataFrame.unionByName, parts).select(*_EVENT))


def full_ledger(pbp: DataFrame) -> DataFrame:
    """Fumbles with muffs, blocked kicks and field goals, one row per luck event."""
    events = luck_events(pbp)
    of = lambda kind: events.filter(F.col("kind") == kind)
    fum = override(of("fumble"), of("muff"), ["game_id", "play_id"])
    blk = of("blocked").join(of("fumble").filter("live").select("game_id", "play_id"), ["game_id", "play_id"], "left_anti")
    parts = [ledger_rows(rows, class_table(rows, "klass", "outcome", "value"), component, "klass", "outcome", "team")
             for component, rows in (("fumble", fum), ("blocked", blk), ("field_goal", of("field_goal")))]
    return reduce(DataFrame.unionByName, parts)


def strict_ledger(pbp: DataFrame) -> DataFrame:
    """The narrower edition: recovered fumbles and field goals only."""
    fum, fg = P.fumble_frame(pbp, widened=False), field_goals(pbp)
    parts = [
        ledger_rows(fum, class_table(fum, "fumble_class", "retained", "epa_fumbler"), "fumble", "fumble_class", "retained", "fumbled_1_team"),
        ledger_rows(fg, class_table(fg, "kick_class", "made", "epa"), "field_goal", "kick_class", "made", "posteam"),
    ]
    return reduce(DataFrame.unionByName, parts)


def edition(ledger: DataFrame, games: DataFrame, slope: float = C.POINTS_PER_EPA,
            sigma: float = C.SIGMA_OF_RECORD) -> DataFrame:
    """One row per played contest: margins, share with its interval, luck totals."""
    q = F.col("expected")
    per = ledger.groupBy("game_id").agg(
        F.sum("luck_epa").alias("total_luck_epa"), F.count(F.lit(1)).alias("n_luck_events"),
        F.sum(q * (F.lit(1.0) - q) * F.col("swing") * F.col("swing")).alias("v"))
    played = games.filter(F.col("margin").isNotNull()).select("game_id", "season", F.col("margin").alias("actual_margin"))
    out = played.join(per, "game_id", "left").withColumns({
        "total_luck_epa": F.coalesce("total_luck_epa", F.lit(0.0)),
        "n_luck_events": F.coalesce("n_luck_events", F.lit(0)),
        "sd": F.sqrt(F.coalesce("v", F.lit(0.0))) * slope})
    deserved = F.col("actual_margin") - F.col("total_luck_epa") * slope
    out = out.withColumn("deserved_margin", deserved)
    share = lambda k: normal_cdf((F.col("deserved_margin") + F.lit(k) * F.col("sd")) / F.lit(sigma))
    return out.withColumns({"dtw_home": share(0.0), "dtw_low": share(-1.5982), "dtw_high": share(1.5982)}).drop("v")


def replicate_share(ledger: DataFrame, games: DataFrame, reps: int, seed: int = 0,
                    slope: float = C.POINTS_PER_EPA) -> DataFrame:
    """Win share over replays of every coin, with the 89% interval of the replayed margin.

    Two layers: a class's rate is redrawn from its posterior (by mean and variance; one draw for
    all events of the class in a replicate), then each event's coin is tossed. A contest's
    replicates are one vector, to which each of its events adds.
    """
    played = games.filter(F.col("margin").isNotNull()).select("game_id", "margin")
    event = F.concat_ws("|", "component", F.col("play_id").cast("long").cast("string"))
    klass = F.concat_ws("|", "component", "event_class")
    keys = lanes("toss", seed, F.col("game_id"), event) | lanes("rate", "rate", seed, klass) | lanes("turn", "turn", seed, klass)
    events = ledger.join(played, "game_id").select(
        "game_id", "component", "play_id", "margin", *[F.col(c).cast("double").alias(c) for c in ("actual", "expected", "swing", "class_n")], *[v.alias(k) for k, v in keys.items()])

    def luck(r: dict) -> np.ndarray:
        numbers = counted(reps)
        u, u1, u2 = (uniforms(r[f"{k}_high"], r[f"{k}_low"], numbers) for k in ("toss", "rate", "turn"))
        z = np.sqrt(-2.0 * np.log(np.maximum(u1, 1e-12))) * np.cos(6.283185307179586 * u2)
        mean = (r["expected"] * r["class_n"] + 0.5) / (r["class_n"] + 1.0)
        rate = np.clip(mean + z * np.sqrt(mean * (1.0 - mean) / (r["class_n"] + 2.0)), 0.0, 1.0)
        return (r["actual"] - (u < rate)) * r["swing"] * slope

    def share(r: dict, total: np.ndarray, events: int) -> dict:
        deserved = r["margin"] - total
        low, high = np.quantile(deserved, (0.055, 0.945))
        # rounded: a replay that ends level is no win, whatever the order of its sum
        return {"dtw_home": float((np.round(deserved, 9) > 0).mean()), "deserved_mean": float(deserved.mean()), "low": float(low), "high": float(high)}

    return vector_totals(events, ["game_id"], ["component", "play_id"], luck, share, "game_id string, dtw_home double, deserved_mean double, low double, high double")


def _tossed(value: np.ndarray, chance: np.ndarray, up: float, down: float, p: float) -> tuple[np.ndarray, np.ndarray]:
    """The sums, in order, and their chances after one more coin."""
    sums, at = np.unique(np.round(np.concatenate((value + up, value + down)), 9), return_inverse=True)
    return sums, np.bincount(at, np.concatenate((chance * (1.0 - p), chance * p)))


def exact_share(ledger: DataFrame, games: DataFrame, slope: float = C.POINTS_PER_EPA) -> DataFrame:
    """Win share over all outcomes of a contest's coins, without draws.

    Each coin falls by the mean of its class's posterior rate. The distribution of their sum is that
    of two independent halves, each built coin by coin; sums that agree to 1e-9 are one outcome,
    so that coins of a class, which are worth the same, add one outcome each and not twice as many.
    The halves are never multiplied out: an outcome of one meets, in the sorted other, the
    chance of all that leave the contest won. Thirty unlike coins are two tables of 32,768 sums.
    """
    played = games.filter(F.col("margin").isNotNull()).select("game_id", "margin")
    events = ledger.join(played, "game_id").select(
        "game_id", "component", "play_id", "margin", *[F.col(c).cast("double").alias(c) for c in ("actual", "expected", "swing", "class_n")])

    def convolved(coins: list[dict]) -> Iterator[dict]:
        halves = [(np.zeros(1), np.ones(1)) for _ in range(2)]
        mean, var = coins[0]["margin"], 0.0
        alike: dict[float, list[dict]] = {}
        for r in coins:
            alike.setdefault(round(abs(r["swing"] * slope), 9), []).append(r)  # in one half, where their sums agree
        for same in alike.values():
            h = int(len(halves[0][0]) > len(halves[1][0]))
            for r in same:
                p, worth = (r["expected"] * r["class_n"] + 0.5) / (r["class_n"] + 1.0), r["swing"] * slope
                mean -= (r["actual"] - p) * worth
                var += p * (1.0 - p) * worth * worth
                halves[h] = _tossed(*halves[h], r["actual"] * worth, (r["actual"] - 1.0) * worth, p)
        (value, chance), (other, weight) = halves
        below = np.concatenate((np.zeros(1), np.cumsum(weight)))
        # won: what is left of the margin is above zero when rounded to 1e-9
        won = below[np.searchsorted(other, coins[0]["margin"] - value - 5e-10, side="left")]
        yield {"game_id": coins[0]["game_id"], "dtw_home": float(won @ chance), "deserved_mean": float(mean),
               "deserved_sd": float(np.sqrt(var)), "coins": len(coins)}

    return per_group(events, ["game_id"], ["component", "play_id"], convolved, "game_id string, dtw_home double, deserved_mean double, deserved_sd double, coins long")


# --- drives that carry luck -----------------------------------------------------------------


def with_drive_key(ledger: DataFrame, pbp: DataFrame) -> DataFrame:
    drives = pbp.select("game_id", "play_id", "fixed_drive", "qtr", "posteam")
    none = F.concat(F.lit("no-drive:"), F.col("play_id").cast("long").cast("string"))
    return ledger.join(drives, ["game_id", "play_id"], "left").withColumn(
        "drive_key", F.coalesce(F.col("fixed_drive").cast("long").cast("string"), none))


def luck_drives(ledger: DataFrame) -> DataFrame:
    """One row per drive with luck: totals, cap, attainable extremes, clip and bite flags.

    Two events of a class with opposite outcomes add up to the cap exactly, and the last bit of a
    class mean depends on the order in which its sum was made: the flags compare after
    rounding, so that noise is no bite.
    """
    s = (F.lit(2.0) * F.col("actual") - 1.0) * F.col("swing")
    zero = F.lit(0.0)
    per = ledger.withColumn("_s", s).groupBy("game_id", "drive_key").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.abs("luck_epa")).alias("sum_abs_luck"),
        F.sum("luck_epa").alias("signed_luck"), F.max(F.abs("swing")).alias("cap"),
        F.sum(F.greatest("_s", zero)).alias("pos_swing"), F.sum(F.least("_s", zero)).alias("neg_swing"),
        F.min("fixed_drive").alias("fixed_drive"), F.min("qtr").alias("qtr"),
        F.min_by("posteam", "play_id").alias("posteam"), F.count_distinct("posteam").alias("n_posteams"),
        F.concat_ws(",", F.sort_array(F.collect_set("component"))).alias("components"))
    over = lambda v: (F.round(v - F.col("cap"), 9) > 0).cast("int")
    per = per.withColumns({
        "max_attainable": F.greatest("pos_swing", -F.col("neg_swing")),
        "clipped_luck": F.greatest(F.least("signed_luck", "cap"), -F.col("cap"))})
    return per.withColumns({
        "bites_prereg": over(F.col("sum_abs_luck")),
        "bites_point_estimate": over(F.abs("signed_luck")),
        "bites_ever": over(F.col("max_attainable")),
        "reduction_epa": F.col("signed_luck") - F.col("clipped_luck")})


def expected_clip(ledger: DataFrame, drives: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """Mean clipped amount per drive over replicates of its events, each drive's one vector."""
    event = F.concat_ws("|", "component", F.col("play_id").cast("long").cast("string"))
    keys = lanes("toss", seed, F.col("game_id"), event)
    events = ledger.select(
        "game_id", "drive_key", "component", "play_id", F.abs(F.col("actual") - F.col("expected")).cast("double").alias("q"),
        ((F.lit(2.0) * F.col("actual") - 1.0) * F.col("swing")).alias("s"), *[v.alias(k) for k, v in keys.items()])
    events = events.join(drives.select("game_id", "drive_key", "cap"), ["game_id", "drive_key"])

    def tossed(r: dict) -> np.ndarray:
        return np.where(uniforms(r["toss_high"], r["toss_low"], counted(reps)) < r["q"], r["s"], 0.0)

    def clipped(r: dict, total: np.ndarray, n: int) -> dict:
        # rounded: what the order of a sum leaves behind is no clip
        excess = np.round(total - np.clip(total, -r["cap"], r["cap"]), 9)
        return {"cap_row_epa": float(-excess.mean()), "expected_abs_clip_epa": float(np.abs(excess).mean()), "clipped_in_the_draw": int((excess != 0).any())}

    return vector_totals(events, ["game_id", "drive_key"], ["component", "play_id"], tossed, clipped,
                         "game_id string, drive_key string, cap_row_epa double, expected_abs_clip_epa double, clipped_in_the_draw int")


# --- swing tables --------------------------------------------------------------------------------


def swing_table(rows: DataFrame, outcome: str, epa: str = "epa", minimum: int = C.MIN_PER_BRANCH) -> DataFrame:
    """Every yard-by-down cell with both branch means; a thin branch takes the pooled swing."""
    spark = rows.sparkSession
    yes, no = F.col(outcome) == 1, F.col(outcome) == 0
    cut = rows.withColumns({"yard_bin": labelled(C.YARD_BINS, "yardline_100"), "down_bin": in_sets(C.DOWN_BINS, "down")})
    sums = cut.groupBy("yard_bin", "down_bin").agg(
        F.count(F.when(yes, 1)).alias("n_yes"), F.count(F.when(no, 1)).alias("n_no"),
        F.sum(F.when(yes, F.col(epa))).alias("s_yes"), F.count(F.when(yes, F.col(epa))).alias("c_yes"),
        F.sum(F.when(no, F.col(epa))).alias("s_no"), F.count(F.when(no, F.col(epa))).alias("c_no"))
    pooled = sums.agg(F.struct(
        ratio(F.sum("s_yes"), F.sum("c_yes")).alias("yes"), ratio(F.sum("s_no"), F.sum("c_no")).alias("no"))).scalar()
    grid = spark.createDataFrame([(y, d) for _, _, y in C.YARD_BINS for _, d in C.DOWN_BINS], "yard_bin string, down_bin string")
    full = grid.join(sums, ["yard_bin", "down_bin"], "left").fillna(0, ["n_yes", "n_no"])
    thin = (F.col("n_yes") < minimum) | (F.col("n_no") < minimum)
    return full.select(
        "yard_bin", "down_bin", "n_yes", "n_no", ratio("s_yes", "c_yes").alias("mean_yes"), ratio("s_no", "c_no").alias("mean_no"),
        F.when(thin, pooled["yes"] - pooled["no"]).otherwise(ratio("s_yes", "c_yes") - ratio("s_no", "c_no")).alias("swing"),
        F.when(thin, pooled["no"]).otherwise(ratio("s_no", "c_no")).alias("no_mean"),
        (pooled["yes"] - pooled["no"]).alias("pooled"),
        F.when(thin, "pooled").otherwise("cell").alias("source"))


def sign_guard(table: DataFrame, positive: bool) -> DataFrame:
    """Cells whose swing has the wrong sign."""
    return table.filter(F.col("swing") <= 0 if positive else F.col("swing") >= 0)


def per_play_swing(rows: DataFrame, table: DataFrame) -> DataFrame:
    """|(air + after-catch) - incompletion| where readable, else the cell, else pooled; with the reason."""
    cells = table.select(F.concat_ws("|", "yard_bin", "down_bin").alias("cell"), "swing", "no_mean")
    pooled = table.agg(F.max("pooled")).scalar()
    cut = rows.withColumn("cell", P.swing_cell()).join(cells, "cell", "left")
    air, xyac = F.col("air_epa"), F.col("xyac_epa")
    reason = (
        F.when(air.isNull() & xyac.isNull(), "bin_both_null").when(air.isNull() | xyac.isNull(), "bin_xyac_only_null")
        .when(F.col("cell").isNull(), "bin_no_cell").otherwise("per_play"))
    incomplete = F.when(F.col("is_drop"), F.col("epa")).otherwise(F.col("no_mean"))
    return cut.withColumn("reason", reason).withColumn(
        "play_swing", F.when(F.col("reason") == "per_play", F.abs(air + xyac - incomplete))
        .otherwise(F.coalesce("swing", pooled)))


def capped_swing(ledger: DataFrame, cap: Column) -> DataFrame:
    """Swing magnitudes held at a cap, sign kept, luck re-priced."""
    s = F.signum("swing") * F.least(F.abs("swing"), cap)
    return ledger.withColumn("swing", s).withColumn("luck_epa", (F.col("actual") - F.col("expected")) * F.col("swing"))

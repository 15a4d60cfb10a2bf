"""Comparison of scored editions, always contest by contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions.columns import ratio
from contestry.operators.ranking import quantile_row


def bucket(share: str | Column, margin: str | Column) -> Column:
    """Too close inside the band; else holds when share and margin name one side; else a clear flip."""
    s = F.col(share) if isinstance(share, str) else share
    m = F.col(margin) if isinstance(margin, str) else margin
    return (
        F.when(s.between(*C.VERDICT_BAND), "too close to call")
        .when((s > 0.5) == (m > 0), "scoreboard holds").otherwise("clear flip"))


def sign_flip(deserved: str = "deserved_margin", actual: str = "actual_margin") -> Column:
    d, a = F.col(deserved), F.col(actual)
    return (a != 0) & (d != 0) & ((d > 0) != (a > 0))


def share_flip(share: str = "dtw_home", actual: str = "actual_margin") -> Column:
    return (F.col(actual) != 0) & ((F.col(share) > 0.5) != (F.col(actual) > 0))


def headline(edition: DataFrame) -> DataFrame:
    """Flips, ties, degenerate shares, bucket counts, median shift, big movers, the largest."""
    shift = F.abs(F.col("deserved_margin") - F.col("actual_margin"))
    e = edition.withColumns({"shift": shift, "bucket": bucket("dtw_home", "actual_margin")})
    n = F.count(F.lit(1))
    degenerate = (F.col("dtw_home") <= C.DEGENERATE[0]) | (F.col("dtw_home") >= C.DEGENERATE[1])
    row = e.agg(
        n.alias("games"), F.count_if(sign_flip()).alias("sign_flips"), F.count_if(F.col("actual_margin") == 0).alias("ties"),
        F.count_if(degenerate).alias("degenerate"), F.count_if(F.col("bucket") == "too close to call").alias("too_close"),
        F.count_if(F.col("bucket") == "clear flip").alias("clear_flip"), F.count_if(F.col("bucket") == "scoreboard holds").alias("holds"),
        F.count_if(F.col("shift") > C.MOVER_POINTS).alias("movers"), F.max("shift").alias("largest_swing"),
        F.max_by("game_id", F.struct(F.round("shift", 9), "game_id")).alias("largest_game"))
    med = quantile_row(e, {"median_shift": ("shift", 0.5)}).scalar()
    return row.withColumns({"median_shift": med, "sign_flip_share": ratio("sign_flips", "games"),
                            "degenerate_share": ratio("degenerate", "games")})


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two editions side by side with both buckets."""
    cols = ("deserved_margin", "dtw_home", "dtw_low", "dtw_high", "n_luck_events", "total_luck_epa")
    left = a.select("game_id", "season", "actual_margin", *[F.col(c).alias(f"{c}_a") for c in cols])
    right = b.select("game_id", *[F.col(c).alias(f"{c}_b") for c in cols])
    return left.join(right, "game_id").withColumns({
        "bucket_a": bucket("dtw_home_a", "actual_margin"), "bucket_b": bucket("dtw_home_b", "actual_margin"),
        "delta": F.col("dtw_home_b") - F.col("dtw_home_a")})


def transitions(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("bucket_a", "bucket_b").agg(F.count(F.lit(1)).alias("games"))


def flip_comparison(pairs: DataFrame) -> DataFrame:
    a, b = sign_flip("deserved_margin_a"), sign_flip("deserved_margin_b")
    return pairs.agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("bucket_a") != F.col("bucket_b")).alias("bucket_moved"),
        F.count_if(a).alias("sign_flips_a"), F.count_if(b).alias("sign_flips_b"), F.count_if(a != b).alias("sign_moved"),
        (F.count_if(b) - F.count_if(a)).alias("net_difference"))


def movement(pairs: DataFrame, affected: Column) -> DataFrame:
    """Movement and interval widening, over all contests and over the affected ones."""
    width = (F.col("dtw_high_b") - F.col("dtw_low_b")) - (F.col("dtw_high_a") - F.col("dtw_low_a"))
    scope = F.explode(F.when(affected, F.array(F.lit("all"), F.lit("affected"))).otherwise(F.array(F.lit("all"))))
    long = pairs.select(scope.alias("scope"), F.abs("delta").alias("move"), F.col("delta"), width.alias("widening"))
    one = long.groupBy("scope").agg(
        F.count(F.lit(1)).alias("games"), F.avg("delta").alias("mean_delta"), F.avg("move").alias("mean_move"),
        F.max("move").alias("max_move"), F.avg("widening").alias("mean_widening"))
    q = quantile_row(long, {"median_move": ("move", 0.5), "p89_move": ("move", 0.89), "median_widening": ("widening", 0.5)}, ["scope"])
    return one.join(q, "scope")


def flip_definitions(edition: DataFrame) -> DataFrame:
    """Where the sign and the share definitions of a flip agree, and how the band settles it."""
    s, d = sign_flip(), share_flip()
    band = F.col("dtw_home").between(*C.VERDICT_BAND)
    return edition.agg(
        F.count(F.lit(1)).alias("games"), F.count_if(s).alias("sign_flips"), F.count_if(d).alias("share_flips"),
        F.count_if(s & d).alias("both"), F.count_if(s & ~d).alias("sign_only"), F.count_if(~s & d).alias("share_only"),
        F.count_if(band).alias("in_band"), F.count_if(band & (s != d)).alias("disagree_in_band"),
        F.count_if(~band & (s != d)).alias("disagree_outside"))


def band_sweep(edition: DataFrame, half_widths) -> DataFrame:
    """Bucket counts and leftover disagreement for each half-width around one half."""
    widths = F.explode(F.array(*[F.lit(float(w)) for w in half_widths]))
    e = edition.withColumn("half_width", widths)
    inside = F.abs(F.col("dtw_home") - 0.5) <= F.col("half_width") + 1e-12
    live = ~inside & (F.col("actual_margin") != 0)
    s = (F.col("deserved_margin") > 0) != (F.col("actual_margin") > 0)
    d = (F.col("dtw_home") > 0.5) != (F.col("actual_margin") > 0)
    return e.groupBy("half_width").agg(
        F.count_if(inside).alias("too_close"), F.count_if(~inside & ~d).alias("holds"), F.count_if(~inside & d).alias("clear_flip"),
        F.count_if(live & (s != d)).alias("disagreements"))


def edition_delta(reference: DataFrame, arm: DataFrame, noise: DataFrame) -> DataFrame:
    """An arm against the reference beside a second draw of the reference: the noise floor."""
    r = reference.select("game_id", F.col("dtw_home").alias("r"), F.col("deserved_margin").alias("dr"))
    joined = r.join(arm.select("game_id", F.col("dtw_home").alias("a"), F.col("deserved_margin").alias("da")), "game_id").join(
        noise.select("game_id", F.col("dtw_home").alias("z")), "game_id")
    side = (F.col("a") > 0.5) != (F.col("r") > 0.5)
    long = joined.withColumns({"move": F.abs(F.col("a") - F.col("r")), "noise": F.abs(F.col("z") - F.col("r")), "signed": F.col("a") - F.col("r")})
    one = long.agg(
        F.count(F.lit(1)).alias("games"), F.avg("move").alias("mean_move"), F.max("move").alias("max_move"), F.avg("signed").alias("mean_signed"),
        F.count_if(side).alias("side_flips"), F.avg("noise").alias("mean_noise"))
    med = quantile_row(long, {"median_move": ("move", 0.5), "median_noise": ("noise", 0.5)})
    both = med.agg(F.struct(F.max("median_move").alias("m"), F.max("median_noise").alias("n"))).scalar()
    return one.withColumns({"median_move": both["m"], "median_noise": both["n"]})


def reconcile(published: DataFrame, rerun: DataFrame, tolerance: float) -> DataFrame:
    """Statistics by name, published against rerun, with an off flag."""
    both = published.withColumnRenamed("value", "published").join(rerun.withColumnRenamed("value", "rerun"), "statistic", "full")
    off = F.abs(F.col("published") - F.col("rerun")) > tolerance
    return both.withColumn("off", F.coalesce(off, F.lit(True)).cast("int"))


def give_back(pairs: DataFrame, per_game: DataFrame, slope: float = C.POINTS_PER_EPA) -> DataFrame:
    """Moved contests re-bucketed after a linear give-back of the capped part."""
    moved = pairs.filter(F.col("bucket_a") != F.col("bucket_b")).join(per_game, "game_id", "left")
    shift = F.col("deserved_margin_b") - F.col("deserved_margin_a")
    back = F.abs(F.coalesce("cap_row_epa", F.lit(0.0)) * slope)
    part = F.when(F.abs(shift) > 1e-12, F.least(back / F.abs(shift), F.lit(1.0))).otherwise(0.0)
    proxy = F.col("dtw_home_a") + (F.lit(1.0) - part) * F.col("delta")
    still = F.col("bucket_a") != bucket(proxy, "actual_margin")
    return moved.withColumns({"share_proxy": proxy, "still": still.cast("int"), "bitten": F.coalesce("bitten", F.lit(0))})


def describe(edition: DataFrame) -> DataFrame:
    shift = F.abs(F.col("deserved_margin") - F.col("actual_margin"))
    disagree = (F.col("dtw_home") > 0.5) != (F.col("actual_margin") > 0)
    return edition.agg(
        F.count(F.lit(1)).alias("games"), F.avg(shift).alias("mean_shift"), F.count_if((F.col("actual_margin") != 0) & disagree).alias("disagreements"),
        F.avg(F.col("dtw_high") - F.col("dtw_low")).alias("mean_width"), F.avg("n_luck_events").alias("events_per_game"))


def ledgers_by_component(a: DataFrame, b: DataFrame) -> DataFrame:
    side = lambda d, t: d.groupBy("component").agg(
        F.count(F.lit(1)).alias(f"n_{t}"), F.avg("expected").alias(f"expected_{t}"), F.sum("luck_epa").alias(f"luck_{t}"))
    return side(a, "a").join(side(b, "b"), "component", "full")


def expectation_shift(a: DataFrame, b: DataFrame, roofs: DataFrame) -> DataFrame:
    """Rows in both ledgers: paired expectation shift and moved rows, by roof."""
    keys = ["component", "game_id", "play_id"]
    both = a.select(*keys, F.col("expected").alias("ea")).join(b.select(*keys, F.col("expected").alias("eb")), keys)
    seen = roofs.groupBy("game_id").agg(F.max("roof").alias("roof"))
    shift = F.col("eb") - F.col("ea")
    return both.join(seen, "game_id").groupBy("component", "roof").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(shift).alias("mean_shift"), F.count_if(F.abs(shift) > 1e-9).alias("moved"))


def materiality(pairs: DataFrame, affected: Column) -> DataFrame:
    """Median move against the median half-width, on affected contests."""
    rows = pairs.filter(affected).select(F.abs("delta").alias("move"), ((F.col("dtw_high_a") - F.col("dtw_low_a")) / 2.0).alias("half"))
    med = quantile_row(rows, {"median_move": ("move", 0.5), "median_half_width": ("half", 0.5)})
    return med.withColumn("material", (F.col("median_move") >= F.col("median_half_width")).cast("int"))


def moved_overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two arms' moved contests: both, only one, only the other, Jaccard."""
    m = lambda d, t: d.select("game_id", (F.col("bucket_a") != F.col("bucket_b")).cast("int").alias(t))
    x = m(one, "l").join(m(two, "r"), "game_id", "full").fillna(0, ["l", "r"])
    both = F.sum(F.col("l") * F.col("r"))
    return x.agg(both.alias("both"), F.sum(F.col("l") * (1 - F.col("r"))).alias("only_left"), F.sum((1 - F.col("l")) * F.col("r")).alias("only_right"),
                 F.coalesce(ratio(both, F.sum(F.greatest("l", "r"))), F.lit(1.0)).alias("jaccard"))


def arms_side_by_side(pairs_by_arm: dict[str, DataFrame]) -> DataFrame:
    """One row per contest with each arm's change of the share."""
    out = None
    for name, pairs in pairs_by_arm.items():
        d = pairs.select("game_id", F.col("delta").alias(f"delta_{name}"))
        out = d if out is None else out.join(d, "game_id")
    return out


def arms_report(wide: DataFrame, left: str, right: str) -> DataFrame:
    a, b = F.col(f"delta_{left}"), F.col(f"delta_{right}")
    return wide.agg(
        F.count(F.lit(1)).alias("games"), F.avg(F.abs(a)).alias("mean_left"), F.avg(F.abs(b)).alias("mean_right"), F.corr(a, b).alias("r"),
        F.avg(((a * b) < -1e-15).cast("double")).alias("share_cancelling"))

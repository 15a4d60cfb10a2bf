"""Ordered operators: form, meetings, weighted quantiles, uniformity distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry import constants as C
from contestry.operators.ranking import bounded_frame, drop_copies, with_positions, with_prefix_sum


def rolling_strength(team_games: DataFrame, metric: str, window: int = C.FORM_WINDOW,
                     minimum: int = C.MIN_HISTORY) -> DataFrame:
    """Mean of the previous games only, once enough of them carry the metric.

    A null metric takes a place in the window but does not count toward the minimum.
    """
    placed = with_positions(team_games, ["team"], ["season", "week", "game_id"], "games_played")
    laid, over = bounded_frame(placed, ["team"], "games_played", window, 0)
    prior = over.rowsBetween(-window, -1)
    strength = F.when(F.count(metric).over(prior) >= minimum, F.avg(metric).over(prior))
    return drop_copies(laid.withColumn("strength", strength)).select(
        "game_id", "team", "strength", "games_played")


def next_try(plays: DataFrame, is_try: str, window: int = C.TRY_WINDOW) -> DataFrame:
    """For each play, whether a try follows within the next rows of its contest."""
    placed = with_positions(plays, ["game_id"], ["play_id", "mix"], "row")
    laid, over = bounded_frame(placed, ["game_id"], "row", 0, window)
    ahead = over.rowsBetween(1, window)
    return drop_copies(laid.withColumn("try_follows", F.coalesce(F.max(is_try).over(ahead), F.lit(0))))


def weighted_step_quantiles(df: DataFrame, group, value: str, weight: str, tie: str, quantiles) -> DataFrame:
    """First value whose cumulative weight share reaches q (a step function)."""
    cum = with_prefix_sum(df, group, [value, tie], weight, "cum")
    totals = df.groupBy(*group).agg(F.sum(weight).alias("total"))
    shared = cum.join(totals, list(group)) if group else cum.withColumn("total", df.agg(F.sum(weight)).scalar())
    return shared.groupBy(*group).agg(*[
        F.min(F.when(F.col("cum") >= F.lit(q) * F.col("total"), F.col(value))).alias(name)
        for name, q in quantiles.items()])


def weighted_linear_quantiles(df: DataFrame, value: str, weight: str, tie: str, quantiles) -> DataFrame:
    """Quantiles by linear interpolation on the cumulative weight share."""
    total = df.agg(F.sum(weight)).scalar()
    cum = with_prefix_sum(df, [], [value, tie], weight, "cum").withColumn("share", F.col("cum") / total)
    aggs = []
    for name, q in quantiles.items():
        aggs += [F.max(F.when(F.col("share") <= q, F.struct("share", value))).alias(f"_a_{name}"),
                 F.min(F.when(F.col("share") > q, F.struct("share", value))).alias(f"_b_{name}")]
    row = cum.agg(*aggs)
    out = []
    for name, q in quantiles.items():
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        slope = (F.lit(q) - a["share"]) / (b["share"] - a["share"])
        inside = a[value] + slope * (b[value] - a[value])
        out.append(F.when(a.isNull(), b[value]).when(b.isNull(), a[value]).otherwise(inside).alias(name))
    return row.select(*out)


def ks_from_uniform(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Largest gap between the empirical and the uniform distribution function."""
    placed = with_positions(df.filter(F.col(value).isNotNull()), [], [value, tie], "pos")
    n = placed.agg(F.count(F.lit(1))).scalar().cast("double")
    gap = F.greatest((F.col("pos") + 1) / n - F.col(value), F.col(value) - F.col("pos") / n)
    return placed.select(gap.alias("gap")).agg(F.max("gap").alias("ks"), F.count(F.lit(1)).alias("n"))


def paired(games: DataFrame) -> DataFrame:
    """Contests with a margin and their season-long unordered pair key."""
    from contestry.functions.columns import keyed

    low, high = F.least("home_team", "away_team"), F.greatest("home_team", "away_team")
    return games.filter(F.col("margin").isNotNull()).withColumn(
        "pair", keyed(F.col("season"), low, high))


def meetings(games: DataFrame) -> DataFrame:
    """0-based meeting number of a pair within the season."""
    return with_positions(paired(games), ["pair"], ["week", "game_id"], "meeting")


def rematches(games: DataFrame) -> DataFrame:
    """First two meetings of a pair, signed to whoever hosted the first; tied second games drop.

    The first meeting is a minimum per pair and the second is the minimum of what is
    left, so both are partial aggregates however often a pair met.
    """
    met = paired(games).select("pair", "season", F.struct(
        "week", "game_id", "home_team", "away_team", "margin").alias("m"))
    first = met.groupBy("pair").agg(F.min("m").alias("f"))
    later = met.join(first, "pair").filter(F.col("m") > F.col("f"))
    both = later.groupBy("pair").agg(
        F.max("season").alias("season"), F.min("f").alias("f"), F.min("m").alias("s"))
    same = F.col("s.home_team") == F.col("f.home_team")
    return both.select(
        "pair", "season", F.col("f.game_id").alias("game_id"),
        F.col("f.home_team").alias("team_a"), F.col("f.away_team").alias("team_b"),
        F.col("f.margin").alias("margin_g1_a"),
        F.when(same, F.col("s.margin")).otherwise(-F.col("s.margin")).alias("margin_g2_a"),
        same.cast("int").alias("a_home_g2"),
    ).filter(F.col("margin_g2_a") != 0)

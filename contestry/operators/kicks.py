"""Kick table, kick design, reference-scaled designs, stadium lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.functions.columns import guarded, keyed
from contestry.functions.plays import extra_point_attempt, field_goal_attempt, sanitize_weather

DISTANCE_CENTRE = 35.0
ROOF_LEVELS = ("dome", "closed", "open")
# Stadium elevations in thousands of feet for the driver's stadium ids: a rule, not a list.
ELEVATION_SQL = "select concat('S', lpad(cast(id as string), 2, '0')) as stadium_id, cast(id * id % 53 as double) / 1e1 as elev_kft from range(0, 32)"


def kick_table(pbp: DataFrame, exclude_blocked: bool = False) -> DataFrame:
    """Field goals and extra points in one scan, weather cleaned, stadium kept."""
    fg, xp = field_goal_attempt(exclude_blocked), extra_point_attempt(exclude_blocked)
    is_xp = F.when(F.coalesce(xp, F.lit(False)), 1).otherwise(0)
    good = F.when(is_xp == 1, F.col("extra_point_result") == "good").otherwise(
        F.col("field_goal_result") == "made")
    kicks = pbp.filter((fg | xp) & F.col("kicker_player_id").isNotNull()).select(
        "game_id", "play_id", "season", "week", "posteam", "home_team", "epa", "kicker_player_id",
        "roof", "temp", "wind", "stadium_id", "field_goal_result", "extra_point_result",
        F.col("kick_distance").alias("distance"),
        F.coalesce(good, F.lit(False)).cast("int").alias("made"), is_xp.alias("is_xp"))
    return sanitize_weather(kicks).withColumn("kicker_season", keyed("season", "kicker_player_id"))


def weather_report(kicks_raw: DataFrame) -> DataFrame:
    """What the sanitizer did, as one row."""
    indoors = F.col("roof").isin("dome", "closed")
    clean = sanitize_weather(kicks_raw.withColumn("_wind", F.col("wind")).withColumn("_temp", F.col("temp")))
    return clean.agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(indoors & (F.col("_wind").isNotNull() | F.col("_temp").isNotNull())).alias("indoor_nulled"),
        F.count_if(~indoors & (F.col("_wind") > 30)).alias("wind_capped"),
        F.max("_wind").alias("max_raw_wind"),
        F.count_if(~indoors & ~F.col("has_weather")).alias("outdoor_without_weather"),
        F.avg(F.when(F.col("has_weather"), F.col("wind"))).alias("mean_outdoor_wind"),
        F.avg(F.when(F.col("has_weather"), F.col("temp"))).alias("mean_outdoor_temp"))


def kick_design(kicks: DataFrame, elevation: bool = False) -> DataFrame:
    """Centred distance terms, roof dummies and weather that is structurally zero indoors."""
    means = kicks.filter("has_weather").agg(F.avg("wind").alias("w"), F.avg("temp").alias("t"))
    wind0, temp0 = means.select("w").scalar(), means.select("t").scalar()
    centred = F.col("distance") - DISTANCE_CENTRE
    seen = F.col("has_weather").cast("double")
    out = kicks.withColumns({
        "d1": centred, "d2": centred * centred / 100.0, "d3": centred * centred * centred / 1000.0,
        **{f"roof_{r}": F.coalesce(F.col("roof") == r, F.lit(False)).cast("double") for r in ROOF_LEVELS},
        "wind_term": F.when(F.col("has_weather"), F.col("wind") - wind0).otherwise(0.0) * seen,
        "temp_term": F.when(F.col("has_weather"), F.col("temp") - temp0).otherwise(0.0) * seen,
    })
    if elevation:
        out = out.withColumn("elev_term", F.col("elev_kft") - kicks.agg(F.avg("elev_kft")).scalar())
    return out


def with_elevation(kicks: DataFrame, table: DataFrame) -> DataFrame:
    """Stadium lookup; a stadium without an elevation is an error, never sea level."""
    joined = kicks.join(table, "stadium_id", "left")
    return guarded(joined, F.col("elev_kft").isNull(), F.concat(F.lit("no elevation for stadium "), F.coalesce("stadium_id", F.lit("(none)"))))


def standardised_design(rows: DataFrame, reference: DataFrame, numeric, squares=(), dummies=()) -> DataFrame:
    """Columns scaled by a reference frame's mean and SD, squares of scaled columns, dummies."""
    stats = reference.agg(*[f(c).alias(f"{p}_{c}") for c in numeric
                            for p, f in (("m", F.avg), ("s", F.stddev_samp))])
    scaled = {f"{c}_z": (F.col(c).cast("double") - stats.select(f"m_{c}").scalar())
              / stats.select(f"s_{c}").scalar() for c in numeric}
    out = rows.withColumns(scaled)
    out = out.withColumns({f"{c}_z_squared": F.col(f"{c}_z") * F.col(f"{c}_z") for c in squares})
    return out.withColumns({
        f"{c}_{v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("double") for c, levels in dummies for v in levels})


def complete_cases(df: DataFrame, required) -> tuple[DataFrame, DataFrame]:
    """Rows with every covariate, and a one-row count of what was dropped."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("kept"),
                    F.count_if(~ok).alias("dropped"))
    return df.filter(ok), counts


def columns_like(df: DataFrame, patterns) -> list[str]:
    """Column names holding any of the patterns; reads the schema only."""
    return [c for c in df.columns if any(p in c.lower() for p in patterns)]


def screen(df: DataFrame, name: str, population, flagged) -> DataFrame:
    """Population and flagged counts of one audit screen."""
    hit = F.coalesce(population & flagged, F.lit(False))
    return df.agg(F.count_if(F.coalesce(population, F.lit(False))).alias("population"),
                  F.count_if(hit).alias("flagged")).select(F.lit(name).alias("screen"), "population", "flagged")


def screens(df: DataFrame, specs) -> DataFrame:
    """Every screen from one pass over the plays: ``(name, population, flagged)``."""
    aggs = []
    for i, (_, pop, bad) in enumerate(specs):
        aggs += [F.count_if(F.coalesce(pop, F.lit(False))).alias(f"p{i}"),
                 F.count_if(F.coalesce(pop & bad, F.lit(False))).alias(f"f{i}")]
    rows = [F.struct(F.lit(n).alias("screen"), F.col(f"p{i}").alias("population"),
                     F.col(f"f{i}").alias("flagged")) for i, (n, _, _) in enumerate(specs)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def flagged_sample(df: DataFrame, population, flagged, limit: int = 50) -> DataFrame:
    """The first flagged rows by key; the limit is the report's own."""
    return df.filter(population & flagged).orderBy("game_id", "play_id").limit(limit)

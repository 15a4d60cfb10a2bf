"""Contests in progress: plays arrive as files, readiness and the season table follow.

No watermark is needed: the state is one row per contest, the plays that it has seen of each
side, and a contest has at most as many as the season's gate lets pass. A late file adds to its
own contests, a play that comes again adds nothing, and a contest under the floor is not
rejected; it waits for a later trigger. Each trigger writes the contests that it changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from contestry import constants as C


def play_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def side_counts(plays: DataFrame) -> DataFrame:
    """Scrimmage rows per contest side; works on a stream and on a batch alike."""
    return (
        plays.filter(
            F.col("epa").isNotNull() & F.col("posteam").isNotNull()
            & F.col("play_type").isin(*C.SCRIMMAGE_TYPES) & (F.col("two_point_attempt") == 0))
        .groupBy("game_id", "posteam").agg(F.count(F.lit(1)).alias("n"))
    )


def readiness(counts: DataFrame, schedule: DataFrame, min_plays: int = C.PLAY_FLOOR) -> DataFrame:
    over = (
        counts.groupBy("game_id").agg(F.min("n").alias("fewest"), F.count(F.lit(1)).alias("sides"))
        .select("game_id", ((F.col("sides") == 2) & (F.col("fewest") >= min_plays)).alias("over")))
    finished = schedule.filter(F.col("result").isNotNull()).select("game_id", "week")
    return finished.join(over, "game_id", "left").select(
        "game_id", "week", F.coalesce("over", F.lit(False)).alias("ready"))


SIDES = "game_id string, home_n long, away_n long, batch long"


def seen_sides(plays: DataFrame) -> DataFrame:
    """Different scrimmage plays of each side, by contest; ``plays`` names its home side."""
    counted = plays.filter(
        F.col("epa").isNotNull() & F.col("posteam").isNotNull()
        & F.col("play_type").isin(*C.SCRIMMAGE_TYPES) & (F.col("two_point_attempt") == 0))
    at_home = F.col("posteam") == F.col("home_team")
    return counted.groupBy("game_id").agg(
        F.size(F.collect_set(F.when(at_home, F.col("play_id")))).cast("long").alias("home_n"),
        F.size(F.collect_set(F.when(~at_home, F.col("play_id")))).cast("long").alias("away_n"))


def start_readiness(plays: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Follow the plays; a trigger writes the contests that it changed, and no others, under its
    own number, so a trigger that is replayed writes the same folder again."""

    def publish(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        seen_sides(plays).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(publish).trigger(availableNow=True).start()
    )


def read_readiness(spark: SparkSession, out: str, schedule: DataFrame, min_plays: int = C.PLAY_FLOOR) -> DataFrame:
    """Every finished contest and whether both sides reach the floor, by its last change."""
    from contestry.sources.snapshots import exists

    if exists(spark, out):
        seen = spark.read.schema(SIDES).option("basePath", out).parquet(out)
    else:
        seen = spark.createDataFrame([], SIDES)
    last = seen.groupBy("game_id").agg(F.max_by(F.least("home_n", "away_n"), "batch").alias("fewest"))
    finished = schedule.filter(F.col("result").isNotNull()).select("game_id", "week")
    return finished.join(last, "game_id", "left").select("game_id", "week", (F.coalesce("fewest", F.lit(0)) >= min_plays).alias("ready"))


def poll_live(plays: DataFrame, schedule: DataFrame, root: str, pull: str, min_plays: int = C.PLAY_FLOOR) -> DataFrame:
    """One poll of a live season: take in what has arrived, then replace the seasons on file if a
    contest became ready since the last poll. Returns the finished contests with ``ready``, and
    ``fresh`` where the contest was not on file as ready before.

    Readiness keeps its state between polls; the season table is refreshed from the same files.
    """
    from contestry.sources import snapshots

    spark = plays.sparkSession
    start_readiness(plays, f"{root}/_ready", f"{root}/_ready_state").awaitTermination()
    now = read_readiness(spark, f"{root}/_ready", schedule, min_plays)
    known = snapshots.exists(spark, f"{root}/_polled")
    before = spark.read.parquet(f"{root}/_polled") if known else spark.createDataFrame([], "game_id string")
    told = now.join(before.select("game_id", F.lit(True).alias("_was")), "game_id", "left").select(
        "game_id", "week", "ready", (F.col("ready") & F.col("_was").isNull()).alias("fresh"))
    fresh = told.filter("fresh").select("game_id")
    rows = spark.createDataFrame(told.collect(), told.schema)  # a row a finished contest of the live seasons
    if fresh.limit(1).count():
        refresh_live(plays, root, f"{root}/_pull_state/{pull}", pull)
        rows.filter("fresh").select("game_id").coalesce(1).write.mode("append").parquet(f"{root}/_polled")
    return rows


def refresh_live(plays: DataFrame, root: str, checkpoint: str, pull: str) -> None:
    """Read one pull of the live seasons to its end and replace the seasons it carries.

    A pull holds a whole season so far, but may come in any number of files and so of
    micro-batches. Each batch only stages its rows under the pull's name and its own number,
    so a replayed batch writes the same folder again; once the stream has read everything
    there is, all staged rows, unique on the play key, replace their seasons in one commit: a reader
    sees the old seasons or the new ones. A run that stops before that leaves the seasons as
    they were, and the same call finishes it.
    """
    from contestry.sources import snapshots

    staged = f"{root}/_pulls/{pull}"

    def stage(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staged}/batch={number}")

    query = plays.writeStream.option("checkpointLocation", checkpoint).foreachBatch(stage).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = plays.sparkSession
    whole = spark.read.schema(plays.schema).option("basePath", staged).parquet(f"{staged}/batch=*").select(*plays.columns)
    rows = whole.dropDuplicates(["game_id", "play_id"])
    counts = rows.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("game_id").alias("g")).collect()  # a row a season
    facts = {r.season: {"partial": True, "n_rows": r.n, "n_games": r.g, "errors": [], "warnings": []} for r in counts}
    snapshots.replace_seasons(rows, root, "pbp", facts, facts)

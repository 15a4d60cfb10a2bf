"""Season-partitioned tables: readers, gated writers, live refresh, manifest, drift."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry import constants as C
from contestry.functions.columns import guarded
from contestry.functions.plays import filtered_plays
from contestry.operators import quality
from contestry.sources import snapshots


class SeasonMissing(FileNotFoundError):
    """A season that was asked for is not on file."""


class SeasonRefused(RuntimeError):
    """A season failed validation and was not written."""


def _path(root: str, dataset: str, season: int) -> str:
    return f"{root}/{dataset}/season={season}"


def _places(spark: SparkSession, root: str, dataset: str, seasons: Iterable[int], version: int | None = None) -> dict[int, str]:
    """Where each season is, those on file only: as committed, else in the dataset's own folder."""
    committed = snapshots.path_of(spark, root, dataset, version)
    places = {s: committed.get(s) or _path(root, dataset, s) for s in seasons}
    return {s: p for s, p in places.items() if snapshots.exists(spark, p)}


def cached_seasons(spark: SparkSession, root: str, dataset: str, seasons: Iterable[int]) -> list[int]:
    return list(_places(spark, root, dataset, seasons))


def load_seasons(spark: SparkSession, root: str, dataset: str, seasons: Iterable[int],
                 columns: list[str] | None = None, version: int | None = None) -> DataFrame:
    """Asked seasons as one frame; a missing one is an error naming it.

    Schemas may drift by season, so each partition keeps its own and the union fills
    absent columns with null. The column list reaches every parquet scan. What a commit replaces
    meanwhile does not change the frame; ``version`` reads what an older commit left.
    """
    seasons = list(seasons)
    if not seasons:
        raise ValueError("no seasons were asked for")
    places = _places(spark, root, dataset, seasons, version)
    missing = [s for s in seasons if s not in places]
    if missing:
        raise SeasonMissing(f"no {dataset} on file for {', '.join(map(str, missing))}")
    out = None
    for season in seasons:
        part = spark.read.parquet(places[season]).withColumn("season", F.lit(season))
        if columns is not None:
            part = part.select(*[c for c in columns if c in part.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if columns is not None:
        absent = [c for c in columns if c not in out.columns]
        if absent:
            raise ValueError(f"no season of {dataset} has the column(s) {absent}")
        out = out.select(*columns)
    return out


def load_if_cached(spark: SparkSession, root: str, dataset: str, seasons: Iterable[int]) -> DataFrame | None:
    """Seasons on file only, ``None`` when there are none."""
    found = cached_seasons(spark, root, dataset, seasons)
    return load_seasons(spark, root, dataset, found) if found else None


def load_filtered(spark: SparkSession, root: str, seasons: Iterable[int]) -> DataFrame:
    return filtered_plays(load_seasons(spark, root, "pbp", seasons))


def write_season(df: DataFrame, root: str, dataset: str) -> None:
    """Replace exactly the seasons the frame carries, zstd parquet.

    The rebalance hint lets adaptive execution split a heavy season and merge small
    pieces, so neither one task per season nor a flood of tiny files results.
    """
    (df.hint("rebalance", "season").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy("season").parquet(f"{root}/{dataset}"))


def _facts(row, partial: bool) -> dict:
    return {"partial": bool(partial), "n_rows": int(row.n_rows), "n_games": int(row.n_games), "errors": list(row.errors), "warnings": list(row.warnings)}


def ingest_season(df: DataFrame, root: str, dataset: str, season: int, partial: bool = False,
                  force: bool = False, expected: int | None = None) -> DataFrame:
    """Validate one season, refuse or commit it."""
    spark = df.sparkSession
    fresh = force or partial or season not in _places(spark, root, dataset, [season])
    frame = df if fresh else load_seasons(spark, root, dataset, [season])
    check = quality.validate_charting if dataset == "ftn" else quality.validate_plays
    options = {} if dataset == "ftn" else {"partial": partial}
    report = check(frame, season, expected=expected, **options)
    row = report.first()
    if partial and row.n_rows == 0:
        raise SeasonRefused(f"no plays for {season} yet: the season has not started")
    if row.errors and fresh:
        raise SeasonRefused(f"{dataset} {season} failed validation: " + "; ".join(row.errors))
    if fresh:
        snapshots.replace_seasons(frame.withColumn("season", F.lit(season)), root, dataset, [season], {season: _facts(row, partial)})
    return report


def ingest_all(df: DataFrame, root: str, partial: bool = False, expected: DataFrame | None = None) -> DataFrame:
    """Every season of a play table through the gate at once: one grouped validation, one
    write of the seasons that pass, one commit. Returns the report, a row a season, with
    ``accepted``. ``expected`` has ``season`` and ``want``, the contests that it should hold.

    Seasons without errors replace what is on file; the others leave it as it was.
    """
    spark = df.sparkSession
    report = quality.validate_all(df, "season", partial=partial, expected=expected).withColumn("accepted", F.size("errors") == 0)
    rows = report.collect()  # a row a season
    taken = {r.season: _facts(r, partial) for r in rows if r.accepted}
    if taken:
        snapshots.replace_seasons(df, root, "pbp", taken, taken)
    return spark.createDataFrame(rows, report.schema)


def ingest_live(df: DataFrame, root: str, season: int, schedule: DataFrame | None = None,
                expected: int | None = None) -> DataFrame:
    """The live season: always replaced, validated as partial, empty input refused."""
    report = ingest_season(df, root, "pbp", season, partial=True, expected=expected)
    if schedule is not None:
        refresh_schedule(schedule, root, [season])
    return report


def refresh_schedule(fresh: DataFrame, root: str, seasons: Iterable[int]) -> None:
    """Replace exactly these seasons' rows; every other season's files stay untouched. A season
    that was asked for and has no fresh row is left with none."""
    spark, asked = fresh.sparkSession, sorted(set(seasons))
    rows = fresh.filter(F.col("season").isin(*asked))
    found = {r.season for r in rows.select("season").distinct().collect()}  # at most the asked ones
    write_season(rows, root, "schedules")
    for season in asked:
        if season not in found:
            gone = spark._jvm.org.apache.hadoop.fs.Path(_path(root, "schedules", season))
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def load_schedule(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/schedules")


def schedule_row(spark: SparkSession, root: str, game_id: str) -> dict:
    """One contest's schedule row, empty when it is not on file."""
    if not snapshots.exists(spark, f"{root}/schedules"):
        return {}
    row = load_schedule(spark, root).filter(F.col("game_id") == game_id).first()
    return row.asDict() if row else {}


# --- manifest ---------------------------------------------------------------------------


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The last entry of each dataset and season; commit numbers say which is the last."""
    return snapshots.entries(spark, root, version)


def is_cached(spark: SparkSession, root: str, dataset: str, season: int) -> bool:
    """Listed in the manifest and still on disk; either alone is a miss."""
    path = snapshots.path_of(spark, root, dataset).get(season)
    return path is not None and snapshots.exists(spark, path)


#: Bytes of a file that one task hashes, and the stores of which workers can read a part of a file.
HASH_RANGE = 64 << 20
RANGED = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def file_hashes(spark: SparkSession, root: str, piece: int = HASH_RANGE) -> DataFrame:
    """16 hex digits of a tree digest for each parquet file, keyed by its path below the root.

    Each range of ``piece`` bytes is hashed by itself, in whatever task it falls to, and the
    digest of a file is that of its ranges' digests in order: no row and no task holds a file, and
    one of any size is hashed by many tasks. In a store that only Spark reads, a file is one row
    (and so at most 2 GB); its digest is the same.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    file = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("file")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(piece).cast("long"))
    folder, fs = snapshots.file_system(spark, root)
    if fs.getUri().getScheme() in RANGED:
        ranges = files.select("path", file, F.explode(starts).alias("at")).repartition(spark.sparkContext.defaultParallelism, "path", "at")
        parts = ranges.mapInArrow(_range_digests(piece), "file string, at long, digest string")
        digests = parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("d"))
        joined = F.array_join(F.transform("d", lambda r: r["digest"]), "")
    else:
        digests = files.select(file, F.transform(starts, lambda at: F.sha2(F.substring(F.col("content"), (at + 1).cast("int"), F.lit(piece)), 256)).alias("d"))
        joined = F.array_join("d", "")
    return digests.select("file", F.substring(F.sha2(joined, 256), 1, 16).alias("digest"))


def _range_digests(piece: int):
    def hashed(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        for batch in batches:
            rows = batch.to_pylist()
            digests = []
            for r in rows:
                fs, path = FileSystem.from_uri(r["path"])
                with fs.open_input_file(path) as f:
                    digests.append(hashlib.sha256(f.read_at(max(0, min(piece, f.size() - r["at"])), r["at"])).hexdigest())
            yield pa.RecordBatch.from_pydict({"file": [r["file"] for r in rows], "at": [r["at"] for r in rows], "digest": pa.array(digests, pa.string())})
    return hashed


def season_hashes(spark: SparkSession, root: str) -> DataFrame:
    """A digest for each season's folder, from those of its files, of which there may be several;
    their names are the writer's and do not count.

    Bytes are hashed, not rows, so only files that were left alone are sure to keep their digest: Parquet lists
    a column's encodings in the order of a hash set that differs from one JVM to the next.
    """
    files = file_hashes(spark, root).withColumn("file", F.regexp_extract("file", r"^(.+)/[^/]+$", 1))
    joined = F.array_join(F.array_sort(F.collect_list("digest")), "")
    return files.groupBy("file").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("digest"))


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Every file that moved, vanished or appeared."""
    both = recorded.withColumnRenamed("digest", "was").join(
        current.withColumnRenamed("digest", "now"), "file", "full")
    state = (
        F.when(F.col("now").isNull(), "missing from cache")
        .when(F.col("was").isNull(), "not in the recorded manifest")
        .when(F.col("was") != F.col("now"), "revised"))
    return both.withColumn("finding", state).filter(F.col("finding").isNotNull()).select("file", "finding")


def attach_columns(plays: DataFrame, extras: DataFrame, columns: list[str]) -> DataFrame:
    """Extra columns by play key; a missing or different play raises in the plan."""
    keys = ["game_id", "play_id"]
    where = F.concat_ws(" ", *keys)
    side = extras.groupBy(*keys).agg(F.max("epa").alias("_epa"), *[F.max(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_rows"))
    side = guarded(side, F.col("_rows") > 1, F.concat(F.lit("the columns to attach repeat "), where)).drop("_rows")
    joined = plays.drop(*columns).join(side, keys, "left")
    same = F.coalesce(F.abs(F.col("_epa") - F.col("epa")) < 1e-8, F.lit(False))
    return guarded(joined, ~same, F.concat(F.lit("columns do not line up at "), where)).drop("_epa")


def write_summary(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result sink: a parquet table or a folder of JSON lines."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"sink must be parquet or json, got {fmt!r}")
    df.write.mode("overwrite").format(fmt).save(path)


# --- weights artifact ---------------------------------------------------------------------

WEIGHTS_SCHEMA = (
    "columns array<string>, mean array<double>, cov array<array<double>>, sigma2 double, "
    "n_train_team_games int, margin_sd double, sigma_once double, n_draws int, seed int, arm string"
)


def weights_row(spark: SparkSession) -> DataFrame:
    w = C.WEIGHTS_OF_RECORD
    return spark.createDataFrame([(
        list(C.WEIGHT_COLUMNS), list(w["mean"]), [list(r) for r in w["cov"]], w["sigma2"], w["n_rows"],
        w["margin_sd"], C.SIGMA_OF_RECORD, C.DRAWS_OF_RECORD, C.SEED_OF_RECORD, C.ARM_OF_RECORD)], WEIGHTS_SCHEMA)


def load_weights(spark: SparkSession, path: str) -> dict:
    """The artifact as a checked record; a field off its pin is named in the error."""
    rows = spark.read.schema(WEIGHTS_SCHEMA).option("multiLine", "true").json(path)
    row = rows.first()
    off = [r.field for r in quality.weights_report(rows).filter("ok = 0").collect()]
    if off:
        raise ValueError(f"weights are not the model of record: {', '.join(off)}")
    return {"mean": tuple(row["mean"]), "cov": tuple(map(tuple, row["cov"])), "sigma2": row["sigma2"],
            "margin_sd": row["margin_sd"], "n_rows": row["n_train_team_games"]}

"""Exact deduplication as a stateful stream: keyed state on disk, full bytes checked on hits.

Documents arrive as Parquet files. A streaming aggregate keeps, for each digest of a normalised
text, how many rows have it and which of them stays: its sort key, its identifier and its
locator (file and row). The state lies in RocksDB on the executors' disks, with its snapshots in
the shared folder; nothing in it ever expires, and texts are not in it. What the state says are
copies is then checked: the locator fetches the text that stays, and every row of its digest
is compared with it byte by byte. Texts that merely share a digest are grouped anew by their bytes.

Column expressions, joins and aggregates only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contestry.llm.common import shared_folder, staged

#: Characters that do not count when texts are compared.
IGNORED = " \t\n\x0b\x0c\r"

#: Bytes of input that one micro-batch takes at most, unless a single file is larger.
BATCH_BYTES = 64 << 30

#: The state on disk, in bounded memory and without space set aside, whatever the number of
#: partitions of an executor.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def strong_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _located(docs: DataFrame, id_col: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Each row's normalised text, digest and place in the order in which a group keeps one:
    most code points, least id (null last), then file and row for rows that agree in both."""
    meta = docs.metadataColumn("_metadata")
    place = F.struct(
        (-F.length(F.coalesce(text, F.lit("")))).alias("shorter"), F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"),
        meta["file_path"].alias("file"), meta["row_index"].alias("row"),
    )
    rows = docs.select(normalised(F.col(text)).alias("norm"), place.alias("place"))
    return rows.withColumn("digest", digest(F.col("norm")))


def _arriving(spark: SparkSession, path: str, schema: StructType, bytes_per_trigger: int) -> DataFrame:
    """The files below a folder as a stream; a file is a folder of which only that name counts."""
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isFile():
        return reader.option("pathGlobFilter", jvm_path.getName()).parquet(jvm_path.getParent().toString())
    return reader.parquet(path)


def absorb(spark: SparkSession, path: str, schema: StructType, state: str, *, id_col: str = "doc_id", text: str = "text",
           digest: Callable[[Column], Column] = strong_digest, bytes_per_trigger: int = BATCH_BYTES) -> DataFrame:
    """Take the files of ``path`` that ``state`` has not seen into it, and return its groups:
    ``digest``, ``place`` of the row that stays, ``n`` rows so far.

    ``state`` is a folder that the cluster shares. Each batch writes the groups that it changed
    under its own number, so a batch replayed after a failure writes the same folder again, and
    a later call goes on where the last one ended. How the state is dealt over partitions is
    settled by the first call.
    """
    stream = _arriving(spark, path, schema, bytes_per_trigger)
    groups = _located(stream, id_col, text, digest).groupBy("digest").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))

    def publish(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/groups/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:  # a stream takes the settings with it when it starts
        query = (
            groups.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint")
            .foreachBatch(publish).trigger(availableNow=True).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    kept = StructType().add("digest", "binary").add("place", groups.schema["place"].dataType).add("n", "long").add("batch", "long")
    seen = spark.read.schema(kept).option("basePath", f"{state}/groups").parquet(f"{state}/groups")
    return seen.groupBy("digest").agg(F.max_by(F.struct("place", "n"), "batch").alias("g")).select("digest", "g.*")


def deduplicate(spark: SparkSession, path: str, *, id_col: str = "doc_id", text: str = "text", state: str | None = None,
                digest: Callable[[Column], Column] = strong_digest, bytes_per_trigger: int = BATCH_BYTES) -> DataFrame:
    """One row for each row on file: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical without white space (blank, tab, line feed, vertical
    tab, form feed, carriage return). The longest original text stays, among those the least id,
    among rows that repeat an id the first one on file; exactly one row of a group is ``kept``.
    Null texts count as empty and form a group with blank ones; null ids come after all others;
    other columns are not read. An empty table gives no rows.

    With ``state``, a shared folder, later calls take in only files that are new; without, a
    folder of its own is used once. Files must not change once they are there. ``digest`` may be
    any binary expression: where it is equal for different texts, their bytes decide.
    """
    docs = spark.read.parquet(path)
    folder = state or f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    for _ in range(5):
        groups = absorb(spark, path, docs.schema, folder, id_col=id_col, text=text, digest=digest, bytes_per_trigger=bytes_per_trigger)
        if (groups.agg(F.sum("n")).first()[0] or 0) == docs.count():
            break
        docs = spark.read.parquet(path)  # files came in between: look again
    else:
        raise RuntimeError(f"{path} changes faster than it is read")
    if state is None:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)

    rows = _located(docs, id_col, text, digest)
    several = groups.filter("n > 1").select(F.col("place").alias("stays"), "n")
    # the text of the row that stays, fetched by its locator: at most one for each group
    stays = rows.withColumn("file", F.col("place.file")).withColumn("row", F.col("place.row")).join(
        several.select(F.col("stays.file").alias("file"), F.col("stays.row").alias("row"), "stays", "n"), ["file", "row"])
    stays = stays.select("digest", F.col("norm").alias("kept_norm"), "stays", "n")
    met = rows.join(stays, "digest", "left")
    checked = staged(met.select(
        F.col("place.id").alias("doc_id"), F.coalesce(F.col("stays.id"), F.when(F.col("stays").isNull(), F.col("place.id"))).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("place") == F.col("stays"), F.lit(True)).alias("kept"),
        F.sha2("norm", 256).alias("text_sha256"), "digest", (F.col("stays").isNull() | (F.col("norm") == F.col("kept_norm"))).alias("same"),
    ))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if not checked.filter("not same").limit(1).count():
        return checked.select(*columns)
    shared = checked.filter("not same").select("digest").distinct()
    apart = rows.join(shared, "digest", "left_semi")
    true = apart.groupBy("digest", "norm").agg(F.min("place").alias("stays"), F.count(F.lit(1)).alias("group_size"))
    again = apart.join(true, ["digest", "norm"]).select(
        F.col("place.id").alias("doc_id"), F.col("stays.id").alias("keep_id"), "group_size", (F.col("place") == F.col("stays")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))
    return checked.join(shared, "digest", "left_anti").select(*columns).unionByName(again)

"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "contestry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; sizes come from the cluster, not from here."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(*COMPILED)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: HotSpot never compiles a method of more bytecode than this; a wide row's stage would be interpreted.
COMPILED = ("spark.sql.codegen.hugeMethodLimit", "8000")


def compiled_stages(spark: SparkSession) -> None:
    """Have Spark split what would be too large a method for HotSpot, unless the session says otherwise."""
    if spark.conf.get(COMPILED[0], None) is None:
        spark.conf.set(*COMPILED)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder, so a lost executor never changes it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

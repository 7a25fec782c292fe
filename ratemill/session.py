"""Session helpers: a tuned local builder, the shared checkpoint folder, and tables kept there."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "ratemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans in this package rely on; on a cluster leave master unset."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints, which all executors share: the one the session names in spark.checkpoint.dir.

    Where none is named, a folder of this machine is taken in local mode only; elsewhere that is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ratemill-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for a table of this application; it goes when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


#: Bytes of a stored table's row groups, so that a large file is read in many tasks.
ROW_GROUP = 8 << 20


#: Rows that a bucket should hold: each is read by one task, and many small ones leave little to pre-aggregate in each.
BUCKET_ROWS = 1_000_000


def buckets_for(spark: SparkSession, rows: int, each: int = BUCKET_ROWS) -> int:
    """Buckets of some `each` rows, a core's worth at least: a power of two, so that rows in buckets are in fewer buckets too, file by file."""
    return 1 << (max(spark.sparkContext.defaultParallelism, math.ceil(rows / each)) - 1).bit_length()


def stored_by(keys: list[str], df: DataFrame, rows: int = 0, buckets: int | None = None) -> DataFrame:
    """As stored(), in buckets by `keys`: joins, windows and groupings by them shuffle nothing of this table.

    `rows`, a guess of its rows, only decides how many buckets there are, where that is not given: a core's worth at least. No key may be
    heavy. The table's name is left in the session's catalog.
    """
    spark = df.sparkSession
    buckets = buckets or max(spark.sparkContext.defaultParallelism, math.ceil(rows / BUCKET_ROWS))
    name = f"ratemill_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", own_folder(spark, "buckets"))
    writer.bucketBy(buckets, *keys).saveAsTable(name)
    return spark.table(name)


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once and read back from a Parquet table in the shared folder; it goes when the driver ends.

    For what several plans read: columns that a plan does not use are not read, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = own_folder(spark, "stored")
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

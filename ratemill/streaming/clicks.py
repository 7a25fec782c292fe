"""From a stream of JSON messages to event tables and continuously updated aggregates.

Sources and sinks take a format and options. Kafka needs its connector on the class path and is not
exercised by the tests, which use the file source with the same code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ratemill import schemas
from ratemill.operators.events import aggregate_events, decode_events, encode_events
from ratemill.sources import versions
from ratemill.sources.deltas import stream_batch, write_delta

TOPIC = "user-events"


def read_kafka(
    spark: SparkSession, servers: str, topic: str = TOPIC, group: str | None = None, **options: str
) -> DataFrame:
    """Messages of a topic from the earliest offset; offsets are kept in the query's checkpoint."""
    settings = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", **options}
    if group:
        settings["kafka.group.id"] = group
    return spark.readStream.format("kafka").options(**settings).load()


def read_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages from text files, one JSON object per line, as a `value` column."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def decoded(messages: DataFrame) -> DataFrame:
    """Decoded messages with the time of ingestion."""
    return decode_events(messages).withColumn("created_at", F.current_timestamp())


def event_rows(stream: DataFrame) -> DataFrame:
    """Good rows of decoded(), with a surrogate id and the day for partitioning."""
    names = [f.name for f in schemas.CLICK_EVENT]
    return (
        stream.filter("ok")
        .select(F.expr("uuid()").alias("id"), *names, "created_at")
        .withColumn("created_day", F.to_date("created_at"))
    )


def dead_letters(stream: DataFrame) -> DataFrame:
    """Messages that are not JSON or lack an id; they are kept, and do not stop the stream."""
    return stream.filter(~F.col("ok")).select("raw", "created_at")


def _start(rows: DataFrame, path: str, checkpoint: str, once: bool, *partitions: str) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.outputMode("append").start()


def start_ingest(messages: DataFrame, path: str, checkpoint: str, once: bool = False) -> list[StreamingQuery]:
    """Append good events to `path`/events (by day) and the rest to `path`/dead_letters.

    The file sink commits a micro-batch at a time, so a restart from the checkpoint neither loses nor
    repeats an event.
    """
    stream = decoded(messages)
    return [
        _start(event_rows(stream), f"{path}/events", f"{checkpoint}/events", once, "created_day"),
        _start(dead_letters(stream), f"{path}/dead_letters", f"{checkpoint}/dead_letters", once),
    ]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The ingested events as a batch table; a filter on created_day prunes folders."""
    return spark.read.schema(schemas.CLICKSTREAM).parquet(f"{path}/events")


def running_total(stream: DataFrame) -> DataFrame:
    """The number of good events so far, for the complete or update output mode."""
    return stream.filter("ok").groupBy().agg(F.count(F.lit(1)).alias("saved_events"))


def publish(events: DataFrame, sink: str = "kafka", **options: str):
    """A writer of keyed JSON messages for a batch or a stream; the caller saves or starts it."""
    messages = encode_events(events)
    writer = messages.writeStream if messages.isStreaming else messages.write
    return writer.format(sink).options(**options)


def start_processed_upsert(
    stream: DataFrame, path: str, checkpoint: str, once: bool = False, name: str = "stream"
) -> StreamingQuery:
    """Keep counts per (user, product, type) current: each micro-batch adds its own delta.

    A micro-batch that is repeated after a failure replaces its delta, or is left alone if that has been folded, so counts
    stay exact. `name` stands for the
    checkpoint folder: a stream that starts with a new one needs a new name, and starting it with a used name is
    refused, as its numbers would begin again over the old deltas. Read the table with deltas.processed_events.
    """
    good = stream.filter("ok")
    _own_name(stream.sparkSession, path, checkpoint, name)
    return _each_batch(
        good, lambda batch, number: write_delta(aggregate_events(batch), path, stream_batch(name, number)), checkpoint, once
    )


def start_user_features(
    stream: DataFrame, path: str, checkpoint: str, once: bool = False, name: str = "stream"
) -> StreamingQuery:
    """Keep per-user features current, with exact distinct products; read with deltas.user_event_features."""
    good = stream.filter("ok")
    _own_name(stream.sparkSession, path, checkpoint, name)
    return _each_batch(
        good, lambda batch, number: write_delta(user_product_counts(batch), path, stream_batch(name, number)), checkpoint, once
    )


def _own_name(spark: SparkSession, path: str, checkpoint: str, name: str) -> None:
    """Refuse a new checkpoint under a name that has deltas already, folded ones too."""
    begun = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    used = versions.load(spark, path).covered(f"stream {name}")
    if used and not begun.getFileSystem(spark._jsc.hadoopConfiguration()).exists(begun):
        raise ValueError(f"{path} holds deltas of a stream named {name}; a new checkpoint needs another name")


def user_product_counts(events: DataFrame) -> DataFrame:
    """Counts per (user, product): the grain from which user features, distinct products included, add up."""
    return events.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.max("created_at").alias("last_active"),
    )


def approximate_user_features(stream: DataFrame) -> DataFrame:
    """Per-user features inside the streaming state alone, with a sketch for distinct products.

    They are features over all time, so the state keeps one row per user and grows with the number of users, as the table
    itself does. start_user_features keeps no state.
    """
    return (
        stream.filter("ok")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.approx_count_distinct("product_id").alias("unique_products"),
            F.count_if(F.col("event_type") == "purchase").alias("purchases"),
            F.count_if(F.col("event_type") == "view").alias("views"),
            F.max("created_at").alias("last_active"),
        )
    )


def _each_batch(rows: DataFrame, write, checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()

"""Batch jobs over the click table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratemill import schemas

EVENT_KEY = ["user_id", "product_id", "event_type"]


def decode_events(messages: DataFrame, value: str = "value", schema=schemas.CLICK_EVENT) -> DataFrame:
    """JSON messages to event columns, with `raw` (the text) and `ok` (parsed, and all ids present).

    A message that is not JSON decodes to a struct of nulls, so `ok` tests the required fields. The
    struct is unfolded by a generator, which parses a message once; plain field access would parse it
    once per field.
    """
    text = F.col(value).cast("string").alias("raw")
    decoded = messages.select(text).select("raw", F.inline(F.array(F.from_json("raw", schema))))
    ok = F.col("user_id").isNotNull() & F.col("product_id").isNotNull() & F.col("event_type").isNotNull()
    return decoded.select(*[f.name for f in schema], "raw", ok.alias("ok"))


def encode_events(events: DataFrame) -> DataFrame:
    """Event rows to keyed JSON messages: key is the user, value the JSON text."""
    body = F.struct(*[f.name for f in schemas.CLICK_EVENT])
    return events.select(F.col("user_id").alias("key"), F.to_json(body).alias("value"))


def _moment(events: DataFrame, as_of: str | datetime) -> Column:
    return F.lit(as_of).cast(events.schema["created_at"].dataType)


def trailing(events: DataFrame, as_of: str | datetime, hours: int = 24) -> DataFrame:
    """Events created in the `hours` up to as_of, both ends included: what a look at that moment shows."""
    now = _moment(events, as_of)
    start = now - F.expr(f"INTERVAL {int(hours)} HOURS")
    return events.filter((F.col("created_at") >= start) & (F.col("created_at") <= now))


def between(events: DataFrame, start: str | datetime, end: str | datetime) -> DataFrame:
    """Events created from `start` up to, but not at, `end`: windows that touch share no event."""
    return events.filter((F.col("created_at") >= _moment(events, start)) & (F.col("created_at") < _moment(events, end)))


def recent_event_count(events: DataFrame, as_of: str | datetime, hours: int = 24) -> DataFrame:
    return trailing(events, as_of, hours).agg(F.count(F.lit(1)).alias("event_count"))


def aggregate_events(events: DataFrame) -> DataFrame:
    """Count and last time per (user, product, type)."""
    return events.groupBy(*EVENT_KEY).agg(
        F.count(F.lit(1)).alias("event_count"), F.max("created_at").alias("last_seen")
    )


def fold_batches(batches: DataFrame) -> DataFrame:
    """Event counts per key from aggregated batches: counts add up, last_seen is the latest batch's, even if it is older."""
    return batches.groupBy(*EVENT_KEY).agg(
        F.sum("event_count").alias("event_count"), F.max_by("last_seen", "batch_id").alias("last_seen")
    )


def merge_processed(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert of one aggregated batch into a table of counts: the fold of the two."""
    columns = [*EVENT_KEY, "event_count", "last_seen"]
    old, new = (
        table.select(*columns, F.lit(number).alias("batch_id")) for number, table in enumerate((existing, batch))
    )
    return fold_batches(old.unionByName(new))


def popular_by_events(events: DataFrame, as_of: str | datetime, n: int = 100) -> DataFrame:
    """The n products with the most events, over all history."""
    return (
        events.groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("interaction_count"))
        .orderBy(F.desc("interaction_count"), F.asc("product_id"))
        .limit(n)
        .withColumn("updated_at", _moment(events, as_of))
    )


def user_event_features(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("product_id").alias("unique_products"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.max("created_at").alias("last_active"),
    )

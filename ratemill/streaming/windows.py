"""The count of the last hours as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def trailing_counts(events: DataFrame, hours: int = 24, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(as_of, event_count): at each multiple of `every`, the events created in the `hours` up to then, both ends included.

    `events` is a stream with created_at. The row of a moment appears once, when the watermark (the latest created_at less
    `late`) has passed the moment; from then on it equals recent_event_count of all events that came in time. An event
    counts at every moment that has not appeared when it comes, and is dropped from those that have: rows that are late for all of
    their moments are what the query's progress reports as dropped by the watermark. Moments without events have no row.
    The state is one count per open moment, hours and `late` divided by `every`, whatever the number of events.
    """
    # A window leaves out its end; one microsecond more takes in the events of that moment, and times have no finer parts.
    span = F.window("created_at", f"{int(hours)} hours 1 microsecond", every)
    counted = events.withWatermark("created_at", late).groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("event_count"))
    return counted.select((F.col("span.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("as_of"), "event_count")


def start_trailing_counts(
    events: DataFrame, path: str, checkpoint: str, once: bool = False, hours: int = 24, every: str = "1 hour", late: str = "10 minutes"
) -> StreamingQuery:
    """Append the counts of trailing_counts() to a table at `path`, each moment once."""
    writer = trailing_counts(events, hours, every, late).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def state_rows(query: StreamingQuery) -> int:
    """Rows of state that a query holds after its last micro-batch."""
    return sum(operator.numRowsTotal for operator in query.lastProgress.stateOperators) if query.lastProgress else 0

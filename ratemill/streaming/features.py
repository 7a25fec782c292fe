"""Exact features per user out of keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ratemill.sources import deltas, versions

FEATURES = "user_id string, total_events long, unique_products long, purchases long, views long, last_active timestamp"
PARTIAL = "user_id string, product_id string, total_events long, purchases long, views long, last_active timestamp"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per user and product of each batch, so that a very active user sends few rows to its task."""
    for batch in batches:
        kind = batch.column("event_type")
        table = pa.table(
            {
                "user_id": batch.column("user_id"),
                "product_id": batch.column("product_id"),
                "purchases": pc.cast(pc.equal(kind, "purchase"), pa.int64()),
                "views": pc.cast(pc.equal(kind, "view"), pa.int64()),
                "created_at": batch.column("created_at"),
            }
        )
        found = table.group_by(["user_id", "product_id"]).aggregate([([], "count_all"), ("purchases", "sum"), ("views", "sum"), ("created_at", "max")])
        found = found.select(["user_id", "product_id", "count_all", "purchases_sum", "views_sum", "created_at_max"])
        yield from found.rename_columns(["user_id", "product_id", "total_events", "purchases", "views", "last_active"]).to_batches()


class _UserFeatures(StatefulProcessor):
    """State of a user: one row of totals, and the products that the user has touched, one small row each."""

    def __init__(self, quiet_ms: int | None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "total_events long, unique_products long, purchases long, views long, last_active timestamp")
        self.products = handle.getMapState("products", "product_id string", "seen boolean")

    def _row(self, user: str) -> pd.DataFrame:
        return pd.DataFrame([(user, *self.totals.get())], columns=["user_id", "total_events", "unique_products", "purchases", "views", "last_active"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.totals.get() if self.totals.exists() else (0, 0, 0, 0, None)
        total, products, purchases, views, last = held
        for part in rows:
            total += int(part["total_events"].sum())
            purchases += int(part["purchases"].sum())
            views += int(part["views"].sum())
            for product in part["product_id"].dropna().unique():
                if not self.products.containsKey((product,)):
                    self.products.updateValue((product,), (True,))
                    products += 1
            latest = part["last_active"].max()
            last = latest if last is None or (latest is not None and latest > pd.Timestamp(last)) else last
        self.totals.update((total, products, purchases, views, pd.Timestamp(last).to_pydatetime() if last is not None else None))
        if self.quiet_ms is None:
            yield self._row(key[0])
        else:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key[0])

    def close(self) -> None:
        pass


def user_features(stream: DataFrame, quiet_seconds: int | None = None) -> DataFrame:
    """Current features of the users of each micro-batch of `stream` (decoded clicks); the columns of user_event_features().

    Exact, distinct products included. They cover all time, so the state never shrinks: a row of totals per user and a row per pair of user
    and product, kept on the executors' disks (RocksDB) by user and saved to the checkpoint as changes; a micro-batch reads and
    writes only its own users' rows. With `quiet_seconds` a user's features come from a timer, when the user has sent nothing for so
    long, instead of after every micro-batch.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    partial = stream.filter("ok").select("user_id", "product_id", "event_type", "created_at").mapInArrow(_summed, PARTIAL)
    return partial.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_UserFeatures(None if quiet_seconds is None else int(quiet_seconds * 1000)),
        outputStructType=FEATURES,
        outputMode="Update",
        timeMode="None" if quiet_seconds is None else "ProcessingTime",
    )


def start_user_features(stream: DataFrame, path: str, checkpoint: str, once: bool = False, name: str = "stream", quiet_seconds: int | None = None) -> StreamingQuery:
    """Keep a table of users' features current: each micro-batch adds the new rows of its users as a part of the next version.

    A micro-batch that is repeated after a failure replaces its part. Read with current_features(), fold with fold_features().
    """

    def write(batch: DataFrame, number: int) -> None:
        deltas.write_delta(batch, path, deltas.stream_batch(name, number))

    writer = user_features(stream, quiet_seconds).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_rows(parts: DataFrame) -> DataFrame:
    """Of each user the row of the latest part."""
    columns = [c for c in parts.columns if c != "batch_id"]
    newest = parts.groupBy("user_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("row"))
    return newest.select("row.*")


def current_features(spark: SparkSession, path: str) -> DataFrame:
    """The features of all users as of the last micro-batch."""
    return latest_rows(versions.read(spark, path))


def fold_features(spark: SparkSession, path: str, up_to: str) -> bool:
    """One part, with one row per user, instead of all parts up to the batch id `up_to`."""
    return deltas.fold_up_to(spark, path, latest_rows, up_to)

"""Event rows with surrogate ids that a retry does not change, and the most popular products kept up to date."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ratemill import schemas
from ratemill.session import stored
from ratemill.sources import versions
from ratemill.sources.deltas import covers_of, fold_up_to, next_number, stream_batch, write_delta
from ratemill.sources.versions import Version

LISTED = 1_000


def append_numbered(rows: DataFrame, path: str, batch_id: str, by: tuple[str, ...] = ()) -> range:
    """Add `rows` with an `id` column: whole numbers that go on from the table's last one; returns those given now.

    Numbers and rows become the table's in one step, so a batch that fails gives its numbers back, and one that is repeated after
    it has been added keeps the numbers that it has (the answer is an empty range). With two writers the slower one numbers its
    rows anew. Rows are numbered by their place in the partitions of one stored copy; only counts per partition reach the driver.
    """
    spark = rows.sparkSession
    kind, (span,) = next(iter(covers_of(batch_id).items()))
    place = F.monotonically_increasing_id()
    kept = stored(rows.withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted(tuple(r) for r in kept.groupBy("_part").agg(F.count(F.lit(1))).collect())
    total, before = 0, []
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "_part long, _before long")
    while True:
        now = versions.load(spark, path)
        if versions.within(*span, now.covered(kind)):
            return range(0)
        start = next_number(spark, path)
        number = (F.col("_before") + F.col("_place") + F.lit(start)).cast("long")
        numbered = kept.join(F.broadcast(offsets), "_part").select(number.alias("id"), *rows.columns)
        part = versions.write_part(numbered, path, batch_id, covers_of(batch_id), by=by)

        def add(latest: Version) -> Version | None:
            if versions.within(*span, latest.covered(kind)) or latest.state.get("next_number", 1) != start:  # noqa: B023
                return None
            return replace(latest, schema=latest.schema or numbered.schema.json(), parts=(*latest.parts, part), state={**latest.state, "next_number": start + total})  # noqa: B023

        if any(p.folder == part.folder for p in versions.commit(spark, path, add).parts):
            return range(start, start + total)


def start_numbered_ingest(stream: DataFrame, path: str, checkpoint: str, once: bool = False, name: str = "stream") -> StreamingQuery:
    """Append the good rows of clicks.decoded() to a table with ids 1, 2, 3 ..., by day: no gap and no repeat over retries and restarts."""
    names = [f.name for f in schemas.CLICK_EVENT]
    rows = stream.filter("ok").select(*names, "created_at", F.to_date("created_at").alias("created_day"))

    def write(batch: DataFrame, number: int) -> None:
        append_numbered(batch, path, stream_batch(name, number), by=("created_day",))

    return _started(rows, write, checkpoint, once)


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """The events with their ids; a filter on created_day prunes folders."""
    return versions.read(spark, path).drop("batch_id")


def fold_numbered(spark: SparkSession, path: str, up_to: str) -> bool:
    """One part instead of all micro-batches up to the batch id `up_to`; ids stay."""
    return fold_up_to(spark, path, lambda rows: rows.drop("batch_id"), up_to, by=("created_day",))


def _started(rows: DataFrame, write, checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def product_counts(events: DataFrame, listed: int = LISTED) -> DataFrame:
    """(product_id, n, listed): events per product of a batch; the `listed` most frequent ones are marked."""
    counts = stored(events.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")))
    best = counts.orderBy(F.desc("n"), F.asc("product_id")).limit(listed).select("product_id", F.lit(True).alias("listed"))
    return counts.join(F.broadcast(best), "product_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def add_popular(events: DataFrame, path: str, batch_id: str, listed: int = LISTED) -> bool:
    """Add a batch's counts to the table that popular_now() reads: the listed ones apart, the rest sorted by product."""
    rows = product_counts(events, listed).repartitionByRange("listed", "product_id").sortWithinPartitions("listed", "product_id")
    return write_delta(rows, path, batch_id, by=("listed",))


def start_popular(stream: DataFrame, path: str, checkpoint: str, once: bool = False, name: str = "stream", listed: int = LISTED) -> StreamingQuery:
    """Keep the table of popular_now() current; a repeated micro-batch replaces its counts."""
    good = stream.filter("ok").select("product_id")
    return _started(good, lambda batch, number: add_popular(batch, path, stream_batch(name, number), listed), checkpoint, once)


def fold_popular(spark: SparkSession, path: str, up_to: str, listed: int = LISTED) -> bool:
    """One part, listed anew, instead of all batches up to the batch id `up_to`."""

    def fold(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("product_id").agg(F.sum("n").alias("n"))
        best = counts.orderBy(F.desc("n"), F.asc("product_id")).limit(listed).select("product_id", F.lit(True).alias("listed"))
        return counts.join(F.broadcast(best), "product_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))

    return fold_up_to(spark, path, fold, up_to, by=("listed",))


def popular_now(spark: SparkSession, path: str, as_of: str | datetime, n: int = 100, listed: int = LISTED) -> DataFrame:
    """popular_by_events() of all batches, exact, without reading their rare products.

    A product that a batch does not list has at most as many events there as the batch's last listed one (none, if the batch lists all it
    has). So the listed counts give each product a least and a greatest total; those whose greatest total reaches the n-th least
    one are candidates, and only their unlisted counts are looked up: a condition on the sorted product ids. If products that
    no batch lists might be among the best, all counts are added up instead: lists are too short for such data.
    """
    rows = versions.read(spark, path)
    lists = rows.where("listed")
    bounds = lists.groupBy("batch_id").agg(F.when(F.count(F.lit(1)) >= listed, F.min("n")).otherwise(0).alias("most"))
    known = lists.join(F.broadcast(bounds), "batch_id").groupBy("product_id").agg(F.sum("n").alias("least"), F.sum("most").alias("own"))
    unlisted = bounds.agg(F.sum("most")).first()[0] or 0
    lowest = [r["least"] for r in known.orderBy(F.desc("least")).limit(n).select("least").collect()]
    enough = len(lowest) == n and lowest[-1] > unlisted
    if unlisted == 0:
        counts = known.select("product_id", F.col("least").alias("interaction_count"))
    elif not enough:
        counts = rows.groupBy("product_id").agg(F.sum("n").alias("interaction_count"))
    else:
        wanted = known.where(F.col("least") + F.lit(unlisted) - F.col("own") >= lowest[-1]).select("product_id")
        few = [r["product_id"] for r in wanted.limit(LISTED + 1).collect()]
        rare = rows.where("NOT listed")
        rare = rare.where(F.col("product_id").isin(few)) if len(few) <= LISTED else rare.join(wanted, "product_id", "left_semi")
        chosen = lists.join(wanted, "product_id", "left_semi").select("product_id", "n").unionByName(rare.select("product_id", "n"))
        counts = chosen.groupBy("product_id").agg(F.sum("n").alias("interaction_count"))
    best = counts.orderBy(F.desc("interaction_count"), F.asc("product_id")).limit(n)
    return best.withColumn("updated_at", F.lit(as_of).cast("timestamp"))

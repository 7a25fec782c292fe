"""Keyed tables kept as one aggregated delta per batch.

A batch adds its own part to the table's next version (see versions), so nothing is counted twice, no table is rewritten
per batch and no reader sees half of a change. A batch id is text whose order is that of the batches: the bounds of a window of
time, or a stream's name and the number of its micro-batch. The current table is an aggregation over the deltas;
fold_up_to() makes one part of old ones. A part keeps the windows and micro-batches that it covers, so what is folded is
known and is not counted again.
"""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ratemill.operators.events import aggregate_events, between, fold_batches
from ratemill.sources import versions
from ratemill.sources.versions import Part, Ranges, Version

_WINDOW = re.compile(r"(\d{12})_(\d{12})$")
_MICRO = re.compile(r"([A-Za-z][A-Za-z0-9-]*)_(\d{12})$")


def stream_batch(stream: str, number: int) -> str:
    """The id of a micro-batch. `stream` names one checkpoint folder: a new checkpoint counts from 0 again."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", stream):
        raise ValueError("a stream's name has letters, digits and hyphens, a letter first")
    return f"{stream}_{int(number):012d}"


def covers_of(batch_id: str) -> dict[str, Ranges]:
    """What a batch stands for: seconds of time, numbers of a stream, or only its own name."""
    if m := _WINDOW.match(batch_id):
        return {"time": [[int(m[1]), int(m[2])]]}
    if m := _MICRO.match(batch_id):
        return {f"stream {m[1]}": [[int(m[2]), int(m[2]) + 1]]}
    return {f"name {batch_id}": [[0, 1]]}


def _seconds(moment: datetime) -> int:
    """Seconds since 1970; a moment without a zone is taken as UTC."""
    value = (moment if moment.tzinfo else moment.replace(tzinfo=UTC)).timestamp()
    if value != int(value) or value < 0:
        raise ValueError("batch bounds are whole seconds from 1970 on")
    return int(value)


def _is_folded(now: Version, batch_id: str) -> bool:
    return all(versions.within(a, b, now.covered(kind, folded=True)) for kind, ranges in covers_of(batch_id).items() for a, b in ranges)


def _check(now: Version, batch_id: str) -> None:
    """Refuse a batch that shares a part of its time with another one but is not that batch."""
    for kind, ranges in covers_of(batch_id).items():
        for low, high in ranges:
            others = versions.united(r for p in now.parts if p.batch_id != batch_id or p.folded for r in p.covers.get(kind, []))
            if shared := versions.overlapping(low, high, others):
                raise ValueError(f"batch {batch_id} overlaps {kind} {shared}")


def write_delta(rows: DataFrame, path: str, batch_id: str, by: tuple[str, ...] = ()) -> bool:
    """Make a batch's rows its delta; a repeated batch replaces its own delta and no other.

    A batch that has been folded already is counted: it is left as it is, and the answer is False. One that overlaps others is refused.
    """
    spark = rows.sparkSession
    now = versions.load(spark, path)
    if _is_folded(now, batch_id):
        return False
    _check(now, batch_id)
    part = versions.write_part(rows, path, batch_id, covers_of(batch_id), by=by)

    def add(now: Version) -> Version | None:
        if _is_folded(now, batch_id):
            return None
        _check(now, batch_id)
        others = tuple(p for p in now.parts if p.batch_id != batch_id)
        return replace(now, schema=now.schema or rows.schema.json(), parts=(*others, part))

    return any(p.folder == part.folder for p in versions.commit(spark, path, add).parts)


def windows(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Bounds, in seconds, of the time windows that a delta table holds; folded ones that touch are one."""
    now = versions.load(spark, path)
    own = [tuple(r) for p in now.parts if not p.folded for r in p.covers.get("time", [])]
    return sorted(own + [tuple(r) for r in now.covered("time", folded=True)])


def merge_window(events: DataFrame, start: datetime, end: datetime, path: str) -> bool:
    """The periodic job: counts of the events from `start` up to, not at, `end`, as the delta of that window.

    The same window again replaces its delta; if it has been folded it is left alone (False). A window that overlaps another one
    is refused: its events would count twice. Pass the end of the window before as `start`, and no event is left out.
    """
    low, high = _seconds(start), _seconds(end)
    if low >= high:
        raise ValueError("a window ends after it starts")
    return write_delta(aggregate_events(between(events, start, end)), path, f"{low:012d}_{high:012d}")


def merge_day(events: DataFrame, as_of: datetime, path: str) -> bool:
    """The daily job at `as_of`: from where the latest window ends (24 hours before, at first) up to `as_of`.

    A second run at the same moment repeats its window; at a moment that is folded it changes nothing (False).
    """
    moment = _seconds(as_of)
    spark = events.sparkSession
    folded = versions.load(spark, path).covered("time", folded=True)
    if versions.within(moment - 1, moment, folded):
        return False
    known = windows(spark, path)
    same = [low for low, high in known if high == moment]
    start = same[0] if same else max((high for _, high in known), default=moment - 24 * 3600)
    zone = as_of.tzinfo
    begin = datetime.fromtimestamp(start, UTC)
    return merge_window(events, begin.astimezone(zone) if zone else begin.replace(tzinfo=None), as_of, path)


def read_deltas(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All deltas with their batch_id, as of the latest version."""
    return versions.read(spark, path, schema=schema)


def processed_events(deltas: DataFrame) -> DataFrame:
    """Event counts per key over all deltas."""
    return fold_batches(deltas)


def user_event_features(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("user_id").agg(
        F.sum("total_events").alias("total_events"),
        F.countDistinct("product_id").alias("unique_products"),
        F.sum("purchases").alias("purchases"),
        F.sum("views").alias("views"),
        F.max("last_active").alias("last_active"),
    )


def _folded(spark: SparkSession, path: str, now: Version, old: list[Part], fold, into: str, up_to: str, by: tuple[str, ...] = ()) -> Part:
    kept = versions.read(spark, path, replace(now, parts=tuple(old)))
    rows = fold(kept).select(*[c for c in kept.columns if c != "batch_id"])
    covers: dict[str, Ranges] = {}
    for p in old:
        for kind, ranges in p.covers.items():
            covers[kind] = versions.united([*covers.get(kind, []), *ranges])
    return versions.write_part(rows, into, up_to, covers, True, by)


def fold_up_to(spark: SparkSession, path: str, fold, up_to: str, by: tuple[str, ...] = ()) -> bool:
    """Make one part of all batches up to `up_to`, in a new version; False if there is none.

    `fold` is processed_events, or another aggregation that keeps the delta's columns. Deltas that are added meanwhile stay; if
    one of the folded batches is replaced meanwhile, the fold is made again. Readers of earlier versions keep their files until
    versions.vacuum(). `by` makes folders within the part, as the batches have them.
    """
    while True:
        now = versions.load(spark, path)
        old = [p for p in now.parts if p.batch_id <= up_to]
        if not old:
            return False
        part = _folded(spark, path, now, old, fold, path, up_to, by)

        def swap(latest: Version) -> Version | None:
            if not {p.folder for p in old} <= {p.folder for p in latest.parts}:  # noqa: B023
                return None
            return replace(latest, parts=(part, *(p for p in latest.parts if p not in old)))  # noqa: B023

        if part.folder in {p.folder for p in versions.commit(spark, path, swap).parts}:
            return True


def compact(deltas: DataFrame, fold, up_to: str, path: str) -> None:
    """Write a new delta table at `path`: batches up to `up_to` folded into one, later ones as they are.

    `deltas` comes from read_deltas. The old table is left alone; readers move to the new path, which is there as a whole
    or not at all. What the folded batches cover goes along.
    """
    spark = deltas.sparkSession
    sources = {name.split("/data/batch_id=")[0] for name in deltas.inputFiles()}
    if len(sources) != 1:
        raise ValueError("compact() takes the rows of one delta table")
    source = sources.pop()
    now = versions.load(spark, source)
    parts = [versions.write_part(versions.read(spark, source, replace(now, parts=(p,))).drop("batch_id"), path, p.batch_id, p.covers, p.folded) for p in now.parts if p.batch_id > up_to]
    old = [p for p in now.parts if p.batch_id <= up_to]
    if old:
        parts.insert(0, _folded(spark, source, now, old, fold, path, up_to))
    versions.commit(spark, path, lambda _: Version(schema=now.schema, parts=tuple(parts), state=now.state))


def next_number(spark: SparkSession, path: str) -> int:
    """The number that the next row of a numbered table gets."""
    return versions.load(spark, path).state.get("next_number", 1)

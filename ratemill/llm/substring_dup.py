"""Repeated passages by relative Lempel-Ziv factors.

The reference is every document, cut into blocks by content: a block is a run of consecutive windows whose smallest
word-gram hash is the same, so equal passages are cut alike wherever they stand. Blocks are indexed by that hash.
Documents are then factored against the index: a block that occurs elsewhere as a whole is taken in one step; at the
boundaries of factors, where a block has no equal, its windows are looked up one by one among the windows of all
indexed blocks. Only windows whose own smallest gram occurs twice can be part of a factor; the rest is never moved.
Factors of at least one window become duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.llm import words
from ratemill.llm.tables import partitions, written

GRAM = 12


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `width` consecutive values."""
    step, out = 1, values
    while step * 2 <= width:
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        step *= 2
    rest = width - step
    return pick(out[: len(out) - rest], out[rest:]) if len(out) > rest else out[:0]


def _least_grams(text: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes by position; the smallest gram of the window at each position; whether a window starts there."""
    found = words.grams(hashes, GRAM)
    least = _sliding(found, window - GRAM + 1, np.minimum)
    return found, least, text[: len(least)] == text[window - 1 :] if len(least) else np.zeros(0, bool)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                data, offsets = words.text_bytes(part.column("text"))
                start, end, text = words.word_bounds(data, offsets)
                found, least, there = _least_grams(text, words.word_hashes(data, start, end), window)
                span = window - GRAM
                # A gram stands for a window if it is no larger than the least gram of some window around it.
                reach = _sliding(np.concatenate((np.zeros(span, np.uint64), np.where(there, least, 0), np.zeros(span, np.uint64))), span + 1, np.maximum)
                at = np.flatnonzero(found <= reach[: len(found)]) if len(reach) else np.zeros(0, np.int64)
                ids = np.asarray(part.column("row"))
                yield pa.RecordBatch.from_arrays([pa.array(found[at].view(np.int64)), pa.array(ids[text[at]], pa.int64())], ["anchor", "row"])

    return run


def _blocks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                data, offsets = words.text_bytes(part.column("text"))
                start, end, text = words.word_bounds(data, offsets)
                hashes = words.word_hashes(data, start, end)
                _, least, there = _least_grams(text, hashes, window)
                at = np.flatnonzero(there)
                own, anchor = text[at].astype(np.uint64), least[at]
                keys, bounds = words.flat(part.column("anchors"))
                owner = np.repeat(np.arange(len(part), dtype=np.uint64), np.diff(bounds))
                wanted = np.unique(words.mix(keys.view(np.uint64) + words.mix(owner)))
                change = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else np.zeros(0, np.int64)
                mine = words.mix(anchor[change] + words.mix(own[change]))
                spot = np.searchsorted(wanted, mine)
                good = np.zeros(len(change), bool)
                inside = spot < len(wanted)
                good[inside] = wanted[spot[inside]] == mine[inside]
                size = np.diff(np.append(change, len(at)))[good]
                change = change[good]
                windows = words.grams(hashes, window)
                first = at[change]
                taken = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
                listed = windows[taken]
                bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
                prints = words.ranges(words.mix(listed), bounds[:-1], bounds[1:]) if len(size) else np.zeros(0, np.uint64)
                ids = np.asarray(part.column("row"))[text[first]]
                firsts = words.spans_of(text, len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(first - firsts[text[first]], pa.int64()), pa.array(size, pa.int64()), pa.array(prints.view(np.int64)), words.list_column(listed.view(np.int64), bounds, pa.int64())],
                    ["row", "at", "size", "print", "windows"],
                )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                data, offsets = words.text_bytes(part.column("text"))
                start, end, text = words.word_bounds(data, offsets)
                firsts = words.spans_of(text, len(part))
                factors = part.column("factors")
                pairs, bounds = factors.values, np.asarray(factors.offsets)
                low, high = int(bounds[0]), int(bounds[-1])
                at, size = (np.asarray(pairs.field(k))[low:high] for k in ("at", "size"))
                owner = np.repeat(np.arange(len(part)), np.diff(bounds))
                edges = np.zeros(len(start) + 1, np.int64)
                np.add.at(edges, firsts[owner] + at, 1)
                np.add.at(edges, firsts[owner] + at + size + window - 1, -1)
                gone = np.cumsum(edges)[:-1] > 0
                removed = np.bincount(text[gone], minlength=len(part))
                # Bytes of kept words, and one blank before each but the first of a text.
                kept = np.flatnonzero(~gone)
                lead = np.concatenate(([True], text[kept][1:] != text[kept][:-1])) if len(kept) else np.zeros(0, bool)
                marks = np.zeros(len(data) + 1, np.int8)
                begin = start[kept] - ~lead
                marks[begin] += 1
                marks[end[kept]] -= 1
                out = data.copy()
                out[begin[~lead]] = 32
                mask = np.cumsum(marks, dtype=np.int8)[:-1] > 0
                where = np.concatenate(([0], np.cumsum(mask)))[offsets]
                out = out[mask].tobytes()
                texts = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(where.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(firsts)), pa.array(removed, pa.int64()), texts],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return run


def duplicate_factors(docs: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, text) dealt by row, and (row, at, size): `size` consecutive windows from word `at` on that start elsewhere too.

    `row` is a hash of id and text, so rows that share an id, or have none, are told apart by their texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    anchors = docs.select("row", "text").mapInArrow(_anchors(window), "anchor long, row long")
    anchors = written(anchors.groupBy("anchor", "row").agg(F.count(F.lit(1)).alias("times")))
    matched = anchors.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")
    wanted = anchors.select("anchor", "row").join(matched, "anchor").groupBy("row").agg(F.collect_list("anchor").alias("anchors"))

    dealt = docs.repartition(partitions(spark), "row")
    placed = dealt.join(wanted, "row").select("row", "text", "anchors")
    placed = written(placed.mapInArrow(_blocks(window), "row long, at long, size long, print long, windows array<long>"))
    index = placed.groupBy("print").agg(
        F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"), F.min("at").alias("at"), F.first("windows").alias("windows")
    )
    index = written(index)
    entries = index.select("print", "copies", "row", "at", F.posexplode("windows").alias("step", "window"))
    repeated = entries.groupBy("window").agg(F.sum("copies").alias("copies")).where("copies > 1").select("window")
    single = entries.where("copies = 1").join(repeated, "window").select("row", (F.col("at") + F.col("step")).alias("at"), F.lit(1).cast("long").alias("size"))
    whole = placed.select("row", "at", "size", "print").join(index.where("copies > 1").select("print"), "print")
    return dealt, whole.select("row", "at", "size").unionAll(single)


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of `docs` (doc_id, text).

    A word goes if some `window` consecutive words around it (words are runs of characters other than space and 09-0D,
    unchanged) start anywhere else too, in the same document or another; all copies go. Null and empty texts and texts
    shorter than a window keep all they have. Every row counts as a document, repeated rows and rows without an id too;
    other columns are ignored.
    """
    dealt, factors = duplicate_factors(docs, window)
    listed = factors.groupBy("row").agg(F.collect_list(F.struct("at", "size")).alias("factors"))
    joined = dealt.join(listed, "row", "left")
    none = F.expr("cast(array() as array<struct<at: bigint, size: bigint>>)")
    joined = joined.select("doc_id", "text", F.coalesce("factors", none).alias("factors"))
    return joined.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")

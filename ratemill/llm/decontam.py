"""Benchmark passages in documents, by the q-gram lemma.

An item with n normalised bytes that stands in a text with at most k edits shares at least (its q-grams - k*q) q-grams
with it, on diagonals (place in text - place in item) no more than k apart. Hits are counted in overlapping bands of
diagonals; bands that reach the bound are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.llm import words

Q, COMMON = 8, 32
#: Bytes of benchmark text that one pass over the documents looks for; more makes more passes.
BLOCK_BYTES = 8 << 20
_KEPT = np.zeros(256, bool)
_KEPT[128:] = True
_KEPT[ord("0") : ord("9") + 1] = True
_KEPT[ord("a") : ord("z") + 1] = True
_FILTER_BITS = 22


def _normal(data: np.ndarray) -> np.ndarray:
    """Places of letters, digits and non-ASCII bytes."""
    return np.flatnonzero(_KEPT[words.LOWER[data]])


def _packed(data: np.ndarray) -> np.ndarray:
    """Each 8 consecutive bytes as one integer."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << words.U(8 * step))
    return x


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * words.U(0x9E3779B97F4A7C15)) >> words.U(64 - _FILTER_BITS)


class Index:
    """The q-grams of a block of items: which items hold a gram, where, and how many hits a band of each item needs."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.ids, self.texts, self.edits, self.needed = [], [], [], []
        grams, item, place = [], [], []
        for number, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            data = words.LOWER[data][_normal(data)]
            if len(data) < Q:
                continue
            found = _packed(data)
            grams.append(found)
            item.append(np.full(len(found), len(self.ids)))
            place.append(np.arange(len(found)))
            self.ids.append(number)
            self.texts.append(data)
            self.edits.append(min(int(rate * len(data)), (len(found) - 1) // Q))
        self.edits = np.array(self.edits, np.int64)
        if not self.ids:
            return
        grams, item, place = np.concatenate(grams), np.concatenate(item), np.concatenate(place)
        _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
        # Grams of very many items are left out of the count, and out of the bound, of items that have enough others.
        rare = times[inverse] <= COMMON
        enough = np.bincount(item, rare, len(self.ids)) - self.edits * Q >= 1
        used = rare | ~enough[item]
        self.needed = np.bincount(item, used, len(self.ids)).astype(np.int64) - self.edits * Q
        order = np.argsort(grams[used], kind="stable")
        self.item, self.place = item[used][order], place[used][order]
        self.grams, self.first, self.times = np.unique(grams[used][order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[_slot(self.grams)] = True
        self.longest = max(map(len, self.texts))


def banded(item: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits (at most `most`) of `item` in `text` on diagonals low .. low + width - 1, and where it stands."""
    steps = np.arange(width)
    padded = np.concatenate((np.zeros(max(0, -low), np.uint8), text[max(0, low) : max(0, low + len(item) + width)]))
    padded = np.concatenate((padded, np.zeros(max(0, len(item) + width - len(padded)), np.uint8)))  # 0 equals no kept byte
    cost, start = np.zeros(width, np.int64), steps + low
    for i in range(len(item)):
        same = cost + (padded[i : i + width] != item[i])
        skip = np.append(cost[1:] + 1, most + 1)
        take = skip < same
        cost, start = np.where(take, skip, same), np.where(take, np.append(start[1:], 0), start)
        # Text bytes beside the item: each place may follow from the cheapest one before it.
        ahead = cost - steps
        least = np.minimum.accumulate(ahead)
        source = np.maximum.accumulate(np.where(ahead == least, steps, 0))
        cost, start = least + steps, start[source]
        if cost.min() > most:
            return None
    best = int(np.argmin(cost))
    return int(cost[best]), int(start[best]), len(item) + low + best


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                yield _hits(part, index)

    return run


def _hits(part: pa.RecordBatch, index: Index) -> pa.RecordBatch:
    columns = list(zip(*_found(part, index), strict=True)) or [()] * 5
    ids = part.column("doc_id").take(pa.array(columns[0], pa.int64()))
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "item_id", "start", "end", "edits"]
    )


def _found(part: pa.RecordBatch, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Row, item_id, start, end and edits of each find in a slice of texts."""
    data, offsets = words.text_bytes(part.column("text"))
    kept = _normal(data)
    text = words.LOWER[data[kept]]
    bounds = np.searchsorted(kept, offsets)
    grams = _packed(text)
    at = np.flatnonzero(index.filter[_slot(grams)])
    spot = np.minimum(np.searchsorted(index.grams, grams[at]), len(index.grams) - 1)
    true = index.grams[spot] == grams[at]
    at, spot = at[true], spot[true]
    doc = np.searchsorted(bounds, at, "right") - 1
    inside = at + Q <= bounds[doc + 1]
    at, spot, doc = at[inside], spot[inside], doc[inside]
    times = index.times[spot]
    total = np.cumsum(times)
    entry = np.repeat(index.first[spot] - (total - times), times) + np.arange(total[-1] if len(total) else 0)
    item = index.item[entry]
    diagonal = np.repeat(at, times) - index.place[entry] + index.longest  # over the whole slice: never negative
    key = ((np.repeat(doc, times) * len(index.ids) + item).astype(np.uint64) << words.U(32)) | diagonal.astype(np.uint64)
    key.sort()
    pair, diagonal = (key >> words.U(32)).astype(np.int64), (key & words.U(0xFFFFFFFF)).astype(np.int64) - index.longest
    item = pair % len(index.ids)
    upto = np.searchsorted(key, key + index.edits[item].astype(np.uint64), "right")
    count = upto - np.arange(len(key))
    good = np.flatnonzero(count >= np.maximum(1, index.needed)[item])
    rows: list[tuple] = []
    done = (-1, 0)  # pair and last diagonal of the latest region found
    for i in good.tolist():
        p, d, k = int(pair[i]), int(diagonal[i]), int(index.edits[item[i]])
        if done[0] == p and d <= done[1]:
            continue
        doc_at, n = p // len(index.ids), p % len(index.ids)
        low, high = int(bounds[doc_at]), int(bounds[doc_at + 1])
        wanted = index.texts[n]
        near, often = np.unique(diagonal[i : upto[i]], return_counts=True)
        top = int(near[np.argmax(often)])
        if low <= top and top + len(wanted) <= high and np.array_equal(text[top : top + len(wanted)], wanted):
            found = (0, top - low, top - low + len(wanted))
        else:
            found = banded(wanted, text[low:high], d - low - k, 3 * k + 1, k)
        if found:
            begin, end = kept[low + max(0, found[1])], kept[min(high, low + found[2]) - 1] + 1
            points = (data[offsets[doc_at] : end] & 0xC0) != 0x80
            first = int(points[: begin - offsets[doc_at]].sum())
            rows.append((doc_at, index.ids[n], first, int(points.sum()), found[0]))
            done = (p, d + k)
    return rows


def _clean(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                keep = np.ones(len(part), bool)
                keep[[r[0] for r in _found(part, index)]] = False
                yield part.filter(pa.array(keep))

    return run


def _indexes(benchmark: DataFrame, rate: float) -> Iterator[Index]:
    """The items in blocks of about BLOCK_BYTES, each small enough for every task."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = Index([(r["item_id"], r["text"]) for r in rows], rate)
        if index.ids:
            yield index


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text, end exclusive), edits: where `benchmark` stands in `docs`.

    Both have their text compared on ASCII letters and digits (in lower case) and non-ASCII bytes only. An item is found
    with at most `rate` edits a byte, fewer where it is too short for the lemma; items of fewer than eight kept bytes, null
    and empty ones are never found. Overlapping finds of one item in one document count once. Rows that repeat an
    id are judged one by one; other columns are ignored. Items reach the tasks in blocks of bounded size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, item_id long, start long, end long, edits long"
    out = docs.sparkSession.createDataFrame([], kind)
    for index in _indexes(benchmark, rate):
        out = out.unionAll(docs.mapInArrow(_scan(index), kind))
    return out


def without_hits(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """The rows of `docs`, with all their columns, in which `benchmark_hits` finds no item; no shuffle, and no id needed."""
    for index in _indexes(benchmark, rate):
        docs = docs.mapInArrow(_clean(index), docs.schema)
    return docs

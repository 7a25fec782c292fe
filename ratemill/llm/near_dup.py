"""Near-duplicate documents by HyperMinHash.

Each set of word shingles becomes 64 registers: the leading-zero count and ten mantissa bits of the smallest
hash of each bucket. Four registers make a band; texts that share a band meet, and stay candidates while the
collision-corrected Jaccard estimate of their registers is within reach of the threshold. Candidate clusters
(the components of what is left) then bring their full sets together, and every pair of a cluster is counted
exactly, in blocks, as a product of 0/1 matrices. Equal sets are one member throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.llm import blocks, words
from ratemill.llm.components import components
from ratemill.llm.tables import written

REGISTERS, MANTISSA, BAND = 64, 10, 4
BANDS = REGISTERS // BAND
#: Registers two sets are allowed to miss the threshold by, as a Jaccard value: over five standard errors.
SLACK = 0.25
#: Expected share of equal registers of unrelated large sets, times 2^MANTISSA (a constant of HyperMinHash).
COLLISIONS = 0.169919487159739
BAND_CHUNK, SET_CHUNK, SET_SHINGLES = 512, 256, 200_000
_TILE = 4 << 20

_rng = np.random.default_rng(8)
_PROBES = np.array([_rng.permutation(REGISTERS) for _ in range(REGISTERS)])


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their bounds."""
    data, offsets = words.text_bytes(batch.column("text"))
    data = words.LOWER[data]
    start, end, text = words.word_bounds(data, offsets)
    hashes = words.word_hashes(data, start, end)
    found = words.grams(hashes, shingle)
    firsts = words.spans_of(text, len(batch))
    lone = np.flatnonzero((np.diff(firsts) > 0) & (np.diff(firsts) < shingle))
    whole = dict(zip(lone.tolist(), words.ranges(hashes, firsts[lone], firsts[lone + 1]), strict=True))
    out, bounds = [], np.zeros(len(batch) + 1, np.int64)
    for i in range(len(batch)):
        here = found[firsts[i] : max(firsts[i], firsts[i + 1] - shingle + 1)]
        here = np.unique(here) if len(here) else np.array([whole[i]] if i in whole else [], np.uint64)
        out.append(here)
        bounds[i + 1] = bounds[i] + len(here)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), bounds


def _registers(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sets, 64) compressed registers with empty buckets filled from others, and which buckets were filled at first."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    bucket = (values >> words.U(58)).astype(np.int64)
    cell = owner * REGISTERS + bucket
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    rest = ((values[first] << words.U(6)) >> words.U(11)).astype(np.float64)  # sorted: the first is the smallest
    part, exponent = np.frexp(rest)
    zeros = 53 - exponent
    code = 1 + (zeros << MANTISSA) + np.maximum(0, (part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    own = np.zeros(n * REGISTERS, np.uint16)
    own[cell[first]] = code
    own = own.reshape(n, REGISTERS)
    dense = own.copy()
    for turn in range(REGISTERS):
        rows, at = np.nonzero(dense == 0)
        if not len(rows):
            break
        dense[rows, at] = own[rows, _PROBES[at, turn]]
    return dense, own > 0


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (distinct shingles), two fingerprints of the set, 16 bands of four registers, the filled buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                values, bounds = _sets(part, shingle)
                dense, filled = _registers(values, bounds)
                sums = np.zeros((2, len(values) + 1), np.uint64)
                np.cumsum(values, out=sums[0, 1:])
                np.cumsum(words.mix(values), out=sums[1, 1:])
                prints = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64)
                bands = np.ascontiguousarray(dense).view(np.int64)
                filled = np.packbits(filled, axis=1, bitorder="little").view(np.int64)[:, 0] if len(part) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(prints[0]), pa.array(prints[1]), words.list_column(bands.ravel(), np.arange(len(part) + 1) * BANDS, pa.int64()), pa.array(filled)],
                    ["doc_id", "n", "print_a", "print_b", "bands", "filled"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print_a long, print_b long, bands array<long>, filled long")


def estimate(a: np.ndarray, b: np.ndarray, filled_a: np.ndarray, filled_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of all pairs of rows of `a` and `b`."""
    equal = np.zeros((len(a), len(b)), np.float32)
    for k in range(REGISTERS):
        both = filled_a[:, k, None] & filled_b[None, :, k]
        equal += (a[:, k, None] == b[None, :, k]) & both
    used = (filled_a.sum(1)[:, None] + filled_b.sum(1)[None, :] - filled_a.astype(np.float32) @ filled_b.T.astype(np.float32))
    ratio = np.maximum(size_a[:, None], size_b[None, :]) / np.minimum(size_a[:, None], size_b[None, :])
    chance = COLLISIONS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2 * used
    return (equal - np.minimum(chance, equal)) / np.maximum(used, 1)


def _bits(filled: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(filled).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)


def _two_sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(side) and side[0] == 2:
        return np.arange(len(side)), np.arange(len(side))
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _edges(linked: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges, by id, of what is linked between two sides of a block."""
    graph = np.zeros((len(ids), len(ids)), bool)
    graph[np.ix_(left, right)] = linked
    graph |= graph.T
    np.fill_diagonal(graph, False)
    a, b = blocks.forest(graph)
    return ids[a], ids[b]


def _candidates(lowest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in blocks.grouped(batches):
            ids, n, side = (np.asarray(batch.column(c)) for c in ("id", "n", "side"))
            bands = words.flat(batch.column("bands"))[0].reshape(-1, BANDS)
            registers, filled = np.ascontiguousarray(bands).view(np.uint16), _bits(np.asarray(batch.column("filled")))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                left, right = _two_sides(side[s:e])
                if e - s < 2 or not len(left) or not len(right):
                    continue
                left, right = left + s, right + s
                linked = estimate(registers[left], registers[right], filled[left], filled[right], n[left], n[right]) >= lowest
                found.append(_edges(linked, left - s, right - s, ids[s:e]))
            yield _pairs(found)

    return run


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def intersections(values: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets `left` with the sets `right`, exactly."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    distinct, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], number[code[keep]]
    width, total = max(1, _TILE // (len(bounds) - 1)), int(shared.sum())
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(left), len(right)))
    for at in range(0, total, width):
        low, high = np.searchsorted(code, (at, at + width))
        tile = np.zeros((len(bounds) - 1, min(width, total - at)), np.float32)
        tile[owner[low:high], code[low:high] - at] = 1
        out += tile[left] @ tile[right].T
    return out


def _verified(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in blocks.grouped(batches):
            ids, side = np.asarray(batch.column("id")), np.asarray(batch.column("side"))
            values, sets = words.flat(batch.column("shingles"))
            found = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                left, right = _two_sides(side[s:e])
                if e - s < 2 or not len(left) or not len(right):
                    continue
                own = sets[s : e + 1] - sets[s]
                common = intersections(values[sets[s] : sets[e]], own, left, right)
                n = np.diff(own)
                union = n[left][:, None] + n[right][None, :] - common
                found.append(_edges(100 * common >= percent * union, left, right, ids[s:e]))
            yield _pairs(found)

    return run


def _shingled(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                values, bounds = _sets(part, shingle)
                columns = [part.column(c) for c in ("id", "cluster", "members", "shingled")]
                yield pa.RecordBatch.from_arrays([*columns, words.list_column(values.view(np.int64), bounds, pa.int64())], ["id", "cluster", "members", "shingled", "shingles"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: which documents are near copies of which.

    Documents link where 100 * |intersection| >= `percent` * |union| of their sets of `shingle`-word shingles (A-Z
    lower-cased; a text with fewer words is one shingle). component_id is the smallest doc_id reachable by links; kept
    marks it. Null and empty texts and texts of blanks have no shingle and link with nothing. doc_id must be unique;
    other columns are ignored. Tables may be empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(signatures(docs, shingle))
    members = signed.where("n > 0").groupBy("print_a", "print_b", "n")
    classes = written(members.agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("filled").alias("filled")))

    banded = classes.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = banded.join(crowded, "bucket").join(classes.select("id", "n", "bands", "filled"), "id")
    dealt = blocks.dealt(met, "bucket", "id", F.ceil(F.col("members") / BAND_CHUNK))
    likely = dealt.select("block", "side", "id", "n", "bands", "filled").mapInArrow(_candidates(percent / 100 - SLACK), "a long, b long")
    clusters = components(likely).withColumnRenamed("component", "cluster")

    sized = clusters.join(classes.select("id", "n"), "id")
    sizes = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingled"))
    sized = clusters.join(sizes, "cluster")
    texts = docs.join(sized, docs["doc_id"] == sized["id"]).select("id", "cluster", "members", "shingled", "text")
    sets = texts.mapInArrow(_shingled(shingle), "id long, cluster long, members long, shingled long, shingles array<long>")
    chunks = F.ceil(F.greatest(F.col("members") / SET_CHUNK, F.col("shingled") / SET_SHINGLES))
    chunks = F.least(chunks, F.col("members"))
    dealt = blocks.dealt(sets, "cluster", "id", chunks).select("block", "side", "id", "shingles")
    found = components(dealt.mapInArrow(_verified(shingle, percent), "a long, b long"))

    ids = classes.select("print_a", "print_b", "n", "id").join(found, "id", "left")
    ids = ids.select("print_a", "print_b", "n", F.coalesce("component", "id").alias("component_id"))
    out = signed.join(ids, ["print_a", "print_b", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))

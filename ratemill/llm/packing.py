"""Packing token pieces into sequences by bin completion.

Only the histogram of piece lengths matters for a packing, and it has no more entries than a sequence has tokens. The
plan is made on it: the longest piece left is completed with an undominated filling of the room beside it, the pattern
is used as often as the histogram allows, and the search backs up while the waste so far can still beat the best known
packing (at first, the one of best fit). Pieces then find their places in parallel, by their rank within a length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratemill.llm import words
from ratemill.llm.tables import partitions, written
from ratemill.llm.tokens import VOCABULARY, _encoder, text_ids, vocabulary_path

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], room: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, on a histogram: each length goes to the sequences with the least room that holds it."""
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            spot = min((r for r, groups in open_.items() if r >= length and groups), default=None)
            if spot is None:
                each = min(room // length, left)
                times = left // each
                open_[room - each * length].append(((length,) * each, times))
                left -= each * times
                continue
            pattern, times = open_[spot].pop()
            used = min(times, left)
            if times > used:
                open_[spot].append((pattern, times - used))
            open_[spot - length].append(((*pattern, length), used))
            left -= used
    return [x for groups in open_.values() for x in groups]


def fillings(counts: np.ndarray, room: int, most: int, spare: int) -> list[Pattern]:
    """Undominated fillings of `room` from a histogram: least waste first (at most `spare`), then longest pieces first.

    Every filling takes the longest pieces that still reach its total, so none can be had from it by merging pieces.
    """
    lengths = np.flatnonzero(counts[: room + 1])
    reach = [1]  # bit t: total t can be reached with the lengths so far
    for x in lengths.tolist():
        bits, left, step = reach[-1], min(int(counts[x]), room // x), 1
        while left:
            step = min(step, left)
            bits |= bits << (x * step)
            left -= step
            step *= 2
        reach.append(bits & ((1 << (room + 1)) - 1))
    out: list[Pattern] = []
    total = reach[-1].bit_length() - 1
    while total >= 0 and room - total <= spare and len(out) < most:
        if reach[-1] >> total & 1:
            tops = [k for k in range(len(lengths) - 1, -1, -1) if lengths[k] <= total and reach[k + 1] >> total & 1]
            seen: set[int] = set()
            for top in tops:
                filling, at, left = [], top, total
                while left:
                    x = int(lengths[at])
                    # As many of this length as leave a total that shorter ones reach.
                    n = next((n for n in range(min(int(counts[x]), left // x), -1, -1) if reach[at] >> (left - n * x) & 1), 0)
                    filling += [x] * n
                    left -= n * x
                    at -= 1
                lead = filling[0] if filling else 0
                if lead not in seen:
                    seen.add(lead)
                    out.append(tuple(filling))
                if len(out) == most or total == 0:
                    break
        total -= 1
    return out or [()]


def plan(histogram: dict[int, int], room: int, nodes: int = 1_500, widths: tuple[int, ...] = (1, 3, 12, 50)) -> list[tuple[Pattern, int]]:
    """(pattern, times) that use up the histogram in as few sequences as the search finds.

    Searches follow each other, each with more fillings per node (`widths`) than the one before, until the lower bound is met. Each
    starts from the best packing so far and ends after `nodes` completions; what stands then is not proved to be the best. A search holds one
    histogram and one list of fillings per level.
    """
    histogram = {k: v for k, v in histogram.items() if v}
    bound = lower_bound(histogram, room)
    best = best_fit(histogram, room)
    for width in widths:
        if sum(n for _, n in best) > bound:
            best = _search(histogram, room, best, bound, nodes, width)
    return best


def lower_bound(histogram: dict[int, int], room: int) -> int:
    """No packing has fewer sequences (Martello and Toth's bound, from every threshold).

    Pieces over half a sequence stand in one each; beside those over room - t no piece of t or more fits, so pieces from t to half
    a sequence have to fit beside the others or into further sequences.
    """
    counts = np.zeros(room + 1, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    number = np.concatenate(([0], np.cumsum(counts)))  # pieces shorter than k
    tokens = np.concatenate(([0], np.cumsum(counts * np.arange(room + 1))))
    half = room // 2 + 1
    best = 0
    for t in range(1, half + 1):
        large = int(number[room + 1] - number[half])
        beside = int(number[room - t + 1] - number[half]) if room - t + 1 > half else 0
        spare = beside * room - int(tokens[room - t + 1] - tokens[half]) if beside else 0
        small = int(tokens[half] - tokens[t])
        best = max(best, large + max(0, -(-(small - spare) // room)))
    return best


def _search(histogram: dict[int, int], room: int, best: list[tuple[Pattern, int]], bound: int, nodes: int, branches: int) -> list[tuple[Pattern, int]]:
    total = sum(k * v for k, v in histogram.items())
    fewest = sum(n for _, n in best)
    counts = np.zeros(room + 1, np.int64)
    for k, v in histogram.items():
        counts[k] = v

    def opened(counts: np.ndarray, made: tuple | None, used: int, waste: int) -> tuple:
        """A node: the histogram left, the patterns up to here (linked), sequences used, waste so far, fillings still to try, the best last."""
        longest = int(np.flatnonzero(counts)[-1])
        rest = counts.copy()
        rest[longest] -= 1
        spare = max((fewest - 1) * room - total - waste, 0)
        return counts, made, used, waste, [(longest, *f) for f in reversed(fillings(rest, room - longest, branches, spare))]

    stack = [opened(counts, None, 0, 0)] if total else []
    while stack and fewest > bound and nodes:
        counts, made, used, waste, patterns = stack[-1]
        allowed = (fewest - 1) * room - total
        if not patterns or waste > allowed:
            stack.pop()
            continue
        pattern = patterns.pop()
        need = Counter(pattern)
        times = min(int(counts[k]) // n for k, n in need.items())
        lost = room - sum(pattern)
        if lost:
            times = max(1, min(times, max(allowed - waste, 0) // lost))
        if waste + lost * times > allowed:
            continue
        after = counts.copy()
        for k, n in need.items():
            after[k] -= n * times
        done = (pattern, times, made)
        if after.any():
            nodes -= 1
            stack.append(opened(after, done, used + times, waste + lost * times))
        else:
            fewest, best = used + times, []
            while done:
                best.append(done[:2])
                done = done[2]
    return best


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces of this length in the pattern, offset of the first)."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, n in sorted(Counter(pattern).items(), reverse=True):
            out[length].append((rank[length], sequence, n, offset))
            rank[length] += n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _pieces(path: str, room: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, units = _encoder(path)
            for part in words.slices(batch, "text"):
                ids, bounds = text_ids(units, *words.text_bytes(part.column("text")))
                ids = np.insert(ids, bounds[1:], end).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                size = np.diff(bounds)
                first = np.where(size <= room, size, (size - 1) % room + 1)
                n = (size - first) // room + 1
                owner = np.repeat(np.arange(len(part)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * room)
                length = np.where(piece == 0, first[owner], room)
                raw = memoryview(ids.tobytes())
                at = 4 * (bounds[owner] + start)
                checks = [zlib.crc32(raw[s:e]) for s, e in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                doc = part.column("doc_id").take(pa.array(owner))
                columns = [doc, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(checks, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _placed(spots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                spot = spots[size][np.searchsorted(spots[size][:, 0], rank[rows], "right") - 1]
                turn = rank[rows] - spot[:, 0]
                sequence[rows] = spot[:, 1] + turn // spot[:, 2]
                offset[rows] = spot[:, 3] + turn % spot[:, 2] * size
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, room: int = 1024, vocabulary: str = VOCABULARY, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of `docs` (doc_id, text), one row per piece.

    A document is the ids of its whole text, then id `end`; null and empty texts are that id alone. Documents of more
    than `room` ids are cut into pieces of `room`, the first possibly shorter. Sequences are gapless from offset 0; equal
    lengths are placed in the order of a hash, doc_id and piece. Rows that repeat a doc_id are packed all the same;
    other columns are ignored. An empty table gives no rows.

    The driver sees one count per length, `room` at most, and sends as many patterns to the tasks as lengths ran out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = written(docs.mapInArrow(_pieces(vocabulary_path(vocabulary), room, end), kind))
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spots = places(plan(histogram, room))

    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark))).alias("share")
    shared = pieces.select("*", share)
    sizes = shared.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")
    sizes = sizes.select("length", "share", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = shared.withColumn("own", own).join(sizes, ["length", "share"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_placed(spots), f"{kind}, sequence_id long, offset long")

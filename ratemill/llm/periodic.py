"""Periodic runs of words, and texts with the repeats taken out.

A run is a stretch of words with a smallest period q that no neighbouring word extends, at least `exponent` periods and
`least` words long. For each q, a run holds a point x of a grid of step max(least, exponent * q) - q together with x + q; the
grids of all q have a harmonic number of points. Where the two words agree, the run's ends are the longest common
extensions of x and x + q to the right and, on the reversed words, to the left.

Extensions: a few words are compared one by one. Where they all agree, some offset among them brings both positions onto a
difference cover, whose suffixes alone are sorted (by blocks of V words, then by doubling); the least of the common
prefixes between two places of that order, from a sparse table, is the rest of the answer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.llm import words

#: A perfect difference set: every difference modulo 31 but 0 is that of exactly one pair.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
_SLOT = np.full(V, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))
#: Offset, by residues of two positions, that brings both onto the cover.
_SYNC = np.array([[min(d for d in range(V) if (a + d) % V in COVER and (b + d) % V in COVER) for b in range(V)] for a in range(V)])
#: Words whose documents share one index, and pairs that are followed at a time.
_INDEXED, _PAIRS = 1 << 20, 1 << 20


def _agree(t: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """How many words agree from x and y (x < y) on, up to `most`."""
    out, alive = np.zeros(len(x), np.int64), np.arange(len(x))
    for k in range(most):
        alive = alive[y[alive] + k < len(t)]
        alive = alive[t[x[alive] + k] == t[y[alive] + k]]
        if not len(alive):
            break
        out[alive] = k + 1
    return out


class CommonExtensions:
    """Longest common extensions of positions in `t`, in constant time each after sorting the cover's suffixes."""

    def __init__(self, t: np.ndarray):
        rank = np.unique(t, return_inverse=True)[1].astype(">u4") + np.uint32(1)
        padded = np.concatenate((rank.astype(">u4"), np.zeros(V, ">u4")))  # 0 stands behind the end
        places = (np.arange(-(-len(t) // V))[:, None] * V + np.array(COVER)).ravel()
        places = places[places < len(t)]
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, V)[places]).view(f"S{4 * V}").ravel()
        m, step, levels = len(places), len(COVER), []
        order = np.argsort(blocks, kind="stable")
        fresh = blocks[order[1:]] != blocks[order[:-1]]
        while True:
            at = np.empty(m, np.int64)
            at[order] = np.concatenate(([0], np.cumsum(fresh)))[:m]
            levels.append(at)
            if not m or at[order[-1]] == m - 1:
                break
            after = np.zeros(m, np.int64)
            after[: max(0, m - step)] = at[step:] + 1
            keys = at * (m + 1) + after
            order = np.argsort(keys, kind="stable")
            fresh = keys[order[1:]] != keys[order[:-1]]
            step *= 2
        # Common prefixes of neighbours in the order: whole blocks by equal ranks, the longest first, then single words.
        i, j, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, m - 1), np.int64)
        for k in reversed(range(len(levels))):
            inside = np.flatnonzero((i < m) & (j < m))
            same = inside[levels[k][i[inside]] == levels[k][j[inside]]]
            i[same] += len(COVER) << k
            j[same] += len(COVER) << k
            lcp[same] += V << k
        first, second = places[order[:-1]] + lcp, places[order[1:]] + lcp
        lcp += _agree(t, np.minimum(first, second), np.maximum(first, second), V)
        self.at, self.table = levels[-1], [lcp]
        while 2 << (len(self.table) - 1) <= len(lcp):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def from_agreed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The common extension of x and y, of which V words are known to agree."""
        out = _SYNC[x % V, y % V]
        a, b = (self.at[(p + out) // V * len(COVER) + _SLOT[(p + out) % V]] for p in (x, y))
        low, high = np.minimum(a, b), np.maximum(a, b)  # the least of lcp[low:high]
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        least = np.empty(len(x), np.int64)
        for k in np.unique(level):
            these = np.flatnonzero(level == k)
            least[these] = np.minimum(self.table[k][low[these]], self.table[k][high[these] - (1 << int(k))])
        return out + least


def find_runs(hashes: np.ndarray, bounds: np.ndarray, least: int = 24, exponent: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and period of all runs, by text, start and period; text i is `hashes[bounds[i]:bounds[i + 1]]`."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")  # long texts first: those with room for a period are a prefix
    edges = np.concatenate(([0], np.cumsum(sizes[order])))
    text = np.repeat(np.arange(len(order)), sizes[order])
    t = hashes[np.repeat(bounds[:-1][order] - edges[:-1], sizes[order]) + np.arange(len(hashes))]
    t = words.mix(t + words.mix(text.astype(np.uint64)))  # words of two texts never agree
    xs, qs, q = [], [], 1
    while True:
        need = max(least, exponent * q)
        room = int(edges[np.searchsorted(-sizes[order], -need, "right")])
        if not room:
            break
        hit = np.flatnonzero(t[0 : room - q : need - q] == t[q : room : need - q])
        if len(hit):
            xs.append(hit * (need - q))
            qs.append(np.full(len(hit), q))
        q += 1
    if not xs:
        return (np.zeros(0, np.int64),) * 4
    x, q = np.concatenate(xs), np.concatenate(qs)
    reverse, n = t[::-1], len(t)
    ahead, back = (np.concatenate([find(x[k : k + _PAIRS], q[k : k + _PAIRS]) for k in range(0, len(x), _PAIRS)]) for find in (lambda x, q: _agree(t, x, x + q, V), lambda x, q: _agree(reverse, n - x - q, n - x, V)))
    longer = np.flatnonzero((ahead == V) | (back == V))
    for group in _groups(np.unique(text[x[longer]]), np.diff(edges)):
        low, high = edges[group[0]], edges[group[-1] + 1]
        spots = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in group])
        place = np.full(high - low, -1)
        place[spots - low] = np.arange(len(spots))
        inside = longer[(x[longer] >= low) & (x[longer] < high)]
        inside = inside[place[x[inside] - low] >= 0]
        m = len(spots)
        for which, index in ((ahead, CommonExtensions(t[spots])), (back, CommonExtensions(t[spots][::-1]))):
            mine = inside[which[inside] == V]
            for k in range(0, len(mine), _PAIRS):
                these = mine[k : k + _PAIRS]
                here = place[x[these] - low]
                which[these] = index.from_agreed(here, here + q[these]) if which is ahead else index.from_agreed(m - here - q[these], m - here)
    start, length = x - back, back + q + ahead
    whole = np.flatnonzero(length >= np.maximum(least, exponent * q))
    start, length, q = start[whole], length[whole], q[whole]
    by = np.lexsort((q, length, start))  # a stretch that several periods describe has the smallest
    start, length, q = start[by], length[by], q[by]
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))[: len(start)]
    start, length, q = start[first], length[first], q[first]
    owner = order[text[start]]
    start = start - edges[text[start]]
    by = np.lexsort((q, start, owner))
    return owner[by], start[by], length[by], q[by]


def _groups(texts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """`texts` in runs of about _INDEXED words, or one longer text."""
    total = np.cumsum(sizes[texts])
    at = 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + _INDEXED, "right")))
        yield texts[at:to]
        at = to


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of the words `data[start:end]`, joined by one space; text i has the words bounds[i] to bounds[i + 1]."""
    blank = np.ones(len(start), np.int64)
    blank[bounds[:-1][np.diff(bounds) > 0]] = 0
    size = end - start
    place = np.concatenate(([0], np.cumsum(size + blank)))
    out = np.full(int(place[-1]), 32, np.uint8)
    at, done = 0, np.concatenate(([0], np.cumsum(size)))
    while at < len(start):  # blocks of bounded bytes, but for single longer words
        to = max(at + 1, int(np.searchsorted(done, done[at] + (1 << 20), "right")) - 1)
        step = np.arange(done[to] - done[at])
        shift = done[at:to] - done[at]
        out[np.repeat(place[at:to] + blank[at:to] - shift, size[at:to]) + step] = data[np.repeat(start[at:to] - shift, size[at:to]) + step]
        at = to
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(place[bounds].astype(np.int64)), pa.py_buffer(out.tobytes())).cast(pa.string())


def _read(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                data, offsets = words.text_bytes(part.column("text"))
                start, end, text = words.word_bounds(data, offsets)
                bounds = words.spans_of(text, len(part))
                owner, first, length, period = find_runs(words.word_hashes(data, start, end), bounds, least, exponent)
                marks = np.zeros(len(start) + 1, np.int64)
                np.add.at(marks, bounds[owner] + first + period, 1)
                np.add.at(marks, bounds[owner] + first + length, -1)
                kept = np.flatnonzero(np.cumsum(marks)[:-1] == 0)
                runs = pa.StructArray.from_arrays([pa.array(first), pa.array(length), pa.array(period)], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(words.spans_of(owner, len(part)), pa.int32()), runs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds)), listed, joined(data, start[kept], end[kept], words.spans_of(text[kept], len(part)))],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = 24, exponent: int = 3) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of `docs` (doc_id, text).

    Words are runs of characters other than space and 09-0D, unchanged, numbered from 0, compared by 64-bit hashes. `runs` lists
    start, length and smallest period of every run of at least `least` words and `exponent` periods, by start, then period.
    `collapsed` has the words that no run holds behind its first period, joined by one space.

    Null and empty texts have no words and no runs; their collapsed text is empty. Each row is a document of its own, repeated
    rows and rows without an id too; other columns are ignored. A text is read whole by one task, whose index takes some hundred bytes a word.
    """
    if least <= exponent or exponent < 2:
        raise ValueError("runs need an exponent of 2 at least and more words than that")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(_read(least, exponent), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _repeat_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "text"):
            drawn = np.array([1 if i is None else zlib.crc32(b"%d" % i) for i in part.column("doc_id").to_pylist()], np.int64)
            data, offsets = words.text_bytes(part.column("text"))
            start, end, text = words.word_bounds(data, offsets)
            bounds = words.spans_of(text, len(part))
            n, rest = np.diff(bounds), drawn // 10
            tail = np.where((drawn % 10 == 0) & (n > 0), rest % np.maximum(n, 1), n)  # words from here on repeat
            period = 1 + (n - tail) // (3 + rest % 8)
            place = np.arange(len(start)) - bounds[text]
            over = np.maximum(place - tail[text], 0)
            source = bounds[text] + np.minimum(place, tail[text]) + over % period[text]
            source = np.where(place < tail[text], np.arange(len(start)), source)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), joined(data, start[source], end[source], bounds)], ["doc_id", "text"])


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of each text joined by one space; in a tenth of the documents, drawn by id, the tail is periodic.

    With h = crc32 of the decimal doc_id and g = floor(h / 10), a document of n words has h divisible by 10; word i >= a is replaced
    by word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). A document without an id stays as it is.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(_repeat_tails, "doc_id long, text string")

"""Whitened embeddings from an exact integer scatter matrix.

Entries become integers (64 steps a unit). Each dimension is shifted to start at 0 and cut into bit planes; a plane's bits of
64 rows are one word. The population count of two planes ANDed, weighted by their places, is an exact share of the
cross-product of their dimensions, so tasks emit plain counts, Spark adds them up, and nothing is rounded or overflows,
whatever the number of rows. The scatter is centred in integers (n times cross-product less product of sums) and only
then turned into doubles for `eigh`. Tasks emit, and the driver sees, sums per pair of dimensions, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, LIFT = 64, 1_000_000
#: Entries beyond this many steps count as this many, so that every x is a long.
LARGEST = 2.0**62
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _vectors(batch: pa.RecordBatch, wide: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer rows of the vectors of each length (or of `wide` entries) without null or non-finite ones."""
    column = batch.column("embedding")
    widths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for width in [wide] if wide is not None else np.unique(widths):
        if width == 0:
            continue
        some = pa.array(widths == width)
        values = column.filter(some).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, int(width))
        whole = np.isfinite(values).all(axis=1)
        with np.errstate(over="ignore"):
            steps = np.clip(values[whole] * STEPS, -LARGEST, LARGEST)
        if len(steps):
            yield batch.column("vec_id").filter(some).filter(pa.array(whole)), np.floor(steps).astype(np.int64) + LIFT


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, least and greatest entry of each dimension, by length of vector; one set of rows per task."""
    seen: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for _, x in _vectors(batch):
            n, low, high = seen.get(x.shape[1], (0, x[0], x[0]))
            seen[x.shape[1]] = n + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    for wide, (n, low, high) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(wide, wide)), pa.array(np.arange(wide)), pa.array(np.full(wide, n)), pa.array(low), pa.array(high)], ["wide", "at", "n", "low", "high"])


def _counts(low: np.ndarray, planes: int):
    """Counts of rows by (dimension i, dimension j >= i, place): rows whose planes p of i and q of j, p + q = place, are both set.

    Behind the last dimension, j stands for one whose entries are all 1: its counts give the sums.
    """
    wide = len(low)
    most = max(64, (1 << 22) // wide // 64 * 64)

    def add(total: np.ndarray, x: np.ndarray) -> None:
        shifted = (x - low).view(np.uint64).T  # differences of longs as unsigned words: exact over the whole range
        words = np.zeros((wide, planes, -(-len(x) // 64) * 8), np.uint8)
        for p in range(planes):
            bits = np.packbits((shifted >> np.uint64(p)).astype(np.uint8) & 1, axis=1)
            words[:, p, : bits.shape[1]] = bits
        words = words.view(np.uint64)
        for i in range(wide):
            for p in range(planes):
                both = np.bitwise_count(words[i:] & words[i, p])
                total[i, i:wide, p : p + planes] += both.sum(axis=2, dtype=np.int64)
                total[i, wide, p] += np.bitwise_count(words[i, p]).sum(dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros((wide, wide + 1, 2 * planes - 1), np.int64), [], 0
        for batch in batches:
            for _, x in _vectors(batch, wide):
                while len(x):
                    part, x = x[: most - size], x[most - size :]
                    held.append(part)
                    size += len(part)
                    if size == most:
                        add(total, np.concatenate(held))
                        held, size = [], 0
        if held:
            add(total, np.concatenate(held))
        i, j, place = np.nonzero(total)
        for at in range(0, len(i), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(i[cut]), pa.array(j[cut]), pa.array(place[cut]), pa.array(total[i[cut], j[cut], place[cut]])], ["i", "j", "place", "rows"])

    return run


def scatter(vectors: DataFrame) -> tuple[int, list[int], list[list[int]], np.ndarray, np.ndarray] | None:
    """n, the sums S of each dimension, n * sum(x_i x_j) - S_i S_j, least and greatest entries; Python integers, all exact.

    None if there is no vector. Of vectors of several lengths those of the commonest count, of equally common ones the longest.
    """
    vectors = vectors.select("vec_id", "embedding")
    kinds = vectors.mapInArrow(_ranges, "wide long, at long, n long, low long, high long")
    kinds = kinds.groupBy("wide", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    common = kinds.where("at = 0").orderBy(F.desc("n"), F.desc("wide")).limit(1).collect()
    if not common:
        return None
    n, wide = common[0]["n"], common[0]["wide"]
    ends = sorted((r["at"], r["low"], r["high"]) for r in kinds.where(F.col("wide") == wide).collect())
    low, high = ([e[k] for e in ends] for k in (1, 2))
    planes = max(1, max(h - l for l, h in zip(low, high, strict=True)).bit_length())
    counts = vectors.mapInArrow(_counts(np.array(low, np.int64), planes), "i long, j long, place long, rows long")
    counts = counts.groupBy("i", "j", "place").agg(F.sum("rows").alias("rows"))
    cross = [[0] * (wide + 1) for _ in range(wide)]
    for r in counts.toLocalIterator():
        cross[r["i"]][r["j"]] += r["rows"] << r["place"]
    sums = [cross[i][wide] for i in range(wide)]
    centred = [[n * cross[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(wide)] for i in range(wide)]
    return n, [s + n * l for s, l in zip(sums, low, strict=True)], centred, np.array(low), np.array(high)


def _axes(centred: list[list[int]], n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, their unit eigenvectors as columns (largest entry positive), shares of the trace."""
    square = n * n
    covariance = np.array([[value / square for value in row] for row in centred])  # each quotient of integers is rounded once
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    trace = sum(centred[i][i] for i in range(len(centred))) / square
    flat = values <= trace * len(centred) * np.finfo(float).eps  # no variance beyond rounding
    return np.where(flat, 0.0, values), axes, np.where(flat, 0.0, values / trace) if trace else np.full(len(values), np.nan)


class _Fit:
    """What every task needs: sums of dimensions and the axes, a few numbers per pair of dimensions."""

    def __init__(self, n: int, sums: list[int], centred: list[list[int]], low: np.ndarray, high: np.ndarray, components: int):
        self.n, self.sums, self.wide = n, sums, len(sums)
        self.values, self.axes, self.explained = _axes(centred, n, components)
        reach = max(abs(n * int(v) - s) for ends in (low, high) for v, s in zip(ends, sums, strict=True))
        self.short = n * max(abs(int(v)) for ends in (low, high) for v in ends) < 1 << 63 and reach < 1 << 62
        self.square = self.wide * reach * reach < 1 << 63
        with np.errstate(divide="ignore"):
            self.scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), np.nan)

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs if they are wide enough, else Python's integers."""
        if self.short:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, far: np.ndarray) -> np.ndarray:
        return (far / self.n).astype(np.float64) @ self.axes * self.scale

    def deviation(self, far: np.ndarray) -> pa.Array:
        if self.square:
            return pa.array((far * far).sum(axis=1))
        total = (far.astype(object) ** 2).sum(axis=1)
        return pa.array([int(t) if t < 1 << 63 else None for t in total], pa.int64())


def _products(fit: _Fit):
    """Sums of whitened values (j = -1) and of their products, one set of rows per task."""
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _vectors(batch, fit.wide):
                w = fit.whitened(fit.from_mean(x))
                sums += w.sum(axis=0)
                total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, np.arange(k))), pa.array(np.append(j, np.full(k, -1))), pa.array(np.append(total[i, j], sums))], ["i", "j", "total"])

    return run


def _placed(fit: _Fit, error: float | None):
    k = len(fit.values)
    explained = [None if np.isnan(e) else float(e) for e in fit.explained]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _vectors(batch, fit.wide):
                m, far = len(x), fit.from_mean(x)
                each = pa.array(np.repeat(np.arange(m), k))
                values = pa.array(fit.whitened(far).ravel(), from_pandas=True)  # an axis without variance has no value
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), m)
                share = pa.array(explained, pa.float64()).take(pa.array(number - 1))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each).cast(pa.int64()), pa.array(number), pa.array(np.full(m * k, fit.n)), fit.deviation(far).take(each), values, share, pa.array([error] * (m * k), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """One row per vector of `vectors` (vec_id, embedding) and principal component, numbered from 1 by falling variance.

    Columns: vec_id, component, n (vectors fitted), deviation (sum over dimensions of (n * x - S)^2 for the integer entries x
    and their sums S; null where that is beyond a long), whitened (x less the mean, on the component, over its standard deviation),
    explained (the component's part of the variance) and identity_error (largest absolute entry of the covariance of
    `whitened`, measured over all rows, less the identity).

    Null vectors, empty ones and those with null or non-finite entries are left out; so are, in a table of vectors of several
    lengths, all but those of the commonest (the longest of equally common ones). Entries beyond 2^62 steps of 1/64 count as that many.
    Every row counts, whether its vec_id is missing or stands twice. A component without variance (fewer rows than
    dimensions, constant dimensions) has a null `whitened` and explains 0; if nothing varies, `explained` and identity_error
    are null. An empty table gives no rows. Other columns are ignored.
    """
    vectors = vectors.select("vec_id", "embedding")
    found = scatter(vectors)
    if found is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    fit = _Fit(*found, components)
    made = vectors.mapInArrow(_products(fit), "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = {(r["i"], r["j"]): r["total"] / fit.n for r in made}
    real = np.flatnonzero(fit.values > 0).tolist()
    errors = [abs(total[i, j] - total[i, -1] * total[j, -1] - (i == j)) for i in real for j in real if i <= j]
    return vectors.mapInArrow(_placed(fit, max(errors, default=None)), RESULT)

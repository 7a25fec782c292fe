"""Near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions and each projection is quantised with a random shift; the
quantised values of one table's directions form its bucket. Close vectors share a bucket in some table. Members of
a bucket are compared exactly (cosine in double precision) in blocks of bounded size; a pair counts in the first
table where it meets, so counts add up without a list of pairs.
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

CHUNK = 512


def _unit(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Vectors of one length, scaled to length one."""
    values, _ = words.flat(batch.column(column))
    matrix = values.astype(np.float64).reshape(len(batch), -1)
    # The largest component first: squares of huge or tiny components neither overflow nor vanish.
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _hashed(tables: int, directions: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("vector").offsets))
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                if size not in drawn:
                    rng = np.random.default_rng(seed)
                    drawn[size] = rng.standard_normal((size, tables * directions)), rng.uniform(0, width, tables * directions)
                planes, shift = drawn[size]
                cells = np.floor((_unit(part, "vector") @ planes + shift) / width).astype(np.int64).view(np.uint64)
                cells = words.mix(cells + words.mix(np.arange(1, tables * directions + 1, dtype=np.uint64))[None, :])
                keys = words.mix(cells.reshape(len(part), tables, directions).sum(axis=2, dtype=np.uint64)).view(np.int64)
                bounds = np.arange(len(part) + 1) * tables
                yield pa.RecordBatch.from_arrays([part.column("id"), words.list_column(keys.ravel(), bounds, pa.int64())], ["id", "keys"])

    return run


def _compared(least: float, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in blocks.grouped(batches):
            ids, side, copies, table = (np.asarray(batch.column(c)) for c in ("id", "side", "copies", "table"))
            keys = words.flat(batch.column("keys"))[0].reshape(-1, tables)
            sizes = np.diff(np.asarray(batch.column("vector").offsets))
            alike = bool((sizes == sizes[0]).all())
            unit = _unit(batch, "vector") if alike else None
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                own = side[s] == 2
                groups = [np.arange(s, e)] if alike else [s + np.flatnonzero(sizes[s:e] == z) for z in np.unique(sizes[s:e])]
                for here in groups:  # vectors of two lengths are no pair, even if they share a bucket by chance
                    left, right = (here, here) if own else (here[side[here] == 0], here[side[here] == 1])
                    if not len(left) or not len(right) or (own and len(here) < 2):
                        continue
                    if alike:
                        linked = unit[left] @ unit[right].T >= least
                    else:
                        block = _unit(batch.take(pa.array(here)), "vector")
                        linked = block[np.searchsorted(here, left)] @ block[np.searchsorted(here, right)].T >= least
                    if own:
                        np.fill_diagonal(linked, False)
                    a, b = np.nonzero(linked)
                    for k in range(tables):  # a pair counts in the first table where it meets
                        earlier = (table[left[a]] > k) & (keys[left[a], k] == keys[right[b], k])
                        linked[a[earlier], b[earlier]] = False
                    counts = np.zeros(e - s, np.int64)
                    np.add.at(counts, left - s, linked @ copies[right])
                    if not own:
                        np.add.at(counts, right - s, linked.T @ copies[left])
                    graph = np.zeros((e - s, e - s), bool)
                    graph[np.ix_(left - s, right - s)] = linked
                    x, y = blocks.forest(graph | graph.T)
                    some = np.flatnonzero(counts)
                    out.append((ids[s:e][some], ids[s:e][some], counts[some]))
                    out.append((ids[s:e][x], ids[s:e][y], np.zeros(len(x), np.int64)))
            a, b, n = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "links"])

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.95, tables: int = 20, directions: int = 16, width: float = 2.5, seed: int = 1
) -> DataFrame:
    """vec_id, n_links, component_id, kept of `vectors` (vec_id, embedding).

    Links are pairs with cosine >= `least` that share a bucket of some table; with the given values a pair at cosine
    0.95 is missed once in sixty times, closer pairs more rarely. Vectors that are null, empty, zero or hold a null,
    NaN or infinite component link with nothing: 0 links, their own component. Equal vectors are compared once and
    count as so many. Vectors of different lengths are no pair. Every row is a vector, whether its vec_id is missing or stands twice: n_links
    counts rows; the component is the smallest vec_id that is not missing, null if all are, and `kept` says that vec_id is that
    one or both are null. Other columns are ignored.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    # NaN is above every number, so one comparison refuses it and the infinities; nulls fail it as well.
    sound = F.expr("coalesce(size(vector) > 0 AND forall(vector, x -> coalesce(abs(x) <= 1.7976931348623157E308D, false)) AND exists(vector, x -> x <> 0), false)")
    sorted_out = vectors.withColumn("sound", sound)
    grouped = sorted_out.where("sound").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = written(grouped.withColumn("id", F.monotonically_increasing_id()))  # written once, so that a class keeps its number
    keyed = written(classes.select("id", "vector").mapInArrow(_hashed(tables, directions, width, seed), "id long, keys array<long>"))
    flat = keyed.select("id", F.posexplode("keys").alias("table", "key")).withColumn("bucket", F.xxhash64("table", "key"))
    crowded = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = flat.select("id", "table", "bucket").join(crowded, "bucket").join(keyed, "id").join(classes.drop("first"), "id")
    dealt = blocks.dealt(met, "bucket", "id", F.ceil(F.col("members") / CHUNK)).select("block", "side", "id", "table", "copies", "keys", "vector")
    found = written(dealt.mapInArrow(_compared(least, tables), "a long, b long, links long"))
    links = found.where("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    reached = components(found.where("a <> b").select("a", "b"))
    placed = classes.select("id", "first", "copies").join(links, "id", "left").join(reached, "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    named = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    known = classes.select("id", "vector").join(placed.join(named, "component").select("id", n_links.alias("n_links"), "component_id"), "id").drop("id")
    linked = vectors.join(known, "vector")
    lone = sorted_out.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionAll(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

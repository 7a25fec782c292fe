"""Comparing the members of groups of any size, in bounded blocks of pairs.

A group is dealt into chunks by hash; every two chunks (and each chunk with itself) meet in one block, which
one task holds at a time. What a task finds leaves it as counts or as spanning edges, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratemill.llm.tables import partitions


def dealt(df: DataFrame, group: str, member: str, chunks: Column) -> DataFrame:
    """Rows of `df` once for each block that they belong to, the rows of a block together.

    Adds `block` (hash of group and chunk pair), `side` (0 and 1: first and second chunk; 2: the chunk with itself).
    """
    df = df.withColumn("_n", F.greatest(F.lit(1), chunks).cast("int"))
    df = df.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    df = df.withColumn("block", F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other")))
    df = df.withColumn("side", F.expr("CASE WHEN _own = _other THEN 2 WHEN _own < _other THEN 0 ELSE 1 END"))
    df = df.drop("_n", "_own", "_other")
    return df.repartition(partitions(df.sparkSession), "block").sortWithinPartitions("block", group, "side", member)


def grouped(batches: Iterator[pa.RecordBatch], key: str = "block") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows sorted by `key`: batches, and the bounds of the groups in each."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.asarray(batch.column(key))
        cut = int(np.searchsorted(keys, keys[-1]))
        if rest and np.asarray(rest[0].column(key))[0] == keys[-1]:
            rest.append(batch)
            continue
        if cut or rest:
            whole = pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks().to_batches()
            yield from ((x, bounds_of(np.asarray(x.column(key)))) for x in whole if len(x))
        rest = [batch.slice(cut)]
    if rest:
        whole = pa.Table.from_batches(rest).combine_chunks().to_batches()
        yield from ((x, bounds_of(np.asarray(x.column(key)))) for x in whole if len(x))


def bounds_of(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph with this symmetric boolean matrix."""
    n = len(linked)
    unseen = np.ones(n, bool)
    out: tuple[list[int], list[int]] = ([], [])
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            found = np.flatnonzero(linked[at] & unseen)
            unseen[found] = False
            stack.extend(found.tolist())
            out[0].extend([at] * len(found))
            out[1].extend(found.tolist())
    return np.array(out[0], np.int64), np.array(out[1], np.int64)

"""The rating model fitted by stochastic gradient descent: mean, biases and factors learned together.

Users and products are dealt into blocks, ratings into the cells of the grid of blocks. A stratum is a set of cells that share no
block, one per user block; its cells are descended at the same time, and after as many strata as blocks every rating has been used once.
So the result is that of one process that takes the ratings in a certain order, which depends on the blocks and the seed alone.
Inside a cell, ratings that share neither user nor product form rounds, which are descended as one matrix operation.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.operators.factors import RatingModel, _attach
from ratemill.plans.ids import dense_ids
from ratemill.session import ensure_checkpoint_dir, stored
from ratemill.sources.readers import ratings_only

#: A block's numbers take at most this many bytes, and a cell has about this many ratings at most.
BLOCK_BYTES, CELL_RATINGS = 64 << 20, 2_000_000
USERS, PRODUCTS = 0, 1
_STATE = "kind int, block int, payload binary"


def block_count(users: int, products: int, ratings: int, rank: int) -> int:
    """Blocks for a data set: by its size alone, so that the same data give the same model on any cluster."""
    by_bytes = max(users, products) * (rank + 1) * 8 / BLOCK_BYTES
    return max(4, math.ceil(by_bytes), math.ceil(math.sqrt(ratings / CELL_RATINGS)))


def _size(n: int, block: int, blocks: int) -> int:
    """Numbers below n that are `block` modulo `blocks`."""
    return (n - block + blocks - 1) // blocks


def _scheduled(key: tuple, table: pa.Table) -> pa.Table:
    """Gives each rating of a cell its round: no user and no product stands twice in one."""
    table = table.sort_by([("draw", "ascending"), ("user", "ascending"), ("product", "ascending"), ("rating", "ascending")])
    users, products = table["user"].to_numpy(), table["product"].to_numpy()
    free_user = [0] * (int(users.max()) + 1)
    free_product = [0] * (int(products.max()) + 1)
    rounds = np.empty(len(users), np.int32)
    for k, (u, p) in enumerate(zip(users.tolist(), products.tolist(), strict=True)):
        turn = free_user[u] if free_user[u] > free_product[p] else free_product[p]
        rounds[k] = turn
        free_user[u] = free_product[p] = turn + 1
    return table.drop_columns(["draw"]).append_column("round", pa.array(rounds))


def _opened(payload: pa.Scalar, rank: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(payload.as_buffer(), np.float64).reshape(-1, rank + 1).copy()
    return numbers[:, 0], numbers[:, 1:]


def _descend(cell: pa.Table, state: pa.Table, mean: float, rank: int, rate: float, reg: float) -> pa.Table:
    """One pass over a cell's ratings; the changed blocks."""
    rows = {kind: k for k, kind in enumerate(state["kind"].to_pylist())}
    blocks = state["block"].to_pylist()
    (user_bias, p), (product_bias, q) = (_opened(state["payload"][rows[kind]], rank) for kind in (USERS, PRODUCTS))
    if cell.num_rows:
        cell = cell.sort_by([("round", "ascending"), ("user", "ascending")])
        users, products, ratings, rounds = (cell[c].to_numpy() for c in ("user", "product", "rating", "round"))
        edges = np.flatnonzero(np.diff(rounds, prepend=-1, append=rounds[-1] + 1))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            u, i = users[s:e], products[s:e]
            pu, qi, bu, bi = p[u], q[i], user_bias[u], product_bias[i]
            error = ratings[s:e] - mean - bu - bi - np.einsum("ij,ij->i", pu, qi)
            user_bias[u] = bu + rate * (error - reg * bu)
            product_bias[i] = bi + rate * (error - reg * bi)
            p[u] = pu + rate * (error[:, None] * qi - reg * pu)
            q[i] = qi + rate * (error[:, None] * pu - reg * qi)
    payloads = [np.column_stack((user_bias, p)).tobytes(), np.column_stack((product_bias, q)).tobytes()]
    return pa.table(
        {
            "kind": pa.array([USERS, PRODUCTS], pa.int32()),
            "block": pa.array([blocks[rows[USERS]], blocks[rows[PRODUCTS]]], pa.int32()),
            "payload": pa.array(payloads, pa.binary()),
        }
    )


def _first_state(counts: tuple[int, int], blocks: int, rank: int, seed: int, spread: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                kind, block = divmod(number, blocks)
                rng = np.random.default_rng([seed, kind, block])
                numbers = rng.normal(0, spread, (_size(counts[kind], block, blocks), rank + 1))
                numbers[:, 0] = 0
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([numbers.tobytes()], pa.binary())], ["kind", "block", "payload"])

    return run


def _rows(rank: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(batch.column("block").to_pylist()):
                bias, factors = _opened(batch.column("payload")[k], rank)
                for at in range(0, len(bias), 1 << 14):
                    some = slice(at, at + (1 << 14))
                    no = np.arange(len(bias))[some] * blocks + block
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(no) + 1) * rank, pa.int32()), pa.array(factors[some].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(bias[some]), lists], ["no", "bias", "factors"])

    return run


class _Steps:
    """The model after each stratum, as tables of which only the last two are kept."""

    def __init__(self, like: DataFrame):
        self.spark = like.sparkSession
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/descent-{uuid.uuid4().hex}"
        self.number = 0

    def _path(self, number: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, state: DataFrame) -> DataFrame:
        self.number += 1
        state.write.parquet(f"{self.folder}/{self.number}")
        path, files = self._path(self.number)
        files.deleteOnExit(path.getParent())
        if self.number > 2:
            old, _ = self._path(self.number - 2)
            files.delete(old, True)
        return self.spark.read.schema(_STATE).parquet(f"{self.folder}/{self.number}")


def fit_sgd(
    ratings: DataFrame,
    rank: int = 100,
    epochs: int = 20,
    rate: float = 0.005,
    reg: float = 0.02,
    seed: int = 42,
    spread: float = 0.1,
    blocks: int | None = None,
) -> RatingModel:
    """A RatingModel by gradient descent: biases start at 0, factors at normal numbers of deviation `spread`.

    `blocks` (default: by size, four at least) is part of what is fitted, as it settles the order of the ratings; partitions and
    cores are not. An epoch is as many jobs as there are blocks, each of which moves the whole model once and reads its own part of the
    ratings; a cell and its two blocks are one task's. Every step is a written table, so a lost executor repeats a cell. For
    models of very many blocks fit_factors moves less.
    """
    spark = ratings.sparkSession
    # Summed as decimals, so that the order of the ratings does not show in the last places.
    summed, n = ratings.agg(F.sum(F.col("rating").cast("decimal(28,12)")), F.count("rating")).first()
    if not n:
        raise ValueError("no ratings to fit")
    mean = float(summed / n)

    def numbered(key: str) -> DataFrame:
        counts = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return stored(counts.join(dense_ids(counts, key, "no"), key))

    users, products = numbered("user_id"), numbered("product_id")
    counts = users.count(), products.count()
    grid = blocks or block_count(*counts, ratings.count(), rank)
    placed = _attach(ratings_only(ratings), users, products, "inner")
    user_block, product_block = F.pmod("u_no", F.lit(grid)), F.pmod("i_no", F.lit(grid))
    placed = placed.select(
        F.pmod(product_block - user_block, F.lit(grid)).cast("int").alias("stratum"),
        user_block.cast("int").alias("block"),
        F.expr(f"u_no div {grid}").cast("int").alias("user"),
        F.expr(f"i_no div {grid}").cast("int").alias("product"),
        F.col("rating").cast("double").alias("rating"),
        F.xxhash64(F.lit(seed), "u_no", "i_no").alias("draw"),
    )
    shape = "stratum int, block int, user int, product int, rating double, round int"
    cells = placed.groupBy("stratum", "block").applyInArrow(_scheduled, shape)
    folder = f"{ensure_checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    cells.write.partitionBy("stratum").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    cells = spark.read.schema(shape.replace("stratum int, ", "") + ", stratum int").parquet(folder)

    steps = _Steps(ratings)
    state = steps.save(spark.range(2 * grid).mapInArrow(_first_state(counts, grid, rank, seed, spread), _STATE))

    def descend(cell: pa.Table, model: pa.Table) -> pa.Table:
        return _descend(cell, model, mean, rank, rate, reg)

    for _ in range(epochs):
        for stratum in range(grid):
            cell = cells.where(F.col("stratum") == stratum).drop("stratum")
            met = F.when(F.col("kind") == USERS, F.col("block")).otherwise(F.pmod(F.col("block") - stratum, F.lit(grid)))
            model = state.withColumn("met", met.cast("int"))
            changed = cell.groupBy("block").cogroup(model.groupBy("met")).applyInArrow(descend, _STATE)
            state = steps.save(changed)

    def table(kind: int, ids: DataFrame, key: str) -> DataFrame:
        vectors = state.where(F.col("kind") == kind).mapInArrow(_rows(rank, grid), "no long, bias double, factors array<double>")
        return stored(ids.join(vectors, "no").select(key, "bias", "n", "factors"))

    return RatingModel(mean, rank, table(USERS, users, "user_id"), table(PRODUCTS, products, "product_id"))

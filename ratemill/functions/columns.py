"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(keys: list[str], buckets: int, seed: int = 42) -> Column:
    """A bucket number that depends on the key values only, not on partitioning or row order."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(buckets))


def rescale_per_group(value: Column, group: str, low: float, high: float, if_flat: float) -> Column:
    """Min-max rescale within a group to [low, high]; a group of equal values becomes if_flat.

    The group must be small by construction (one window partition per group).
    """
    window = Window.partitionBy(group)
    least, most = F.min(value).over(window), F.max(value).over(window)
    return F.when(most != least, low + (high - low) * (value - least) / (most - least)).otherwise(F.lit(if_flat))


def top_value(table: DataFrame, column: str) -> Column:
    """The greatest value of `column` as a scalar, from the plan that computes `table`.

    It asks for whole rows (a struct compares by its first field first), so that no column is pruned and
    Spark reuses the shuffle of `table` where the same query also reads it.
    """
    others = [c for c in table.columns if c != column]
    return table.agg(F.max(F.struct(column, *others))[column]).scalar()


def histogram(values: DataFrame, column: str, bins: int, weight: str | None = None) -> DataFrame:
    """Equal-width histogram with a closed last bin: (bin, bin_left, bin_right, n), empty bins included.

    n counts rows, or adds up `weight`. For whole numbers cut to a range: rows are first counted per
    value, and only that short table is put into bins.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    per_value = (
        values.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("x"))
        .agg(amount.alias("n"))
    )
    spread = F.max("x") > F.min("x")
    whole = per_value.agg(
        F.coalesce(F.when(spread, F.min("x")).otherwise(F.min("x") - 0.5), F.lit(0.0)).alias("lo"),
        F.coalesce(F.when(spread, F.max("x")).otherwise(F.max("x") + 0.5), F.lit(1.0)).alias("hi"),
        F.collect_list(F.struct("x", "n")).alias("items"),
    )
    lo, width = F.col("lo"), (F.col("hi") - F.col("lo")) / bins

    def bin_of(x: Column) -> Column:
        return F.least(F.floor((x - lo) * bins / (F.col("hi") - lo)), F.lit(bins - 1))

    def in_bin(number: Column) -> Column:
        inside = F.filter("items", lambda item: bin_of(item.x) == number)
        return F.aggregate(inside, F.lit(0).cast("long"), lambda total, item: total + item.n)

    rows = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda number: F.struct(
            number.alias("bin"),
            (lo + number * width).alias("bin_left"),
            (lo + (number + 1) * width).alias("bin_right"),
            in_bin(number).alias("n"),
        ),
    )
    return whole.select(F.inline(rows))

"""Joins and orderings that hold when one key carries a large part of all rows.

Group-bys need no help here (partial aggregation runs before the shuffle), nor does "first k rows per
key" written as row_number() <= k (Spark limits each map task to k rows per key). What does need help
is joining rows back to per-key values, and ordered access inside one very large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratemill.session import stored

# A key below HOT_ROWS rows is an ordinary shuffle group. The hot list is cut at MAX_HOT_KEYS, which
# bounds the broadcast; a key that falls off it holds less than 1/MAX_HOT_KEYS of all rows, so it only
# loses the special treatment, never rows.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000


def spread_join(
    rows: DataFrame,
    values: DataFrame,
    key: str,
    weight: str,
    spread_by: list[str],
    how: str = "inner",
    min_weight: int = HOT_ROWS,
) -> DataFrame:
    """Join `rows` to `values`, which has one row per key and the key's row count in `weight`.

    Rows of the heaviest keys take their values from a broadcast of at most MAX_HOT_KEYS rows and pass the shuffle
    by a hash of `spread_by`, evenly however heavy the key is; all other rows meet `values` there. Both
    uses of `values` read the same columns, so Spark computes it once and reuses the exchange. The extra
    join key also keeps a shuffle directly under either side, which lets adaptive execution split a
    key that is heavy in `rows` alone. `how` is inner or left; `weight` is not part of the result.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"spread_join cannot do a {how} join")
    columns = [c for c in values.columns if c not in (key, weight)]
    heavy = (
        values.filter(F.col(weight) >= min_weight)
        .orderBy(F.desc(weight), F.asc(key))
        .limit(MAX_HOT_KEYS)
        .select(key, F.struct(*columns, weight).alias("_heavy"))
    )
    salt = F.xxhash64(*spread_by).bitwiseOR(F.lit(1))  # never 0, which stands for rows of lighter keys
    left = rows.join(F.broadcast(heavy), key, "left").withColumn(
        "_salt", F.when(F.col("_heavy").isNotNull(), salt).otherwise(F.lit(0).cast("long"))
    )
    right = values.select(key, F.struct(*columns, weight).alias("_light"), F.explode(F.array(F.lit(0).cast("long"))).alias("_salt"))
    joined = left.join(right, [key, "_salt"], "left").withColumn("_found", F.coalesce("_heavy", "_light"))
    if how == "inner":
        joined = joined.filter(F.col("_found").isNotNull())
    return joined.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in columns])


def salted_join(
    rows: DataFrame, values: DataFrame, key: str, spread_by: list[str], how: str = "inner", salts: int = 8
) -> DataFrame:
    """Join with every key of `rows` split over `salts` shuffle groups and all of `values` repeated.

    Both sides are plain shuffles, so adaptive execution splits a group that is still too large.

    For a `values` side much smaller than `rows`, where finding the heavy keys first would mean computing
    `rows` twice. `how` keeps or drops left rows: inner, left, left_semi, left_anti.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def first_per_key(
    rows: DataFrame, keys: list[str], order: list[Column | str], n: int = 1, rank: str | None = None
) -> DataFrame:
    """The first n rows per key by `order`; Spark applies the limit before the shuffle as well."""
    name = rank or "_rank"
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def small_groups(rows: DataFrame, key: str, order: str, below: int) -> DataFrame:
    """All rows of the keys that have fewer than `below` rows, without joining counts back.

    Of a larger group at most `below` rows per map task reach the shuffle, so no key is heavy here.
    """
    few = first_per_key(rows, [key], [order], below)
    return (
        few.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
        .filter(F.col("_n") < below)
        .drop("_n")
    )


def _sections(rows: DataFrame, key: str, order: str) -> DataFrame:
    """`rows` range-partitioned by (key, order), so that one key covers many tasks, with the number of the section.

    They are stored, as every step on them must see the same sections.
    """
    return stored(rows.repartitionByRange(F.col(key), F.col(order)).withColumn("_section", F.spark_partition_id()))


def next_in_large_group(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Add `out`: `value` of the row that follows within `key` by `order` (null on the last one).

    The same as lead() over a window by key, for keys too large for one task: each task looks ahead in its own
    section, and its last row of a key takes the first value of the key's next section.
    """
    sections = _sections(rows, key, order)
    seams = (
        sections.groupBy(key, "_section")
        .agg(F.min_by(value, order).alias("_first"))
        .withColumn("_seam", F.lead("_first").over(Window.partitionBy(key).orderBy("_section")))
        .select(key, "_section", "_seam")
    )
    inside = Window.partitionBy(key, "_section").orderBy(order)
    return (
        sections.withColumn(out, F.lead(value).over(inside))
        .withColumn("_last", F.lead(F.lit(True)).over(inside).isNull())
        .join(seams, [key, "_section"], "left")
        .withColumn(out, F.when(F.col("_last"), F.col("_seam")).otherwise(F.col(out)))
        .select(*rows.columns, out)
    )


def total_before_in_large_group(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one within `key` by `order`, 0 on the first.

    The same as a running sum over a window by key, for keys too large for one task: each section adds up its own
    rows and starts from the sums of the key's sections before it.
    """
    sections = _sections(rows, key, order)
    earlier = Window.partitionBy(key).orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sections.groupBy(key, "_section")
        .agg(F.sum(value).alias("_sum"))
        .select(key, "_section", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(key, "_section").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sections.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [key, "_section"])
        .select(*rows.columns, (F.col(out) + F.col("_start")).alias(out))
    )

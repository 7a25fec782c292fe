"""The helpers for heavy keys give the same rows as the plain operation, with and without heavy keys."""

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from ratemill.plans import skew
from ratemill.plans.ids import dense_ids


@pytest.fixture(scope="module")
def skewed(spark):
    """300 rows; key k0 holds a third of them, k40 has no values row."""
    return spark.range(300).select(
        F.when(F.col("id") % 3 == 0, F.lit("k0"))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 41))
        .alias("key"),
        F.col("id").alias("ord"),
        F.concat(F.lit("v"), F.col("id")).alias("value"),
    )


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("min_weight", [5, 50, 10_000])
def test_spread_join(skewed, how, min_weight):
    values = (
        skewed.groupBy("key").agg(F.count("*").alias("n"), F.max("ord").alias("top")).filter("key <> 'k40'")
    )
    want = skewed.join(values.drop("n"), "key", how).select("key", "ord", "value", "top")
    got = skew.spread_join(skewed, values, "key", "n", ["ord"], how, min_weight)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_spread_join_spreads_the_heavy_key(spark, skewed):
    values = skewed.groupBy("key").agg(F.count("*").alias("n"), F.max("ord").alias("top"))
    got = skew.spread_join(skewed.repartition(4), values, "key", "n", ["ord"], "left", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        per_task = (
            got.withColumn("task", F.spark_partition_id()).filter("key = 'k0'").groupBy("task").count().collect()
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert len(per_task) == 4


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(skewed, how):
    values = skewed.groupBy("key").agg(F.max("ord").alias("top")).filter("key not in ('k40', 'k0')")
    want = skewed.join(values, "key", how)
    assert rows(skew.salted_join(skewed, values, "key", ["ord"], how)) == rows(want)


def test_salted_join_keeps_all_rows_of_a_many_sided_key(spark, skewed):
    values = skewed.groupBy("key").agg(F.max("ord").alias("top"))
    several = values.unionByName(values.withColumn("top", F.col("top") + 1))
    want = skewed.join(several, "key")
    assert rows(skew.salted_join(skewed, several, "key", ["ord"])) == rows(want)


def test_small_groups(skewed):
    counts = skewed.groupBy("key").count().filter("count < 6").select("key")
    want = skewed.join(counts, "key", "left_semi")
    got = skew.small_groups(skewed, "key", "ord", 6)
    assert 0 < got.count() < skewed.count()
    assert rows(got) == rows(want)


def test_next_in_large_group(skewed):
    want = skewed.withColumn("next", F.lead("value").over(Window.partitionBy("key").orderBy("ord")))
    got = skew.next_in_large_group(skewed.repartition(7), "key", "ord", "value", "next")
    assert rows(got) == rows(want)


def test_total_before_in_large_group(skewed):
    before = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.withColumn("total", F.coalesce(F.sum("ord").over(before), F.lit(0)))
    for partitions in (1, 7, 31):
        got = skew.total_before_in_large_group(skewed.repartition(partitions), "key", "ord", "ord", "total")
        assert rows(got) == rows(want)


def test_dense_ids(spark):
    keys = spark.range(1000).select(F.concat(F.lit("u"), F.col("id") % 500).alias("user"))
    numbered = dense_ids(keys, "user", "no", buckets=16)
    assert sorted(r["no"] for r in numbered.collect()) == list(range(500))
    again = dense_ids(keys.repartition(13), "user", "no", buckets=16)
    assert rows(numbered) == rows(again)


def test_spread_join_computes_values_once(spark, skewed):
    values = skewed.groupBy("key").agg(F.avg("ord").alias("mean"), F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = skew.spread_join(skewed, values, "key", "n", ["ord"], "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert "ReusedExchange" in plan

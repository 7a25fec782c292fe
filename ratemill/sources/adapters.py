"""Review and click rows as views over the given parquet tables.

The given tables hold orders, documents and events; these views read them as reviews and clicks. All
dimension lookups are plain equi-joins on a unique key, so Spark picks broadcast or sort-merge by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """All line items as reviews. A tenth of them go to forty products, and some texts are long."""
    items = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    often = F.when(F.col("l_suppkey") % 10 == 0, F.col("l_partkey") % 40).otherwise(F.col("l_partkey"))
    text = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type")
    long = (F.col("l_linenumber") == 3) & (F.col("l_suppkey") % 10 == 1)
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(parts, items.l_partkey == parts.p_partkey)
        .select(
            F.concat(F.lit("U"), F.col("o_custkey")).alias("user_id"),
            F.concat(F.lit("P"), often).alias("product_id"),
            (F.col("l_quantity").cast("int") % 5 + 1).alias("rating"),
            F.when(F.col("l_linenumber") != 7, F.col("p_type")).alias("summary"),
            F.when(long, F.repeat(text, F.lit(200))).otherwise(text).alias("text"),
            F.struct(
                "o_orderdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_suppkey"
            ).alias("ord"),
        )
    )


def raw_dump(spark: SparkSession, folder: str) -> DataFrame:
    """The reviews as a dump has them: ratings as text, and rows without user, product or rating."""
    line, order = F.col("ord.l_linenumber"), F.col("ord.l_orderkey")
    return raw_reviews(spark, folder).select(
        F.when((line != 6) | (order % 5 != 0), F.col("user_id")).alias("user_id"),
        F.when((line != 5) | (order % 7 != 0), F.col("product_id")).alias("product_id"),
        F.when((line != 4) | (order % 11 != 0), F.col("rating").cast("string")).alias("rating"),
        "summary",
        "text",
    )


def text_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as reviews, five per product; ten users share every hundred documents."""
    return table(spark, folder, "documents").select(
        F.concat(F.lit("U"), F.expr("doc_id div 100 * 10 + doc_id % 10")).alias("user_id"),
        F.concat(F.lit("P"), F.expr("doc_id div 5")).alias("product_id"),
        (F.col("n_chars") % 5 + 1).cast("int").alias("rating"),
        F.col("source").alias("summary"),
        "text",
        F.col("doc_id").alias("ord"),
    )


def clickstream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as clicks."""
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("U"), F.col("user_id")).alias("user_id"),
        F.concat(F.lit("P"), F.get_json_object("props", "$.k")).alias("product_id"),
        "event_type",
        F.concat(F.lit("session_"), F.col("event_id") % 9000 + 1000).alias("session_id"),
        seconds.alias("timestamp"),
        F.col("ts").alias("created_at"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """User ids that ask for an answer; some of them have no reviews."""
    return table(spark, folder, "customer").select(F.concat(F.lit("U"), F.col("c_custkey")).alias("user_id"))

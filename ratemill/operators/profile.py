"""Counts, summaries and histograms that describe a review table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.functions.columns import histogram


def dataset_stats(reviews: DataFrame) -> DataFrame:
    """One row: distinct users and products, rows, average rating to two places."""
    return reviews.agg(
        F.countDistinct("user_id").alias("total_users"),
        F.countDistinct("product_id").alias("total_products"),
        F.count(F.lit(1)).alias("total_reviews"),
        F.round(F.avg("rating"), 2).alias("avg_rating"),
    )


def sparsity(reviews: DataFrame) -> DataFrame:
    """One row: the share of (user, product) cells that hold no review."""
    counts = reviews.agg(
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("product_id").alias("products"),
        F.count(F.lit(1)).alias("reviews"),
    )
    possible = F.col("users").cast("double") * F.col("products")
    return counts.withColumn("sparsity", 1 - F.col("reviews") / possible)


def value_counts(reviews: DataFrame, column: str) -> DataFrame:
    return reviews.groupBy(column).agg(F.count(F.lit(1)).alias("review_count"))


def rating_counts(reviews: DataFrame) -> DataFrame:
    return value_counts(reviews, "rating").orderBy("rating")


def top_counts(reviews: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n values of `column` with the most rows; equal counts by value."""
    return value_counts(reviews, column).orderBy(F.desc("review_count"), F.asc(column)).limit(n)


def most_active(reviews: DataFrame, column: str = "user_id") -> DataFrame:
    return top_counts(reviews, column, 1)


def top_reviewed(reviews: DataFrame, n: int = 5) -> DataFrame:
    """The n products with the most reviews, with their average rating to two places."""
    return (
        reviews.groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("review_count"), F.round(F.avg("rating"), 2).alias("avg_rating"))
        .orderBy(F.desc("review_count"), F.asc("product_id"))
        .limit(n)
    )


def null_profile(rows: DataFrame) -> DataFrame:
    """One row per column: name, type, nulls, rows. One pass, then the single result row is unfolded."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(name).isNull()).alias(name) for name in rows.columns],
    )
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.col(name).alias("null_count"),
            F.col("_rows").alias("row_count"),
        )
        for name, kind in rows.dtypes
    ]
    return counts.select(F.inline(F.array(*entries)))


def review_length_stats(reviews: DataFrame) -> DataFrame:
    """One row: mean, least and greatest of review_length."""
    return reviews.agg(
        F.avg("review_length").alias("avg_length"),
        F.min("review_length").alias("min_length"),
        F.max("review_length").alias("max_length"),
    )


def activity_stats(reviews: DataFrame) -> DataFrame:
    """One row: reviews per user (mean over users and mean over review rows) and per product.

    Users and products are counted in one pass, as two keys per row. The mean over review rows of each
    user's count is sum(n*n)/sum(n), so no join back is needed.
    """
    keys = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("id")) for side in ("user_id", "product_id")])
    counts = (
        reviews.select(F.explode(keys).alias("key")).groupBy("key.side", "key.id").agg(F.count(F.lit(1)).alias("n"))
    )
    user, product = (F.when(F.col("side") == side, F.col("n")) for side in ("user_id", "product_id"))
    as_double = user.cast("double")
    return counts.agg(
        F.avg(user).alias("avg_per_user"),
        (F.sum(as_double * as_double) / F.sum(as_double)).alias("avg_per_user_over_reviews"),
        F.max(user).alias("max_per_user"),
        F.avg(product).alias("avg_per_product"),
        F.max(product).alias("max_per_product"),
    )


def activity_histogram(reviews: DataFrame, key: str, at_most: int, bins: int) -> DataFrame:
    """Histogram of reviews per `key`, over keys with at_most reviews."""
    counts = value_counts(reviews, key).filter(F.col("review_count") <= at_most)
    return histogram(counts, "review_count", bins)


def review_length_histogram(reviews: DataFrame, at_most: int = 2000, bins: int = 50) -> DataFrame:
    return histogram(reviews.filter(F.col("review_length") <= at_most), "review_length", bins)


def clipped_user_histogram(reviews: DataFrame, clip: int = 50, bins: int = 50) -> DataFrame:
    """Histogram over review rows of min(the user's review count, clip).

    Taken per user and weighted by that user's rows: the same bins without joining counts to rows.
    """
    counts = value_counts(reviews, "user_id").select(
        F.least("review_count", F.lit(clip)).alias("clipped"), F.col("review_count").alias("rows")
    )
    return histogram(counts, "clipped", bins, weight="rows")


def clipped_product_histogram(reviews: DataFrame, clip: int = 100, bins: int = 50) -> DataFrame:
    """Histogram over products of min(review count, clip)."""
    counts = value_counts(reviews, "product_id").select(F.least("review_count", F.lit(clip)).alias("clipped"))
    return histogram(counts, "clipped", bins)

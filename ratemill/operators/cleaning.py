"""From raw review rows to the clean, enriched review table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.plans.skew import first_per_key, small_groups, spread_join

PAIR = ["user_id", "product_id"]
REVIEW_COLUMNS = ["user_id", "product_id", "rating", "summary", "text"]
MISSING_TEXT = "nan"


def ingest(dump: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Project and rename the review columns, drop null keys and whole-row copies, make ratings integers.

    `names` maps source column to review column; the default takes the columns of the public dump.
    """
    names = names or {
        "UserId": "user_id",
        "ProductId": "product_id",
        "Score": "rating",
        "Summary": "summary",
        "Text": "text",
    }
    return (
        dump.select(*[F.col(source).alias(target) for source, target in names.items()])
        .na.drop(subset=["user_id", "product_id", "rating"])
        .dropDuplicates()
        .withColumn("rating", F.col("rating").cast("int"))
    )


def with_summary(reviews: DataFrame) -> DataFrame:
    return reviews.na.drop(subset=["summary"])


def keep_first(reviews: DataFrame) -> DataFrame:
    """One row per (user, product): the first by `ord`."""
    return first_per_key(reviews, PAIR, ["ord"])


def _too_few(pairs: DataFrame, key: str, min_reviews: int) -> DataFrame:
    """The (user, product) pairs whose `key` has fewer than min_reviews of them."""
    other = "product_id" if key == "user_id" else "user_id"
    return small_groups(pairs.select(*PAIR), key, other, min_reviews).select(*PAIR)


def keep_active(reviews: DataFrame, key: str, min_reviews: int = 3) -> DataFrame:
    """Rows whose `key` has min_reviews rows or more; (user, product) is unique.

    Removes the rows of the small groups by pair instead of joining counts back by key, so that a key with
    very many rows stays spread.
    """
    return reviews.join(_too_few(reviews, key, min_reviews), PAIR, "left_anti")


def clean(raw: DataFrame, min_user_reviews: int = 3, min_product_reviews: int = 3) -> DataFrame:
    """Drop rows without summary, keep the first review per (user, product), then users and then products
    with enough reviews (one pass each; a user may end below the minimum).

    The activity rules depend on the distinct pairs only, so they run on that narrow table. The wide
    rows are shuffled once, by pair, for both the first-row rule and the removal of pairs.
    """
    # Ingestion leaves no null ids. Saying so here gives every branch the same filters, so that Spark
    # sees their shuffles as one and reuses it.
    kept = with_summary(raw).filter(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    pairs = kept.select(*PAIR).distinct()
    by_user = _too_few(pairs, "user_id", min_user_reviews)
    by_product = _too_few(pairs.join(by_user, PAIR, "left_anti"), "product_id", min_product_reviews)
    return keep_first(kept).join(by_user.unionByName(by_product), PAIR, "left_anti")


def add_row_features(reviews: DataFrame, missing_text: str | None = MISSING_TEXT) -> DataFrame:
    """review_length and is_positive. A missing text counts as the word `missing_text`; None keeps the null."""
    text = F.col("text") if missing_text is None else F.coalesce("text", F.lit(missing_text))
    return reviews.withColumn("review_length", F.length(text)).withColumn(
        "is_positive", (F.col("rating") >= 4).cast("int")
    )


def add_group_features(reviews: DataFrame) -> DataFrame:
    """product_avg_rating, user_review_count and user_avg_rating on every row; (user, product) is unique.

    Group values are attached to the narrow (user, product, rating) rows first and joined to the wide
    rows on the pair, so the texts are not shuffled by user and again by product.
    """
    narrow = reviews.select(*PAIR, "rating")
    average, n = F.avg("rating"), F.count("rating")
    by_product = narrow.groupBy("product_id").agg(average.alias("product_avg_rating"), n.alias("n"))
    by_user = narrow.groupBy("user_id").agg(
        n.cast("int").alias("user_review_count"), average.alias("user_avg_rating"), n.alias("n")
    )
    values = spread_join(narrow, by_product, "product_id", "n", ["user_id"], "left")
    values = spread_join(values, by_user, "user_id", "n", ["product_id"], "left")
    return reviews.drop("rating").join(values, PAIR).select(
        *reviews.columns, "product_avg_rating", "user_review_count", "user_avg_rating"
    )


def enrich(reviews: DataFrame, missing_text: str | None = MISSING_TEXT) -> DataFrame:
    """The clean table with all derived columns."""
    return add_group_features(add_row_features(reviews, missing_text))

"""Every registered query: a name, and a function (spark, folder of parquet tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.operators import cleaning, content, events, experiments, factors, features, history, hybrid, popularity, profile, refresh
from ratemill.session import own_folder, stored, stored_by
from ratemill.sources import adapters, deltas, sinks
from ratemill.sources.adapters import AS_OF
from ratemill.sources.split_csv import read_csv_in_splits
from ratemill.streaming import numbered, windows

Query = Callable[[SparkSession, str], DataFrame]
DAY_BEFORE = "2024-01-30 00:00:00"
FIXTURE_SUPPORT = 5  # text reviews have five rows per product
FIXTURE_SECTION = 5_000  # characters; so that products have several sections
ACTIVE = {"min_user_reviews": 38, "min_product_reviews": 15}  # near the averages of the given tables, so that both bite


def _dense_raw(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.raw_reviews(spark, folder)


def _dense_first(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.keep_first(cleaning.with_summary(_dense_raw(spark, folder)))


def _dense_clean(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean(_dense_raw(spark, folder))


def _active_clean(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean(_dense_raw(spark, folder), **ACTIVE)


def _on(source: Query, operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """The query that applies an operator to a source view."""
    return lambda spark, folder: operator(source(spark, folder), *args, **kwargs)


def _review_rows(reviews: DataFrame) -> DataFrame:
    return reviews.select(*cleaning.REVIEW_COLUMNS)


def reviews_ingest(spark: SparkSession, folder: str) -> DataFrame:
    names = {name: name for name in cleaning.REVIEW_COLUMNS}
    return cleaning.ingest(adapters.raw_dump(spark, folder), names)


def reviews_enriched(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.table(spark, folder, "lineitem").count()
    first = stored_by(cleaning.PAIR, _dense_first(spark, folder), rows)  # the only shuffle of the texts; what follows moves ids and numbers
    return cleaning.enrich(cleaning.clean(first)).drop("ord")


def _clean_with_length(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.add_row_features(_dense_clean(spark, folder))


def _raw_with_length(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.add_row_features(_dense_raw(spark, folder))


def unknown_users(spark: SparkSession, folder: str) -> DataFrame:
    return history.unknown_users(adapters.customers(spark, folder), _active_clean(spark, folder))


def event_json_decode(spark: SparkSession, folder: str) -> DataFrame:
    messages = events.encode_events(adapters.clickstream(spark, folder))
    decoded = events.decode_events(messages.select(F.col("value").cast("binary").alias("value")))
    return decoded.filter("ok").drop("raw", "ok")


def processed_events(spark: SparkSession, folder: str) -> DataFrame:
    return events.aggregate_events(events.trailing(adapters.clickstream(spark, folder), AS_OF))


def processed_events_upsert(spark: SparkSession, folder: str) -> DataFrame:
    clicks = adapters.clickstream(spark, folder)
    existing = events.aggregate_events(events.trailing(clicks, DAY_BEFORE, 48))
    return events.merge_processed(existing, events.aggregate_events(events.trailing(clicks, AS_OF, 48)))


_COUNTED: dict[tuple[str, str], DataFrame] = {}


def _term_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Term counts of the text reviews: one stored table per application and corpus, from which all queries on texts start."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _COUNTED:
        reviews = adapters.text_reviews(spark, folder)
        _COUNTED[key] = content.term_counts(content.term_rows(reviews), content.product_count(reviews))
    return _COUNTED[key]


def tfidf_vocab(spark: SparkSession, folder: str) -> DataFrame:
    reviews = adapters.text_reviews(spark, folder)
    counts = _term_counts(spark, folder)
    kept = content.vocabulary(counts, content.product_count(reviews))
    return kept.withColumn("idf", F.round("idf", 6))


def tfidf_terms(spark: SparkSession, folder: str) -> DataFrame:
    weights = content.tfidf_of(adapters.text_reviews(spark, folder), counts=_term_counts(spark, folder))
    return weights.withColumn("weight", F.round("weight", 6))


def product_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the cosine matrix that is ever used: the 20 nearest of every product."""
    near = content.content_neighbours(adapters.text_reviews(spark, folder), counts=_term_counts(spark, folder))
    return near.withColumn("similarity", F.round("similarity", 6))


def similar_products(spark: SparkSession, folder: str) -> DataFrame:
    reviews = adapters.text_reviews(spark, folder)
    near = content.content_neighbours(reviews, 10, counts=_term_counts(spark, folder))
    return content.similar_products(near, features.product_stats(reviews))


def _content_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Content scores; only products that somebody liked are asked for their neighbours."""
    reviews = adapters.text_reviews(spark, folder)
    near = content.content_neighbours(reviews, asked=history.liked_seed(reviews), counts=_term_counts(spark, folder))
    return hybrid.content_scores(reviews, near)


def cb_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = _content_scores(spark, folder)
    return scores.withColumn("cb_score", F.round("cb_score", 6))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return factors.with_split(adapters.text_reviews(spark, folder), F.expr("ord div 10 % 5 < 4"))


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).filter("is_train")


def cf_baseline(spark: SparkSession, folder: str) -> DataFrame:
    held_out = _split(spark, folder).filter(~F.col("is_train")).select("user_id", "product_id", "rating")
    predicted = factors.predict(held_out, factors.fit_biases(_train(spark, folder)))
    return predicted.withColumn("prediction", F.round("prediction", 6))


def cf_baseline_metrics(spark: SparkSession, folder: str) -> DataFrame:
    held_out = _split(spark, folder).filter(~F.col("is_train")).select("user_id", "product_id", "rating")
    metrics = factors.error_metrics(factors.predict(held_out, factors.fit_biases(_train(spark, folder))))
    return metrics.select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "n")


def cf_topn(spark: SparkSession, folder: str) -> DataFrame:
    model = factors.fit_factors(_train(spark, folder))
    return hybrid.top_by_rating(adapters.text_reviews(spark, folder), model)


def cf_topn_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The rating-only list from biases alone."""
    return hybrid.top_by_rating(adapters.text_reviews(spark, folder), factors.fit_biases(_train(spark, folder)))


def cv_metrics_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Three-fold cross-validation of the biases, by a given fold column."""
    placed = adapters.text_reviews(spark, folder).withColumn("fold", F.expr("cast(ord div 10 % 3 as int)"))
    rows = factors.cross_validate(placed, 3, fit=factors.fit_biases, fold="fold")
    return rows.withColumns({name: F.round(name, 6) for name in ("rmse", "mae")})


def runs_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out errors of the biases over a grid of shrinkages."""
    grid = [{"user_shrinkage": u, "product_shrinkage": p} for u in (2.0, 10.0) for p in (2.0, 10.0, 50.0)]
    rows = experiments.bias_runs(_split(spark, folder), grid)
    return rows.withColumns({name: F.round(name, 6) for name in ("rmse", "mae")})


def reviews_of_user(spark: SparkSession, folder: str) -> DataFrame:
    return _review_rows(history.reviews_of(_dense_clean(spark, folder), "U7"))


def hybrid_topn_baseline(spark: SparkSession, folder: str) -> DataFrame:
    reviews = adapters.text_reviews(spark, folder)
    return hybrid.recommend(reviews, factors.fit_biases(_train(spark, folder)), _content_scores(spark, folder))


def recommend_routed(spark: SparkSession, folder: str) -> DataFrame:
    reviews = adapters.text_reviews(spark, folder)
    return hybrid.recommend_routed(
        reviews,
        factors.fit_biases(_train(spark, folder)),
        adapters.customers(spark, folder),
        _content_scores(spark, folder),
        min_reviews=FIXTURE_SUPPORT,
    )


#: Bounds of the windows in which the kept tables take in the events, a week each; every given event lies between them.
WEEKS = [datetime(2023, 12, 31) + timedelta(days=7 * k) for k in range(7)]


def _weekly(clicks: DataFrame) -> list[DataFrame]:
    return [events.between(clicks, low, high) for low, high in zip(WEEKS, WEEKS[1:])]


def processed_events_table(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all events out of a versioned table: weekly windows, a fold of the first ones, and runs of folded and other weeks again."""
    clicks, path = adapters.clickstream(spark, folder), own_folder(spark, "processed")
    for low, high in zip(WEEKS, WEEKS[1:]):
        deltas.merge_window(clicks, low, high, path)
    third = sorted(deltas.windows(spark, path))[2]
    deltas.fold_up_to(spark, path, deltas.processed_events, f"{third[0]:012d}_{third[1]:012d}")
    for k in (0, 2, 4):
        deltas.merge_window(clicks, WEEKS[k], WEEKS[k + 1], path)
    return deltas.processed_events(deltas.read_deltas(spark, path))


def popular_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The most popular products out of weekly counts, the first three weeks folded."""
    path = own_folder(spark, "popular")
    for k, week in enumerate(_weekly(adapters.clickstream(spark, folder))):
        numbered.add_popular(week, path, deltas.stream_batch("weeks", k))
    numbered.fold_popular(spark, path, deltas.stream_batch("weeks", 2))
    return numbered.popular_now(spark, path, AS_OF)


def events_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """What the surrogate ids of all events are like, after every week has been added twice."""
    path = own_folder(spark, "numbered")
    for _ in range(2):
        for k, week in enumerate(_weekly(adapters.clickstream(spark, folder).withColumnRenamed("id", "event_id"))):
            numbered.append_numbered(week, path, deltas.stream_batch("weeks", k))
    ids = numbered.read_numbered(spark, path)
    return ids.agg(F.count(F.lit(1)).alias("events"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("id").alias("ids"), F.countDistinct("event_id").alias("distinct_events"))


def trailing_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """At every full hour the events of the 24 hours up to then."""
    return windows.trailing_counts(adapters.clickstream(spark, folder).select("created_at"))


def reviews_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The raw reviews by way of CSV files, which are read in splits."""
    path = own_folder(spark, "dump")
    names = {name: name for name in cleaning.REVIEW_COLUMNS}
    rows = adapters.raw_dump(spark, folder).select(*names)
    sinks.write_csv(rows, path)
    text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return cleaning.ingest(read_csv_in_splits(spark, path, text), names)


def recommend_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """The rating-only list out of that of earlier reviews: only users whom later reviews touch are scored again."""
    reviews, model = adapters.text_reviews(spark, folder), factors.fit_biases(_train(spark, folder))
    later = F.col("ord") % 50 == 0
    old, new = reviews.where(~later), reviews.where(later)
    weights = {"cf_weight": 1.0, "cb_weight": 0.0}
    stale = stored(hybrid.recommend(old, model, **weights))
    return refresh.refreshed(stale, old, new, model, **weights).select("user_id", "rank", "product_id", F.col("cf_score").alias("prediction"))


QUERIES: dict[str, Query] = {
    # cleaning
    "reviews_ingest": reviews_ingest,
    "reviews_dedup_first": _on(_dense_first, _review_rows),
    "active_users_filter": _on(
        _dense_first, lambda rows: _review_rows(cleaning.keep_active(rows, "user_id", ACTIVE["min_user_reviews"]))
    ),
    "reviews_clean": _on(_active_clean, _review_rows),
    "reviews_enriched": reviews_enriched,
    # profile
    "null_profile": _on(adapters.raw_dump, profile.null_profile),
    "dataset_stats": _on(_dense_clean, profile.dataset_stats),
    "sparsity": _on(_active_clean, profile.sparsity),
    "rating_counts": _on(_dense_clean, profile.rating_counts),
    "review_length_stats": _on(_raw_with_length, profile.review_length_stats),
    "activity_stats": _on(_dense_clean, profile.activity_stats),
    "top_reviewed": _on(_dense_clean, profile.top_reviewed),
    "top_products": _on(_dense_clean, profile.top_counts, "product_id"),
    "top_users": _on(_dense_clean, profile.top_counts, "user_id"),
    "most_active_user": _on(_dense_clean, profile.most_active),
    "hist_user_activity": _on(_dense_clean, profile.activity_histogram, "user_id", 20, 20),
    "hist_product_activity": _on(_dense_clean, profile.activity_histogram, "product_id", 50, 30),
    "hist_review_length": _on(_raw_with_length, profile.review_length_histogram),
    "hist_user_clipped": _on(_dense_clean, profile.clipped_user_histogram),
    "hist_product_clipped": _on(_dense_clean, profile.clipped_product_histogram),
    # features
    "product_stats": _on(_dense_clean, features.product_stats),
    "user_features": _on(
        _clean_with_length,
        lambda rows: features.user_features(rows).withColumn("rating_std", F.round("rating_std", 6)),
    ),
    "product_features": _on(
        _clean_with_length,
        lambda rows: features.product_features(rows)
        .withColumn("rating_std", F.round("rating_std", 6))
        .withColumn("popularity_score", F.round("popularity_score", 6)),
    ),
    "rating_distribution": _on(_dense_clean, features.rating_distribution),
    "popular_products": _on(_dense_clean, popularity.popular_products),
    # history
    "reviews_of_user": reviews_of_user,
    "user_history": _on(_dense_clean, history.user_history),
    "user_history_summary": _on(_dense_clean, history.user_history_summary),
    "unknown_users": unknown_users,
    "user_liked_seed": _on(adapters.text_reviews, history.liked_seed),
    # events
    "event_json_decode": event_json_decode,
    "recent_event_count": _on(adapters.clickstream, events.recent_event_count, AS_OF),
    "processed_events": processed_events,
    "processed_events_upsert": processed_events_upsert,
    "popular_by_events": _on(adapters.clickstream, events.popular_by_events, AS_OF),
    "user_event_features": _on(adapters.clickstream, events.user_event_features),
    "trailing_event_counts": trailing_event_counts,
    # tables kept up to date
    "processed_events_table": processed_events_table,
    "popular_incremental": popular_incremental,
    "events_numbered": events_numbered,
    "reviews_from_csv": reviews_from_csv,
    "recommend_refreshed": recommend_refreshed,
    # content
    "product_profiles": _on(adapters.text_reviews, content.product_profiles, FIXTURE_SECTION),
    "tfidf_vocab": tfidf_vocab,
    "tfidf_terms": tfidf_terms,
    "product_cosine": product_cosine,
    "similar_products": similar_products,
    # rating model and recommendations
    "split_counts": _on(_split, factors.split_counts),
    "cf_baseline": cf_baseline,
    "cf_baseline_metrics": cf_baseline_metrics,
    "cv_metrics_baseline": cv_metrics_baseline,
    "runs_baseline": runs_baseline,
    "cf_topn": cf_topn,
    "cf_topn_baseline": cf_topn_baseline,
    "candidates": _on(adapters.text_reviews, hybrid.candidate_counts),
    "cb_scores": cb_scores,
    "hybrid_topn_baseline": hybrid_topn_baseline,
    "recommend_routed": recommend_routed,
}

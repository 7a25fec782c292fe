"""Recommendations brought up to date for the users that new reviews touch, and for nobody else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.operators.factors import RATING_SCALE, RatingModel
from ratemill.operators.history import liked_seed
from ratemill.operators.hybrid import LIKED_SEEDS, NO_EVIDENCE, SIMILAR_PER_SEED, content_scores, recommend
from ratemill.plans.skew import salted_join
from ratemill.session import stored


def changed_products(before: DataFrame, after: DataFrame, per_seed: int = SIMILAR_PER_SEED) -> DataFrame:
    """(product_id): products whose list of neighbours differs in two tables of neighbours."""
    names = ["product_id", "similar_id", "similarity", "similar_rank"]
    old, new = (t.where(F.col("similar_rank") <= per_seed).select(*names) for t in (before, after))
    both = old.withColumn("side", F.lit(1)).unionByName(new.withColumn("side", F.lit(2)))
    rows = both.groupBy(*names).agg(F.sum("side").alias("sides")).where("sides <> 3")
    return rows.select("product_id").distinct()


def touched_users(
    recommended: DataFrame,
    old_reviews: DataFrame,
    new_reviews: DataFrame,
    model: RatingModel,
    old_neighbours: DataFrame | None = None,
    new_neighbours: DataFrame | None = None,
    n: int = 10,
    cf_weight: float = 0.7,
    cb_weight: float = 0.3,
) -> DataFrame:
    """(user_id): users whose list may differ after `new_reviews` and a change of neighbours; the model is the same.

    These are the authors of new reviews; those who liked a product whose neighbours changed; and, if there are new products,
    those whose list is short or has a last score that a new product reaches. A superset is named, never too few.
    """
    touched = new_reviews.select("user_id")
    if old_neighbours is not None and new_neighbours is not None:
        seeds = liked_seed(old_reviews, 4, LIKED_SEEDS).select("user_id", "product_id")
        touched = touched.unionByName(salted_join(seeds, changed_products(old_neighbours, new_neighbours), "product_id", ["user_id"]).select("user_id"))
    fresh = stored(new_reviews.select("product_id").distinct().join(old_reviews.select("product_id").distinct(), "product_id", "left_anti"))
    # What the model does not know counts as 0; one row: the greatest bias and norm of new products.
    known = fresh.join(model.products, "product_id", "left")
    squares = F.aggregate(F.coalesce("factors", F.array().cast("array<double>")), F.lit(0.0), lambda total, x: total + x * x)
    size, bias, norm = known.agg(F.count(F.lit(1)), F.max(F.coalesce("bias", F.lit(0.0))), F.max(F.sqrt(squares))).first()
    if size:
        low, high = RATING_SCALE
        last = recommended.groupBy("user_id").agg(F.count(F.lit(1)).alias("have"), F.min("hybrid_score").alias("last"))
        users = old_reviews.select("user_id").distinct().join(last, "user_id", "left").join(model.users, "user_id", "left")
        reach = F.lit(model.mean + bias) + F.coalesce("bias", F.lit(0.0)) + F.coalesce(F.sqrt(squares), F.lit(0.0)) * norm
        best = cf_weight * F.greatest(F.lit(low), F.least(F.lit(high), reach)) + cb_weight * NO_EVIDENCE
        # Stored scores have four places.
        short = F.coalesce("have", F.lit(0)) < n
        touched = touched.unionByName(users.where(short | (best >= F.col("last") - 1e-4)).select("user_id"))
    return touched.distinct()


def refreshed(
    recommended: DataFrame,
    old_reviews: DataFrame,
    new_reviews: DataFrame,
    model: RatingModel,
    old_neighbours: DataFrame | None = None,
    new_neighbours: DataFrame | None = None,
    n: int = 10,
    **settings,
) -> DataFrame:
    """The rows of recommend() over old and new reviews, out of those over the old ones: only touched users are scored again.

    `recommended` are recommend()'s rows for all users of `old_reviews` with the same model, n and settings, and content scores from
    `old_neighbours` if there are any. With new neighbours, content scores come from those.
    """
    weights = {k: settings[k] for k in ("cf_weight", "cb_weight") if k in settings}
    touched = stored(touched_users(recommended, old_reviews, new_reviews, model, old_neighbours, new_neighbours, n, **weights))
    columns = [c for c in old_reviews.columns if c in new_reviews.columns]
    reviews = old_reviews.select(*columns).unionByName(new_reviews.select(*columns))
    content = None
    neighbours = new_neighbours if new_neighbours is not None else old_neighbours
    if neighbours is not None:
        content = content_scores(reviews.join(touched, "user_id", "left_semi"), neighbours)
    again = recommend(reviews, model, content, touched, n, **settings)
    return recommended.join(touched, "user_id", "left_anti").select(*again.columns).unionByName(again)

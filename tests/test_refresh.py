"""Partial refresh against a full one; distinct counts by day against exact ones."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ratemill.operators import daily, factors, hybrid, refresh
from ratemill.sources import versions

REVIEW = "user_id string, product_id string, rating int, ord long"
NEAR = "product_id string, similar_id string, similarity double, similar_rank int"


def neighbours(rng, products):
    return [(p, q, round(rng.uniform(0.1, 1), 3), k) for p in products for k, q in enumerate(rng.sample([x for x in products if x != p], 4), 1)]


@pytest.mark.parametrize("with_content", [False, True])
@pytest.mark.parametrize("new_products", [0, 3])
def test_a_partial_refresh_equals_a_full_one(spark, with_content, new_products):
    rng = random.Random(7 + new_products)
    products = [f"p{k:02d}" for k in range(40)]
    old = [(f"u{rng.randrange(25):02d}", rng.choice(products), rng.randint(1, 5), k) for k in range(260)]
    more = products + [f"new{k}" for k in range(new_products)]
    new = [("u03", rng.choice(more), 5, 900), ("u04", rng.choice(more), 2, 901), ("u99", "p01", 4, 902)] + [("u03", f"new{k}", 4, 910 + k) for k in range(new_products)]
    old_frame, new_frame = spark.createDataFrame(old, REVIEW), spark.createDataFrame(new, REVIEW)
    model = factors.fit_factors(old_frame, 3, 5, 0.1)
    near = far = before = after = None
    if with_content:
        listed = neighbours(rng, products)
        changed = [(p, q, 0.05 if (p, k) == ("p05", 2) else s, k) for p, q, s, k in listed]
        near, far = spark.createDataFrame(listed, NEAR), spark.createDataFrame(changed, NEAR)
        whole = old_frame.unionByName(new_frame)
        before, after = hybrid.content_scores(old_frame, near), hybrid.content_scores(whole, far)
        assert rows(refresh.changed_products(near, far)) == [("p05",)]
    stale = hybrid.recommend(old_frame, model, before, n=5).cache()
    want = hybrid.recommend(old_frame.unionByName(new_frame), model, after, n=5)
    got = refresh.refreshed(stale, old_frame, new_frame, model, near, far, n=5)
    assert rows(got) == rows(want)
    touched = refresh.touched_users(stale, old_frame, new_frame, model, near, far, n=5).count()
    assert touched >= 3 and (new_products or touched < 20)


def test_distinct_counts_merge_over_days(spark, tmp_path):
    rng = np.random.default_rng(5)
    start, n = date(2024, 1, 1), 30000
    days = rng.integers(0, 6, n)
    data = [(f"u{int(u)}", f"p{int(p)}", int(r), start + timedelta(days=int(d))) for u, p, r, d in zip(rng.integers(0, 9000, n), (rng.random(n) ** 4 * 20), rng.integers(1, 6, n), days)]
    frame = spark.createDataFrame(data, "user_id string, product_id string, rating int, day date").cache()
    path, keys, distinct = str(tmp_path / "days"), ["product_id"], {"unique_reviewers": "user_id"}
    for k in range(6):
        for _ in range(1 + k % 2):  # a day that runs twice counts once
            assert daily.add_day(frame, path, start + timedelta(days=k), keys, distinct)
    daily.fold_days(spark, path, start + timedelta(days=3))
    assert daily.add_day(frame, path, start, keys, distinct) is False
    assert len(versions.load(spark, path).parts) == 3
    for low, high in ((0, 6), (1, 3), (2, 6), (5, 6)):
        a, b = start + timedelta(days=low), start + timedelta(days=high)
        got = {r.product_id: r for r in daily.over_days(daily.stored_days(spark, path), keys, list(distinct), a, b).collect()}
        exact = frame.where((F.col("day") >= F.lit(a)) & (F.col("day") < F.lit(b))).groupBy("product_id")
        for r in exact.agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.stddev("rating").alias("std"), F.countDistinct("user_id").alias("users")).collect():
            mine = got.pop(r.product_id)
            assert mine.total_reviews == r.n and mine.avg_rating == pytest.approx(r["mean"]) and mine.rating_std == pytest.approx(r["std"])
            assert mine.unique_reviewers == pytest.approx(r.users, rel=0.05)
        assert not got

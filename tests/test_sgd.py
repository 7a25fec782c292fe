"""Gradient descent in strata against one process, and on planted factors."""

import numpy as np
import pytest

from ratemill.operators import factors, sgd


def planted(seed=3, users=120, products=80, n=6000, rank=3):
    rng = np.random.default_rng(seed)
    p, q = rng.normal(size=(users, rank)), rng.normal(size=(products, rank))
    bu, bi = rng.normal(0, 0.3, users), rng.normal(0, 0.3, products)
    u, i = rng.integers(0, users, n), np.where(rng.random(n) < 0.3, 0, rng.integers(0, products, n))  # a third of all rate one product
    r = 3 + bu[u] + bi[i] + (p[u] * q[i]).sum(axis=1) * 0.5 + rng.normal(0, 0.1, n)
    return [(f"u{a}", f"p{b}", float(np.clip(c, 1, 5))) for a, b, c in zip(u, i, r)]


SHAPE = "user_id string, product_id string, rating double"
SETTINGS = {"rank": 6, "epochs": 25, "rate": 0.05, "reg": 0.02}


def serial_rmse(train, test, rank, epochs, rate, reg):
    rng = np.random.default_rng(0)
    mean = np.mean([r for *_, r in train])
    bias = {}
    vectors = {}
    for key in {k for u, p, _ in train + test for k in (u, p)}:
        bias[key], vectors[key] = 0.0, rng.normal(0, 0.1, rank)
    for _ in range(epochs):
        for u, p, r in train:
            e = r - mean - bias[u] - bias[p] - vectors[u] @ vectors[p]
            bias[u] += rate * (e - reg * bias[u])
            bias[p] += rate * (e - reg * bias[p])
            vectors[u], vectors[p] = vectors[u] + rate * (e * vectors[p] - reg * vectors[u]), vectors[p] + rate * (e * vectors[u] - reg * vectors[p])
    return np.sqrt(np.mean([(np.clip(mean + bias[u] + bias[p] + vectors[u] @ vectors[p], 1, 5) - r) ** 2 for u, p, r in test]))


def test_planted_factors_are_found_as_by_one_process(spark):
    rows = planted()
    train, test = rows[:5000], rows[5000:]
    data, held = spark.createDataFrame(train, SHAPE), spark.createDataFrame(test, SHAPE)
    model = sgd.fit_sgd(data, blocks=4, **SETTINGS)
    found = factors.error_metrics(factors.predict(held, model)).first()["rmse"]
    biases = factors.error_metrics(factors.predict(held, factors.fit_biases(data))).first()["rmse"]
    assert found < 0.7 * biases
    assert found == pytest.approx(serial_rmse(train, test, **SETTINGS), abs=0.03)
    assert model.users.count() == len({u for u, *_ in train}) and model.products.where("n > 1000").count() == 1


def test_partitions_do_not_change_the_model(spark):
    data = spark.createDataFrame(planted(n=800), SHAPE)
    found = []
    for partitions in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        model = sgd.fit_sgd(data.repartition(partitions), rank=3, epochs=2, blocks=3)
        found.append([sorted(map(tuple, t.collect())) for t in (model.users, model.products)])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2]


def test_rounds_share_no_user_and_no_product():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 500
    table = pa.table({"stratum": [0] * n, "block": [0] * n, "user": rng.integers(0, 20, n), "product": rng.integers(0, 9, n), "rating": rng.random(n), "draw": rng.integers(0, 99, n)})
    done = sgd._scheduled((), table).to_pandas()
    assert len(done) == n
    for _, group in done.groupby("round"):
        assert group["user"].is_unique and group["product"].is_unique


def test_blocks_follow_the_size():
    assert sgd.block_count(10, 10, 100, 10) == 4
    assert sgd.block_count(10**8, 10**6, 10**9, 100) == -(-(10**8 * 101 * 8) // sgd.BLOCK_BYTES)
    assert sum(sgd._size(17, b, 4) for b in range(4)) == 17

"""Whitening against integers in plain Python and a covariance of fractions."""

from __future__ import annotations

import math
import os
from fractions import Fraction

import numpy as np
import pytest

from ratemill.llm import whitening
from ratemill.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, low int"
FOLDER = "/root/testdata/sf0.001"


def whole(vector, wide):
    return vector is not None and len(vector) == wide and all(v is not None and math.isfinite(v) for v in vector)


def steps(vector):
    return [math.floor(64 * float(v)) + 1_000_000 for v in vector]


def check(rows, found, wide, most):
    """`rows`: (vec_id, vector); `found`: rows of the operator."""
    ids = [i for i, v in rows if whole(v, wide)]
    x = [steps(v) for _, v in rows if whole(v, wide)]
    n, s = len(x), [sum(c) for c in zip(*x)]
    far = [[n * a - b for a, b in zip(v, s)] for v in x]
    assert sorted(((r.vec_id, r.component) for r in found), key=repr) == sorted(((i, k) for i in ids for k in range(1, min(most, wide) + 1)), key=repr)
    assert {r.n for r in found} == {n}
    want = sorted((repr(i), sum(d * d for d in f)) for i, f in zip(ids, far))
    assert sorted((repr(r.vec_id), r.deviation) for r in found if r.component == 1) == [(i, d if d < 1 << 63 else None) for i, d in want]
    v = np.array([[float(Fraction(sum(f[i] * f[j] for f in far), n**3)) for j in range(wide)] for i in range(wide)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    centred = np.array([[float(Fraction(d, n)) for d in f] for f in far])
    for k in range(min(most, wide)):
        got = [r for r in found if r.component == k + 1]
        if values[k] <= np.trace(v) * wide * 1e-15:
            assert {r.whitened for r in got} == {None} and {r.explained for r in got} <= {0.0, None}
            continue
        assert got[0].explained == pytest.approx(values[k] / np.trace(v), rel=1e-9)
        mine = sorted((centred @ axes[:, k] / math.sqrt(values[k])).tolist())
        ours = sorted(r.whitened for r in got)
        assert np.allclose(mine, ours, atol=1e-7) or np.allclose(mine, sorted(-w for w in ours), atol=1e-7)
        assert got[0].identity_error < 1e-8
    return found


def test_given_table(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(rows, op13_embedding_whitening(spark, FOLDER).collect(), 64, 32)


@pytest.mark.parametrize("spread", [1.0, 1e-3, 3e4, 1e15])
def test_awkward_rows(spark, spread):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(scale=spread, size=5) * [1, 2, 3, 0, 1]]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0, 1.0]), (1003, [math.nan] * 5), (1004, [math.inf, 0.0, 0.0, 0.0, 0.0]), (1005, [1.0, 2.0]), (1006, [1.0] * 6)]
    df = spark.createDataFrame([(*r, -1, "x", -1) for r in rows], SCHEMA).repartition(7)
    check(rows, whitening.whiten(df, 4).collect(), 5, 4)


def test_the_scatter_is_exact_beyond_longs(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(np.float32(v)) for v in rng.normal(scale=1e15, size=3)] for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    n, sums, centred, _, _ = whitening.scatter(df)
    x = [steps(v) for v in vectors]
    assert (n, sums) == (200, [sum(c) for c in zip(*x)])
    assert centred == [[n * sum(v[i] * v[j] for v in x) - sums[i] * sums[j] for j in range(3)] for i in range(3)]


def test_nothing_varies(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in whitening.whiten(one).collect()] == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    found = sorted(whitening.whiten(huge).collect())
    assert [(r.vec_id, r.component, r.deviation) for r in found] == [(1, 1, None), (1, 2, None), (2, 1, None), (2, 2, None)]
    assert sorted(r.whitened for r in found if r.component == 1) == pytest.approx([-1, 1])
    assert whitening.whiten(one.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_partitions_do_not_matter(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert whitening.scatter(df.repartition(1))[:3] == whitening.scatter(df.repartition(9))[:3]

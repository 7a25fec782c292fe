"""Rows whose ids are missing or stand twice, against brute force; long lists of secrets."""

from __future__ import annotations

import math
import time

import numpy as np
from pyspark.sql import functions as F

from ratemill.llm import embed_dup, secrets


def by_brute_force(rows, least=0.95):
    sound = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and sound[i] and sound[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in np.flatnonzero(link[i]):
                group[i] = group[j] = min(group[i], group[j])
    out = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if group[j] == group[i] and rows[j][0] is not None]
        least_id = min(ids, default=None)
        out.append((vec, int(link[i].sum()), least_id, vec == least_id))
    return sorted(out, key=repr)


def test_vectors_with_missing_repeated_ids_and_lengths(spark):
    rng = np.random.default_rng(5)
    base = [float(np.float32(x)) for x in rng.normal(size=16)]
    near = lambda: [float(np.float32(x + rng.normal() * 0.02)) for x in base]
    far = lambda k: [float(np.float32(x)) for x in rng.normal(size=k)]
    rows = [(7, base), (7, base), (7, near()), (None, near()), (None, far(16)), (3, far(16)), (3, base), (9, far(8)), (9, [1.0] * 8), (8, [1.0] * 8), (None, [2.0] * 8), (4, [1.0]), (5, [2.0]), (6, [-1.0])]
    lone = far(16)
    rows += [(None, lone), (None, lone), (1, None), (None, None), (2, []), (2, [0.0, 0.0]), (10, [1.0, None]), (11, [math.nan, 1.0]), (12, [math.inf, 1.0])]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "vec_id long, embedding array<float>, id int, first int, component int")
    got = sorted(map(tuple, embed_dup.near_vectors(df.repartition(5)).collect()), key=repr)
    assert got == by_brute_force(rows)
    assert max(r[1] for r in got) < len(rows)


BLOB = "aB3" + "xY9z" * 9
TEXTS = [f"AKIA{'Q' * 16} then {BLOB}", "password = hunter22", "", None, f"nothing {'a' * 500} here", f"https://a.b/ AKIA{'Z' * 20} {BLOB}", f"{BLOB} alone"]


def test_secrets_do_not_depend_on_ids(spark):
    shape = "doc_id long, text string, key1 int, start int, spans string"
    of = lambda ids: spark.createDataFrame([(i, t, 0, 0, "") for i, t in zip(ids, TEXTS)], shape)
    listed = lambda ids: secrets.summary(secrets.find_secrets(of(ids))).drop("doc_id").collect()
    own = sorted(listed(range(7)))
    assert sorted(listed([None] * 7)) == own and sorted(listed([5] * 7)) == own
    assert {r.spans for r in own} >= {"access:0:20,blob:26:65", "assign:0:19", ""} and len(own) == 7
    twice = of([None] * 7).unionAll(of([None] * 7))
    assert sorted(secrets.summary(secrets.find_secrets(twice)).drop("doc_id").collect()) == sorted(own * 2)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{k:024x}" for k in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    row = secrets.find_secrets(df).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).first()
    assert (row.n, tuple(row["last"])) == (100_000, (25 * 99_999, 2, 25 * 99_999 + 24))
    assert time.perf_counter() - start < 60


def test_the_texts_are_scanned_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "password = hunter22")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/d")
    plan = secrets.find_secrets(spark.read.parquet(f"{tmp_path}/d"))._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "Python" not in plan

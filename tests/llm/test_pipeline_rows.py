"""Pipeline stages on rows without an id and on rows that share one."""

from __future__ import annotations

import collections

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], KIND)


def texts(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_copies_without_ids(spark):
    long = " ".join(f"word{k}" for k in range(100))
    near, other, third = long + " more", " ".join(f"other{k}" for k in range(50)), " ".join(f"third{k}" for k in range(50))
    rows = [(None, long), (None, near), (5, other), (5, other), (5, other), (6, long), (4, near), (5, third), (None, third + " x"), (None, None), (None, None), (9, "lone text")]
    found = texts(corpus_pipeline.minhash_near_dup(spark, documents(spark, rows), ""))
    assert found == {(4, near): 1, (5, other): 1, (5, third): 1, (None, None): 2, (9, "lone text"): 1}
    lost = texts(corpus_pipeline.minhash_near_dup(spark, documents(spark, [(None, long), (None, near), (None, other)]), ""))
    assert sum(lost.values()) == 2 and lost[(None, other)] == 1


def test_secrets_of_rows_without_ids(spark):
    key, mask = "AKIA" + "A1B2" * 4, "[REDACTED]"
    rows = [(None, f"my {key} here"), (None, f"{key}"), (7, f"first {key}"), (7, "clean text that is long enough"), (7, f"a longer start, then {key}"), (None, None), (7, f"first {key}")]
    found = corpus_pipeline.secret_scan(spark, documents(spark, rows), "")
    assert found.columns == corpus_pipeline.COLUMNS
    want = [(i, t and t.replace(key, mask)) for i, t in rows]
    assert texts(found) == collections.Counter(want)
    assert all(r["n_chars"] == len(r["text"] or "") for r in found.collect())


def test_the_last_stages_take_rows_without_ids(spark):
    rows = [(None, "some words"), (None, "other words here"), (3, "third")]
    packed = corpus_pipeline.best_fit_packing(spark, documents(spark, rows), "").collect()
    assert collections.Counter(r["doc_id"] for r in packed) == {None: 2, 3: 1}

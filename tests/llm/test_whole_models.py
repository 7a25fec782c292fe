"""Character models that are too large to send to the tasks give the results of those that are sent."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratemill.llm import charlm, langid, quality


@pytest.fixture
def texts(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(90):
        letters = ("abcdeé", "defgh", "日本語文字漢仮名")[k % 3]
        text = " ".join("".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(40))
        rows.append((k if k % 10 else None, text, ("aa", "bb", "cc")[k % 3]))
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "123 !?", None), (203, "Unseen zzz qq 日z", None), (203, "abc def", "dd")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


@pytest.mark.parametrize("modified", [False, True])
def test_every_gram_has_the_same_cost(spark, texts, monkeypatch, modified):
    counts = charlm.count(texts.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").alias("label"), "text"), "visible")
    held = charlm.fit(counts, modified)
    monkeypatch.setattr(charlm, "HELD", 10)
    tabled = charlm.fit(counts, modified)
    assert isinstance(tabled, charlm.TableModel) and tabled.labels == held.labels
    grams = np.unique(charlm.spell(texts.select(F.coalesce("text", F.lit("")).alias("text")).toArrow().column("text").combine_chunks(), "visible").grams)
    wanted = spark.createDataFrame([(int(g),) for g in grams.view(np.int64)], "gram long")
    found = {r["gram"]: r["bits"] for r in tabled.costs(wanted).collect()}
    assert len(found) == len(grams)
    np.testing.assert_allclose([found[int(g)] for g in grams.view(np.int64)], -np.log2(held.probabilities(grams)), rtol=1e-4)


def test_languages_and_quality_are_the_same(spark, texts, monkeypatch):
    trusted = texts.where("doc_id % 2 = 0").select("doc_id")

    def found():
        named = langid.predict(texts, langid.learn(texts)).toPandas()
        judged = quality.judge(texts, trusted, carry=("doc_id", "text")).select("doc_id", F.hash("carried.text").alias("hash"), "perplexity", "rejected").toPandas()
        return [x.sort_values(list(x.columns)[:1] + [list(x.columns)[2]], ignore_index=True) for x in (named, judged)]

    whole = found()
    monkeypatch.setattr(charlm, "HELD", 10)
    monkeypatch.setattr(charlm, "BLOCK_BYTES", 500)
    for a, b in zip(whole, found(), strict=True):
        assert len(a) == len(b)
        for column in a.columns:
            if a[column].dtype.kind == "f":
                np.testing.assert_allclose(a[column], b[column], rtol=1e-4)
            else:
                assert a[column].tolist() == b[column].tolist()

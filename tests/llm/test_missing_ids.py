"""Rows without an id, with large ids and with repeated ids."""

from __future__ import annotations

import collections

from ratemill.llm import decontam, packing

LARGE = (1 << 53) + 1


def test_packing_without_ids(spark):
    rows = [(LARGE, "word " * 1500), (None, "one"), (None, "two words"), (3, None)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert collections.Counter(r["doc_id"] for r in found) == {LARGE: 2, None: 2, 3: 1}


def test_benchmark_hits_without_ids(spark):
    item = "a passage of the benchmark that stands in some of the texts"
    rows = [(LARGE, f"so {item}"), (None, f"then {item}"), (None, "nothing here"), (3, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = decontam.benchmark_hits(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert collections.Counter(r["doc_id"] for r in found) == {LARGE: 1, None: 1, 3: 1}

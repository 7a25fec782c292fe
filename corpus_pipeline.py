"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; all but the last return
the columns of `documents`. `run` writes every stage's result as a table in the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.llm import decontam, near_dup, packing, quality, secrets
from ratemill.llm.queries import trusted
from ratemill.llm.tables import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the perplexity of trusted text of their language; null and empty ones go."""
    judged = quality.judge(docs, trusted(spark.read.parquet(f"{sf_dir}/labels.parquet")), carry=tuple(COLUMNS))
    return judged.where("NOT rejected").select("carried.*")


def minhash_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near copies: five-word shingles, similarity 0.8.

    Rows count one by one, whether their id is missing or stands twice; a row without an id is taken only if its whole
    group has none. Rows without shingles stay.
    """
    keyed = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))  # written once, so that a row keeps its number
    found = near_dup.near_duplicates(keyed.select(F.col("row").alias("doc_id"), "text"), shingle=5, percent=80).where("n_shingles > 0")
    members = found.select(F.col("doc_id").alias("row"), "component_id").join(keyed.select("row", "doc_id"), "row")
    firsts = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("members"))
    gone = members.join(firsts.where("members > 1"), "component_id").where(F.col("row") != F.col("first.row")).select("row")
    return keyed.join(gone, "row", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, not even with a tenth of its characters edited."""
    return decontam.without_hits(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets replaced by a mask and n_chars counted anew; each row by its own spans.

    Spans come back by two hashes of id and text: rows that share them are equal in both, so their spans are equal too.
    """
    spans = secrets.find_secrets(docs).select(*secrets.KEY, F.concat("base", "linked").alias("spans")).where(F.size("spans") > 0)
    joined = docs.select(*COLUMNS, *secrets.row_keys("doc_id", "text")).join(spans.dropDuplicates(secrets.KEY), secrets.KEY, "left")
    masked = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("spans")))
    joined = joined.withColumn("text", masked)
    n_chars = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")
    return joined.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, room=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
#: Shingle sets, models and packing are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs

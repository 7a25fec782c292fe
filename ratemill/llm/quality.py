"""Quality of texts by the perplexity of a modified Kneser-Ney model of trusted texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.llm import charlm
from ratemill.llm.tables import written


def held_out(doc_id: Column) -> Column:
    """One trusted text in five, by its id; a missing id is learned from."""
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(5)) == 0, F.lit(False)) & doc_id.isNotNull()


def _costs(docs: DataFrame, model: charlm.Model | charlm.TableModel, carry: list[str]) -> DataFrame:
    """The columns of `docs` named in `carry`, bits in all (by the model of the row's lang, or the kindest if it has none), symbols."""
    labels = model.labels

    def result(part: pa.RecordBatch, total: np.ndarray, symbols: np.ndarray) -> list[pa.Array]:
        places = {x: k for k, x in enumerate(labels)}
        if labels:
            own = np.array([places.get(x, -1) for x in part.column("lang").to_pylist()], np.int64)
            bits = np.where(own < 0, total.min(axis=1), total[np.arange(len(part)), own])
        else:
            bits = np.zeros(len(part))
        return [*(part.column(c) for c in carry), pa.array(bits), pa.array(symbols)]

    schema = T.StructType([docs.schema[c] for c in carry]).add("bits", "double").add("symbols", "long")
    return charlm.scored(docs, model, "visible", result, schema, schema.names)


def judge(docs: DataFrame, trusted: DataFrame, share: float = 0.999, prior: float = 64.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, perplexity, threshold, rejected of `docs` (doc_id, text, lang).

    With `carry`, also a struct `carried` of these columns of the row: a filter then needs no join back to the texts.

    `trusted` (doc_id) names good texts. Four in five of them, by id, are learned from: one model for each language, on whole
    texts; the fifth are held out and set the thresholds, as a text that was learned from looks better than it is. The perplexity
    of a symbol is shrunk to its language's mean over held-out texts by `prior` symbols, so that short texts are not judged on chance.
    threshold is the perplexity within which `share` of the held-out texts of the language stay, and of all its good texts, where few
    are held out (over all languages where the language is null or has none); texts above it are rejected. A missing lang and
    an empty one are the same. Null and empty texts and texts of blanks have
    perplexity null and are rejected; if nothing is trusted, nothing else is. Rows that repeat a doc_id are judged one by
    one; other columns are ignored.
    """
    carried = [F.struct(*carry).alias("carried")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"), *carried)
    # As many ids as there are trusted texts: they grow with the documents, so they are shuffled at every size, never broadcast.
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().hint("merge")
    learned = docs.join(trusted.where(~held_out(F.col("doc_id"))), "doc_id", "left_semi").where("text IS NOT NULL").select(F.col("lang").alias("label"), "text")
    model = charlm.fit(charlm.count(learned, "visible"), modified=True)
    kept = ["carried"] if carry else []
    costs = written(_costs(docs, model, ["doc_id", "lang", *kept]))

    good = costs.join(trusted, "doc_id", "left_semi").where("symbols > 0")
    good = good.withColumn("held", held_out(F.col("doc_id")))
    every = good.groupBy("lang", "held").agg(F.sum("bits").alias("bits"), F.sum("symbols").alias("symbols")).collect()
    means = [r for r in every if r["held"]] or every
    overall = sum(r["bits"] for r in means) / max(1, sum(r["symbols"] for r in means))
    mean = F.lit(overall)
    for r in means:
        mean = F.when(F.col("lang") == r["lang"], r["bits"] / r["symbols"]).otherwise(mean)
    perplexity = F.when(F.col("symbols") > 0, F.pow(F.lit(2.0), (F.col("bits") + mean * prior) / (F.col("symbols") + prior)))
    within = lambda value: F.percentile_approx(value, share, 10_000)
    tops = good.withColumn("perplexity", perplexity).rollup("lang")
    tops = tops.agg(F.greatest(within(F.when(F.col("held"), F.col("perplexity"))), within(F.col("perplexity"))).alias("top")).collect()
    limits = {r["lang"]: r["top"] for r in tops}
    threshold = F.lit(limits.pop(None, None)).cast("double")
    for lang, top in limits.items():
        threshold = F.when(F.col("lang") == lang, top).otherwise(threshold)
    out = costs.select("doc_id", F.nullif("lang", F.lit("")).alias("lang"), perplexity.alias("perplexity"), threshold.alias("threshold"), *kept)
    rejected = F.col("perplexity").isNull() | F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False))
    return out.withColumn("rejected", rejected)

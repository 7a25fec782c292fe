"""Language identification by Kneser-Ney character models, one for each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratemill.llm import charlm

#: Bits a symbol by which one language must beat another for odds of e to 1, for texts of any length.
SHARPNESS = 0.15


def held_out(doc_id: Column) -> Column:
    """One document in five, by its id; never learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learn(docs: DataFrame) -> charlm.Model | charlm.TableModel:
    """The models of `docs` (text, lang), one for each lang that is not null."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").alias("label"), "text")
    return charlm.fit(charlm.count(rows, "letters"), modified=False)


def predict(docs: DataFrame, model: charlm.Model | charlm.TableModel, limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, bits of `docs` (doc_id, text).

    The language with the fewest bits a symbol; equal ones in alphabetical order. score is 1 over the sum of the odds of
    all languages. A text that is null or has no letter is `und` with score 0 and null bits, as is every text if no
    language was learned. With `limits` (see `rejection_limits`), a text that costs more bits than its language's limit is
    `und` as well. Rows that repeat a doc_id are judged one by one; other columns are ignored.
    """
    limits, labels = limits or {}, model.labels

    def result(part: pa.RecordBatch, total: np.ndarray, symbols: np.ndarray) -> list[pa.Array]:
        known = (symbols > 0) & (total.shape[1] > 0)
        each = total / np.maximum(symbols, 1)[:, None]
        best = each.argmin(axis=1) if total.shape[1] else np.zeros(len(part), np.int64)
        least = each.min(axis=1) if total.shape[1] else np.zeros(len(part))
        score = np.where(known, 1 / np.maximum(np.exp((least[:, None] - each) / SHARPNESS).sum(axis=1), 1), 0.0)
        top = np.array([limits.get(x, np.inf) for x in labels])[best] if labels else np.zeros(len(part))
        named = known & (least <= top)
        names = [labels[k] if ok else "und" for k, ok in zip(best.tolist(), named.tolist(), strict=True)]
        return [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(least, mask=~known)]

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return charlm.scored(docs, model, "letters", result, "doc_id long, lang_pred string, score double, bits double", ["doc_id", "lang_pred", "score", "bits"])


def rejection_limits(docs: DataFrame, model: charlm.Model | charlm.TableModel, share: float = 0.999) -> dict[str, float]:
    """For each language, the bits that this share of its texts in `docs` (doc_id, text) stays within."""
    found = predict(docs, model).where("lang_pred <> 'und'").groupBy("lang_pred")
    return {r["lang_pred"]: r["most"] for r in found.agg(F.percentile_approx("bits", share, 10_000).alias("most")).collect()}

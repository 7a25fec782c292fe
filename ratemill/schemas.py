"""Explicit schemas of the files, messages and tables the package reads and writes."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()

RAW_REVIEWS = _struct(user_id=_S, product_id=_S, rating=_I, summary=_S, text=_S)

CLEAN_REVIEWS = _struct(
    user_id=_S,
    product_id=_S,
    rating=_I,
    summary=_S,
    text=_S,
    review_length=_I,
    is_positive=_I,
    product_avg_rating=_D,
    user_review_count=_I,
    user_avg_rating=_D,
)

CLICK_EVENT = _struct(user_id=_S, product_id=_S, event_type=_S, timestamp=_D, session_id=_S)

# The id is a surrogate (a uuid) given at ingestion.
CLICKSTREAM = _struct(
    id=_S, user_id=_S, product_id=_S, event_type=_S, session_id=_S, timestamp=_D, created_at=_TS
)

PROCESSED_EVENTS = _struct(user_id=_S, product_id=_S, event_type=_S, event_count=_L, last_seen=_TS)

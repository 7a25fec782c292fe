"""The registered queries in ANSI SQL, for a side-by-side check by another engine on the same tables."""

from __future__ import annotations

from ratemill.functions.text import ENGLISH_STOP_WORDS

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
DAY_BEFORE = "TIMESTAMP '2024-01-30 00:00:00'"


def rounded(value: str, places: int) -> str:
    """Half-up on the decimal digits of the double."""
    return f"CAST(round(CAST({value} AS DECIMAL(38, 15)), {places}) AS DOUBLE)"


RAW = """WITH
raw AS (
  SELECT 'U' || o_custkey AS user_id,
         'P' || CASE WHEN l_suppkey % 10 = 0 THEN l_partkey % 40 ELSE l_partkey END AS product_id,
         CAST(1 + CAST(l_quantity AS INT) % 5 AS INT) AS rating,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE p_type END AS summary,
         repeat(p_name || ' ' || p_brand || ' ' || p_type,
                CASE WHEN l_linenumber = 3 AND l_suppkey % 10 = 1 THEN 200 ELSE 1 END) AS text,
         o_orderdate AS o1, l_orderkey AS o2, l_linenumber AS o3, l_quantity AS o4,
         l_extendedprice AS o5, l_suppkey AS o6
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""
DUMP = RAW + """,
dump AS (
  SELECT CASE WHEN o3 <> 6 OR o2 % 5 <> 0 THEN user_id END AS user_id,
         CASE WHEN o3 <> 5 OR o2 % 7 <> 0 THEN product_id END AS product_id,
         CASE WHEN o3 <> 4 OR o2 % 11 <> 0 THEN CAST(rating AS VARCHAR) END AS rating, summary, text
  FROM raw
)"""


FIRST = """,
firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY o1, o2, o3, o4, o5, o6) AS rn
    FROM raw WHERE summary IS NOT NULL) WHERE rn = 1
)"""


def _active(least: int) -> str:
    return f""",
by_user AS (
  SELECT * FROM firsts
  WHERE user_id IN (SELECT user_id FROM firsts GROUP BY user_id HAVING count(*) >= {least})
)"""


def _clean(least: int) -> str:
    return f""",
clean AS (
  SELECT * FROM by_user
  WHERE product_id IN (SELECT product_id FROM by_user GROUP BY product_id HAVING count(*) >= {least})
)"""


DENSE = RAW + FIRST + _active(3) + _clean(3)
ACTIVE = RAW + FIRST + _active(38) + _clean(15)
REVIEW = "user_id, product_id, rating, summary, text"

TEXT = """WITH
reviews AS (
  SELECT 'U' || (doc_id // 100 * 10 + doc_id % 10) AS user_id, 'P' || (doc_id // 5) AS product_id,
         CAST(1 + n_chars % 5 AS INT) AS rating, source AS summary, text, doc_id AS ord
  FROM documents
)"""
CLICKS = """WITH
clicks AS (
  SELECT event_id AS id, 'U' || user_id AS user_id,
         'P' || json_extract_string(props, '$.k') AS product_id, event_type,
         'session_' || (1000 + event_id % 9000) AS session_id, ts AS created_at,
         epoch_us(ts) / 1e6 AS timestamp
  FROM events
)"""


def _window(as_of: str, hours: int) -> str:
    return f"created_at >= {as_of} - INTERVAL {hours} HOURS AND created_at <= {as_of}"


def _processed(as_of: str, hours: int) -> str:
    return f"""SELECT user_id, product_id, event_type, count(*) AS event_count, max(created_at) AS last_seen
  FROM clicks WHERE {_window(as_of, hours)} GROUP BY user_id, product_id, event_type"""


def _histogram(values: str, bins: int) -> str:
    return f""",
vals AS ({values}),
bounds AS (
  SELECT CASE WHEN max(x) > min(x) THEN CAST(min(x) AS DOUBLE) ELSE min(x) - 0.5e0 END AS lo,
         CASE WHEN max(x) > min(x) THEN CAST(max(x) AS DOUBLE) ELSE max(x) + 0.5e0 END AS hi
  FROM vals
),
counted AS (
  SELECT CAST(least({bins - 1}, floor((x - lo) * {bins} / (hi - lo))) AS INT) AS bin,
         CAST(sum(w) AS BIGINT) AS n
  FROM vals, bounds GROUP BY 1
)
SELECT CAST(b.bin AS INT) AS bin, lo + b.bin * ((hi - lo) / {bins}) AS bin_left,
       lo + (b.bin + 1) * ((hi - lo) / {bins}) AS bin_right, coalesce(n, 0) AS n
FROM (SELECT unnest(range({bins})) AS bin) b CROSS JOIN bounds LEFT JOIN counted ON counted.bin = b.bin"""


STOP_LIST = ", ".join("('" + word.replace("'", "''") + "')" for word in ENGLISH_STOP_WORDS)
TERMS = TEXT + f""",
stop(word) AS (VALUES {STOP_LIST}),
words AS (
  SELECT product_id, ord, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word,
         generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), 1) AS pos
  FROM reviews
),
kept AS (
  SELECT product_id, word,
         lead(word) OVER (PARTITION BY product_id ORDER BY ord, pos) AS next_word
  FROM words WHERE word NOT IN (SELECT word FROM stop)
),
counts AS (
  SELECT product_id, term, count(*) AS n FROM (
    SELECT product_id, word AS term FROM kept
    UNION ALL SELECT product_id, word || ' ' || next_word FROM kept WHERE next_word IS NOT NULL)
  GROUP BY product_id, term
),
n_products AS (SELECT count(DISTINCT product_id) AS n FROM reviews),
vocab AS (
  SELECT term, df, total, ln((1 + np) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM (
    SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY term),
    (SELECT n AS np FROM n_products)
  WHERE df >= 2 AND df <= 0.95 * np
  ORDER BY total DESC, term LIMIT 5000
),
tf AS (SELECT product_id, term, n * idf AS w FROM counts JOIN vocab USING (term)),
norms AS (SELECT product_id, sqrt(sum(w * w)) AS len FROM tf GROUP BY product_id),
weights AS (SELECT product_id, term, w / len AS weight FROM tf JOIN norms USING (product_id))"""
NEAR = TERMS + """,
pairs AS (
  SELECT a.product_id, b.product_id AS similar_id, sum(a.weight * b.weight) AS similarity
  FROM weights a JOIN weights b ON a.term = b.term AND a.product_id <> b.product_id
  GROUP BY 1, 2
),
near AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY round(similarity, 9) DESC, similar_id) AS INT)
              AS similar_rank
    FROM pairs WHERE similarity > 0) WHERE similar_rank <= 20
)"""
CONTENT = NEAR + """,
liked AS (
  SELECT * FROM (
    SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY ord, product_id) AS rn
    FROM reviews WHERE rating >= 4) WHERE rn <= 5
),
summed AS (
  SELECT user_id, similar_id AS product_id, round(sum(similarity), 9) AS total
  FROM liked JOIN near USING (product_id) GROUP BY 1, 2
),
fresh AS (SELECT * FROM summed ANTI JOIN reviews USING (user_id, product_id)),
cb AS (
  SELECT user_id, product_id,
         CASE WHEN max(total) OVER u <> min(total) OVER u
              THEN 1 + 4 * (total - min(total) OVER u) / (max(total) OVER u - min(total) OVER u)
              ELSE 3.0 END AS cb_score
  FROM fresh WINDOW u AS (PARTITION BY user_id)
)"""


def _biases(train: str, user_shrinkage: float = 10.0, product_shrinkage: float = 10.0) -> str:
    return f""",
train AS (SELECT * FROM reviews WHERE {train}),
mu AS (SELECT avg(rating) AS mu FROM train),
bi AS (
  SELECT product_id, sum(rating - mu) / ({product_shrinkage}e0 + count(*)) AS b_i FROM train, mu GROUP BY product_id
),
bu AS (
  SELECT user_id, sum(rating - mu - b_i) / ({user_shrinkage}e0 + count(*)) AS b_u
  FROM train JOIN bi USING (product_id), mu GROUP BY user_id
)"""


def _predicted(train: str, *shrinkage: float) -> str:
    return TEXT + _biases(train, *shrinkage) + f""",
predicted AS (
  SELECT t.user_id, t.product_id, rating,
         greatest(1.0e0, least(5.0e0, mu + coalesce(b_i, 0) + coalesce(b_u, 0))) AS prediction
  FROM (SELECT * FROM reviews WHERE NOT ({train})) t CROSS JOIN mu
  LEFT JOIN bi ON t.product_id = bi.product_id LEFT JOIN bu ON t.user_id = bu.user_id
)"""


TRAIN = "ord // 10 % 5 < 4"
METRICS = f"""{rounded('sqrt(avg((prediction - rating) * (prediction - rating)))', 6)} AS rmse,
  {rounded('avg(abs(prediction - rating))', 6)} AS mae, count(*) AS n FROM predicted"""
BIASES, PREDICTED = _biases(TRAIN), _predicted(TRAIN)
HYBRID = CONTENT + BIASES + """,
candidate AS (
  SELECT * FROM (SELECT * FROM (SELECT DISTINCT user_id FROM reviews), (SELECT DISTINCT product_id FROM reviews)) c
  ANTI JOIN reviews USING (user_id, product_id)
),
scored AS (
  SELECT c.user_id, c.product_id,
         greatest(1.0e0, least(5.0e0, mu + coalesce(b_i, 0) + coalesce(b_u, 0))) AS cf,
         coalesce(cb_score, 3.0e0) AS cb
  FROM candidate c CROSS JOIN mu
  LEFT JOIN bi ON c.product_id = bi.product_id LEFT JOIN bu ON c.user_id = bu.user_id
  LEFT JOIN cb ON c.user_id = cb.user_id AND c.product_id = cb.product_id
),
blended AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(0.7e0 * cf + 0.3e0 * cb, 9) DESC, product_id)
                 AS INT) AS rank
  FROM scored
),
hybrid AS (
  SELECT user_id, rank, product_id, """ + rounded("0.7e0 * cf + 0.3e0 * cb", 4) + """ AS hybrid_score,
         """ + rounded("cf", 4) + " AS cf_score, " + rounded("cb", 4) + """ AS cb_score, 'hybrid' AS source
  FROM blended WHERE rank <= 10
)"""


def _popular(reviews: str, support: int) -> str:
    return f"""
supported AS (
  SELECT product_id, count(*) AS n, avg(rating) AS a FROM {reviews} GROUP BY product_id HAVING count(*) >= {support}
),
shares AS (
  SELECT product_id, a, n / CAST((SELECT max(n) FROM supported) AS DOUBLE) * 5 AS share FROM supported
),
popular AS (
  SELECT CAST(row_number() OVER (ORDER BY round(0.7e0 * a + 0.3e0 * share, 9) DESC, product_id) AS INT) AS rank,
         product_id, {rounded("0.7e0 * a + 0.3e0 * share", 4)} AS hybrid_score, {rounded("a", 4)} AS cf_score,
         {rounded("share", 4)} AS cb_score, 'popularity' AS source
  FROM shares QUALIFY rank <= 10
)"""


def _top(column: str, n: int) -> str:
    return f""" SELECT {column}, count(*) AS review_count FROM clean
  GROUP BY {column} ORDER BY review_count DESC, {column} LIMIT {n}"""


ORACLE: dict[str, str] = {
    "reviews_ingest": DUMP + """ SELECT DISTINCT user_id, product_id, CAST(rating AS INT) AS rating, summary, text FROM dump
  WHERE user_id IS NOT NULL AND product_id IS NOT NULL AND rating IS NOT NULL""",
    "reviews_dedup_first": RAW + FIRST + f" SELECT {REVIEW} FROM firsts",
    "active_users_filter": ACTIVE + f" SELECT {REVIEW} FROM by_user",
    "reviews_clean": ACTIVE + f" SELECT {REVIEW} FROM clean",
    "reviews_enriched": DENSE + f""" SELECT {REVIEW}, CAST(length(text) AS INT) AS review_length,
  CAST(rating >= 4 AS INT) AS is_positive, avg(rating) OVER (PARTITION BY product_id) AS product_avg_rating,
  CAST(count(*) OVER (PARTITION BY user_id) AS INT) AS user_review_count,
  avg(rating) OVER (PARTITION BY user_id) AS user_avg_rating FROM clean""",
    "null_profile": DUMP + " UNION ALL ".join(
        f" SELECT '{name}' AS column_name, '{kind}' AS data_type, count(*) FILTER ({name} IS NULL) AS null_count,"
        " count(*) AS row_count FROM dump"
        for name, kind in (
            ("user_id", "string"), ("product_id", "string"), ("rating", "string"), ("summary", "string"), ("text", "string")
        )
    ),
    "dataset_stats": DENSE + f""" SELECT count(DISTINCT user_id) AS total_users, count(DISTINCT product_id) AS total_products,
  count(*) AS total_reviews, {rounded("avg(rating)", 2)} AS avg_rating FROM clean""",
    "sparsity": ACTIVE + """ SELECT count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products,
  count(*) AS reviews,
  1 - count(*) / (CAST(count(DISTINCT user_id) AS DOUBLE) * count(DISTINCT product_id)) AS sparsity FROM clean""",
    "rating_counts": DENSE + " SELECT rating, count(*) AS review_count FROM clean GROUP BY rating ORDER BY rating",
    "review_length_stats": RAW + """ SELECT avg(length(text)) AS avg_length, CAST(min(length(text)) AS INT) AS min_length,
  CAST(max(length(text)) AS INT) AS max_length FROM raw""",
    "activity_stats": DENSE + """,
u AS (SELECT count(*) AS n FROM clean GROUP BY user_id), p AS (SELECT count(*) AS n FROM clean GROUP BY product_id)
SELECT avg(u.n) AS avg_per_user, sum(CAST(u.n AS DOUBLE) * u.n) / sum(CAST(u.n AS DOUBLE)) AS avg_per_user_over_reviews,
  max(u.n) AS max_per_user, (SELECT avg(n) FROM p) AS avg_per_product, (SELECT max(n) FROM p) AS max_per_product
FROM u""",
    "top_reviewed": DENSE + f""" SELECT product_id, count(*) AS review_count, {rounded("avg(rating)", 2)} AS avg_rating
  FROM clean GROUP BY product_id ORDER BY review_count DESC, product_id LIMIT 5""",
    "top_products": DENSE + _top("product_id", 10),
    "top_users": DENSE + _top("user_id", 10),
    "most_active_user": DENSE + _top("user_id", 1),
    "hist_user_activity": DENSE + _histogram(
        "SELECT count(*) AS x, 1 AS w FROM clean GROUP BY user_id HAVING count(*) <= 20", 20),
    "hist_product_activity": DENSE + _histogram(
        "SELECT count(*) AS x, 1 AS w FROM clean GROUP BY product_id HAVING count(*) <= 50", 30),
    "hist_review_length": RAW + _histogram(
        "SELECT length(text) AS x, 1 AS w FROM raw WHERE length(text) <= 2000", 50),
    "hist_user_clipped": DENSE + _histogram(
        "SELECT least(50, count(*)) AS x, count(*) AS w FROM clean GROUP BY user_id", 50),
    "hist_product_clipped": DENSE + _histogram(
        "SELECT least(100, count(*)) AS x, 1 AS w FROM clean GROUP BY product_id", 50),
    "product_stats": DENSE + """ SELECT product_id, count(rating) AS review_count, avg(rating) AS avg_rating
  FROM clean GROUP BY product_id""",
    "user_features": DENSE + f""" SELECT user_id, count(*) AS total_reviews, avg(rating) AS avg_rating_given,
  {rounded("stddev_samp(rating)", 6)} AS rating_std, min(rating) AS min_rating, max(rating) AS max_rating,
  count(*) FILTER (rating >= 4) AS positive_reviews, avg(length(text)) AS avg_review_length
FROM clean GROUP BY user_id""",
    "product_features": DENSE + f""" SELECT product_id, count(*) AS total_reviews, avg(rating) AS avg_rating,
  {rounded("stddev_samp(rating)", 6)} AS rating_std, count(DISTINCT user_id) AS unique_reviewers,
  count(*) FILTER (rating >= 4) AS positive_reviews, avg(length(text)) AS avg_review_length,
  {rounded('''avg(rating) * 0.7e0 + count(*)
    / CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM clean GROUP BY product_id)) AS DOUBLE) * 5 * 0.3e0''', 6)}
    AS popularity_score
FROM clean GROUP BY product_id""",
    "rating_distribution": DENSE + " SELECT product_id, " + ", ".join(
        f"count(*) FILTER (rating = {r}) AS rating_{r}" for r in range(1, 6)
    ) + " FROM clean GROUP BY product_id",
    "popular_products": DENSE + "," + _popular("clean", 10) + " SELECT * FROM popular",
    "reviews_of_user": DENSE + f" SELECT {REVIEW} FROM clean WHERE user_id = 'U7'",
    "user_history": DENSE + """ SELECT user_id, CAST(row_number() OVER (
    PARTITION BY user_id ORDER BY rating DESC, o1, o2, o3, o4, o5, o6, product_id) AS INT) AS rank,
  product_id, rating, summary FROM clean QUALIFY rank <= 20""",
    "user_history_summary": DENSE + f""" SELECT user_id, count(*) AS total_reviews,
  {rounded("avg(rating)", 2)} AS avg_rating_given FROM clean GROUP BY user_id""",
    "unknown_users": ACTIVE + """ SELECT DISTINCT 'U' || c_custkey AS user_id FROM customer
  WHERE 'U' || c_custkey NOT IN (SELECT user_id FROM clean)""",
    "user_liked_seed": TEXT + """ SELECT user_id, product_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ord, product_id) AS INT) AS seed_rank
FROM reviews WHERE rating >= 4 QUALIFY seed_rank <= 5""",
    "event_json_decode": CLICKS + " SELECT user_id, product_id, event_type, timestamp, session_id FROM clicks",
    "recent_event_count": CLICKS + f" SELECT count(*) AS event_count FROM clicks WHERE {_window(AS_OF, 24)}",
    "processed_events": CLICKS + " " + _processed(AS_OF, 24),
    "processed_events_upsert": CLICKS + f""",
old AS ({_processed(DAY_BEFORE, 48)}),
new AS ({_processed(AS_OF, 48)})
SELECT user_id, product_id, event_type, coalesce(old.event_count, 0) + coalesce(new.event_count, 0) AS event_count,
  coalesce(new.last_seen, old.last_seen) AS last_seen
FROM old FULL JOIN new USING (user_id, product_id, event_type)""",
    "popular_by_events": CLICKS + f""" SELECT product_id, count(*) AS interaction_count, {AS_OF} AS updated_at
FROM clicks GROUP BY product_id ORDER BY interaction_count DESC, product_id LIMIT 100""",
    "user_event_features": CLICKS + """ SELECT user_id, count(*) AS total_events,
  count(DISTINCT product_id) AS unique_products, count(*) FILTER (event_type = 'purchase') AS purchases,
  count(*) FILTER (event_type = 'view') AS views, max(created_at) AS last_active FROM clicks GROUP BY user_id""",
    "product_profiles": TEXT + """,
placed AS (
  SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (
    PARTITION BY product_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 5000 AS BIGINT) AS section
  FROM reviews
),
stats AS (SELECT product_id, count(rating) AS review_count, avg(rating) AS avg_rating FROM reviews GROUP BY product_id)
SELECT product_id, section, string_agg(text, ' ' ORDER BY ord) AS combined_text,
  any_value(review_count) AS review_count, any_value(avg_rating) AS avg_rating
FROM placed JOIN stats USING (product_id) GROUP BY product_id, section""",
    "tfidf_vocab": TERMS + f" SELECT term, df, total, {rounded('idf', 6)} AS idf FROM vocab",
    "tfidf_terms": TERMS + f" SELECT product_id, term, {rounded('weight', 6)} AS weight FROM weights",
    "product_cosine": NEAR + f""" SELECT product_id, similar_id, {rounded('similarity', 6)} AS similarity, similar_rank
FROM near""",
    "similar_products": NEAR + f""",
stats AS (SELECT product_id AS similar_id, count(*) AS review_count, avg(rating) AS a FROM reviews GROUP BY 1)
SELECT product_id, similar_rank AS rank, similar_id, {rounded('similarity', 4)} AS similarity_score,
  {rounded('a', 2)} AS avg_rating, review_count FROM near JOIN stats USING (similar_id) WHERE similar_rank <= 10""",
    "split_counts": TEXT + " SELECT ord // 10 % 5 < 4 AS is_train, count(*) AS n FROM reviews GROUP BY 1",
    "cf_baseline": PREDICTED + f" SELECT user_id, product_id, rating, {rounded('prediction', 6)} AS prediction FROM predicted",
    "cf_baseline_metrics": PREDICTED + " SELECT " + METRICS,
    "cv_metrics_baseline": " UNION ALL ".join(
        f"SELECT * FROM ({_predicted(f'CAST(ord // 10 % 3 AS INT) <> {fold}')} SELECT {fold} AS fold, {METRICS})" for fold in range(3)
    ),
    "runs_baseline": " UNION ALL ".join(
        f"SELECT * FROM ({_predicted(TRAIN, u, p)} SELECT {u}e0 AS user_shrinkage, {p}e0 AS product_shrinkage, {METRICS})"
        for u in (2.0, 10.0) for p in (2.0, 10.0, 50.0)
    ),
    "cf_topn_baseline": TEXT + BIASES + """,
scored AS (
  SELECT c.user_id, c.product_id, greatest(1.0e0, least(5.0e0, mu + coalesce(b_i, 0) + coalesce(b_u, 0))) AS cf
  FROM (SELECT * FROM (SELECT DISTINCT user_id FROM reviews), (SELECT DISTINCT product_id FROM reviews)) c
  CROSS JOIN mu LEFT JOIN bi ON c.product_id = bi.product_id LEFT JOIN bu ON c.user_id = bu.user_id
  ANTI JOIN reviews r ON c.user_id = r.user_id AND c.product_id = r.product_id
)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(cf, 9) DESC, product_id) AS INT) AS rank,
  product_id, """ + rounded("cf", 4) + """ AS prediction FROM scored QUALIFY rank <= 10""",
    "candidates": TEXT + """ SELECT user_id, count(DISTINCT product_id) AS reviewed_products,
  (SELECT count(DISTINCT product_id) FROM reviews) - count(DISTINCT product_id) AS candidate_products
FROM reviews GROUP BY user_id""",
    "cb_scores": CONTENT + f" SELECT user_id, product_id, {rounded('cb_score', 6)} AS cb_score FROM cb",
    "hybrid_topn_baseline": HYBRID + " SELECT * FROM hybrid",
    "recommend_routed": HYBRID + "," + _popular("reviews", 5) + """,
asked AS (SELECT DISTINCT 'U' || c_custkey AS user_id FROM customer)
SELECT hybrid.*, 'hybrid' AS response_source FROM hybrid SEMI JOIN asked USING (user_id)
UNION ALL
SELECT user_id, popular.*, 'popularity_fallback' AS response_source
FROM (SELECT user_id FROM asked WHERE user_id NOT IN (SELECT user_id FROM reviews)), popular""",
}
ORACLE |= {
    "processed_events_table": CLICKS + """ SELECT user_id, product_id, event_type, count(*) AS event_count, max(created_at) AS last_seen
FROM clicks GROUP BY user_id, product_id, event_type""",
    "popular_incremental": ORACLE["popular_by_events"],
    "events_numbered": CLICKS + """ SELECT count(*) AS events, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id, count(*) AS ids,
  count(*) AS distinct_events FROM clicks""",
    "trailing_event_counts": CLICKS + """,
moments AS (
  SELECT unnest(generate_series(date_trunc('hour', min(created_at)), date_trunc('hour', max(created_at)) + INTERVAL 25 HOURS, INTERVAL 1 HOUR)) AS as_of
  FROM clicks
)
SELECT as_of, count(*) AS event_count FROM moments JOIN clicks ON created_at >= as_of - INTERVAL 24 HOURS AND created_at <= as_of GROUP BY as_of""",
    "reviews_from_csv": ORACLE["reviews_ingest"],
    "recommend_refreshed": ORACLE["cf_topn_baseline"],
}

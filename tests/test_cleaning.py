import re

from conftest import rows
from pyspark.sql import functions as F

from ratemill import schemas
from ratemill.operators import cleaning, features, history, popularity, profile
from ratemill.session import stored_by
from ratemill.sources import readers, sinks

COLUMNS = "user_id string, product_id string, rating int, summary string, text string, ord int"


def reviews(spark, data):
    return spark.createDataFrame(data, COLUMNS)


def test_ingest(spark):
    dump = spark.createDataFrame(
        [
            (1, "u1", "p1", 5.0, "s", "t", "x"),
            (2, "u1", "p1", 5.0, "s", "t", "y"),
            (3, "u2", None, 4.0, "s", "t", "x"),
            (4, "u2", "p1", None, "s", "t", "x"),
            (5, "u3", "p1", 3.9, None, None, "x"),
            (6, "u3", "p1", 3.9, None, None, "x"),
        ],
        "Id int, UserId string, ProductId string, Score double, Summary string, Text string, Extra string",
    )
    got = cleaning.ingest(dump)
    assert got.dtypes == [("user_id", "string"), ("product_id", "string"), ("rating", "int"), ("summary", "string"), ("text", "string")]
    assert rows(got) == sorted([("u1", "p1", 5, "s", "t"), ("u3", "p1", 3, None, None)], key=repr)


def test_keep_first_by_order(spark):
    data = [("u", "p", 1, "s", "b", 2), ("u", "p", 5, "s", "a", 1), ("u", "q", 3, "s", "c", 3)]
    assert rows(cleaning.keep_first(reviews(spark, data))) == [("u", "p", 5, "s", "a", 1), ("u", "q", 3, "s", "c", 3)]


def test_clean_is_one_pass_per_rule(spark):
    """User b has three reviews until the product rule removes one; b stays with two."""
    pairs = [(u, p) for u in "acd" for p in ("p1", "p2", "p3")] + [("b", "p1"), ("b", "p2"), ("b", "rare")]
    pairs += [("e", "p1"), ("e", "p2")]
    data = [(u, p, 4, "s", "t", i) for i, (u, p) in enumerate(pairs)] + [("a", "p9", 4, None, "t", 99)]
    got = cleaning.clean(reviews(spark, data))
    want = [(u, p) for u, p in pairs if u != "e" and p != "rare"]
    assert rows(got.select("user_id", "product_id")) == sorted(want, key=repr)


def test_enrich(spark):
    data = [("u", "p", 5, "s", None, 1), ("u", "q", 2, "s", "abc d", 2), ("v", "p", 4, "s", "", 3)]
    got = cleaning.enrich(reviews(spark, data)).drop("ord", "summary", "text")
    assert rows(got) == [
        ("u", "p", 5, 3, 1, 4.5, 2, 3.5),
        ("u", "q", 2, 5, 0, 2.0, 2, 3.5),
        ("v", "p", 4, 0, 1, 4.5, 1, 4.0),
    ]
    assert cleaning.add_row_features(reviews(spark, data), None).filter("review_length is null").count() == 1


def test_csv_round_trip_and_na_texts(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "user_id,product_id,rating,summary,text\n"
        'u1,p1,5.0,"He said ""yes""","two\nlines"\n'
        "u2,p2,NA,null,\n"
        "u3,p3,4,plain,n/a text\n"
    )
    got = readers.read_csv(spark, str(path), schemas.RAW_REVIEWS)
    want = [
        ("u1", "p1", 5, 'He said "yes"', "two\nlines"),
        ("u2", "p2", None, None, None),
        ("u3", "p3", 4, "plain", "n/a text"),
    ]
    assert rows(got) == sorted(want, key=repr)
    sinks.write_csv(got, str(tmp_path / "out"))
    assert rows(readers.read_csv(spark, str(tmp_path / "out"), schemas.RAW_REVIEWS)) == rows(got)
    inferred = dict(readers.read_csv(spark, str(tmp_path / "out"), None).dtypes)
    assert inferred["rating"] == "int" and inferred["text"] == "string"


def test_column_pruning_reaches_the_scan(spark, tmp_path):
    reviews(spark, [("u", "p", 5, "s", "t", 1)]).write.parquet(str(tmp_path / "r"))
    plan = readers.ratings_only(spark.read.parquet(str(tmp_path / "r")))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<user_id:string,product_id:string,rating:int>" in plan


def test_tables(spark, tmp_path):
    data = reviews(spark, [("u", "p", 5, "s", "t", 1), ("u", "q", 4, "s", "t", 2)])
    sinks.replace_table(data.limit(1), "reviews_table")
    sinks.replace_table(data, "reviews_table")
    count, sample = readers.load_check(readers.read_table(spark, "reviews_table"), 1)
    assert (count, sample.count()) == (2, 1)
    top = readers.query_table(spark, "select product_id, count(*) n from reviews_table group by product_id")
    assert top.count() == 2
    sinks.write_features({"stats": features.product_stats(data)}, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f" / "stats")).count() == 2


def test_profile_edges(spark):
    data = reviews(spark, [("u", "p", 5, "s", "t", 1), ("u", "q", 4, None, "t", 2), ("v", "p", 1, "s", "t", 3)])
    assert rows(profile.activity_stats(data)) == [(1.5, 5 / 3, 2, 1.5, 2)]
    assert rows(profile.sparsity(data)) == [(2, 2, 3, 0.25)]
    nulls = {r["column_name"]: r["null_count"] for r in profile.null_profile(data).collect()}
    assert nulls["summary"] == 1 and nulls["text"] == 0
    flat = profile.activity_histogram(data.filter("user_id = 'v'"), "user_id", 20, 4).collect()
    assert [r["n"] for r in flat] == [0, 0, 1, 0] and (flat[0]["bin_left"], flat[3]["bin_right"]) == (0.5, 1.5)
    empty = profile.activity_histogram(data.limit(0), "user_id", 20, 2).collect()
    assert [r["n"] for r in empty] == [0, 0]


def test_product_features_constant_and_sketch(spark):
    data = reviews(spark, [("u", "p", 5, "s", "t", 1), ("v", "p", 3, "s", "t", 2)]).withColumn("review_length", F.lit(1))
    got = features.product_features(data, max_reviews=10, approximate_reviewers=True).first()
    assert got["unique_reviewers"] == 2
    assert abs(got["popularity_score"] - (4 * 0.7 + 2 / 10 * 5 * 0.3)) < 1e-12


def test_popular_ties_and_support(spark):
    data = [(f"u{i}", p, 4, "s", "t", i) for p in ("b", "a", "c") for i in range(10)] + [("u0", "few", 5, "s", "t", 0)]
    got = popularity.popular_products(reviews(spark, data), 2)
    assert [(r["rank"], r["product_id"]) for r in got.orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_history(spark):
    data = reviews(spark, [("u", f"p{i:02}", 1 + i % 5, "s", "t", i) for i in range(30)] + [("v", "p", 3, "s", "t", 1)])
    got = history.user_history(data).filter("user_id = 'u'").orderBy("rank").collect()
    assert len(got) == 20 and [r["product_id"] for r in got[:2]] == ["p04", "p09"]
    users = data.sparkSession.createDataFrame([("v",), ("x",), ("x",)], "user_id string")
    assert rows(history.unknown_users(users, data)) == [("x",)]
    assert rows(history.known_users(users, data)) == [("v",)]
    assert history.reviews_of_users(data, users).count() == 1
    assert history.reviews_of(data, "u").count() == 30
    assert history.liked_seed(data).count() == 5


def test_enrichment_of_buckets_shuffles_no_texts(spark):
    """The first reviews lie in buckets by pair, so cleaning and enrichment move ids and numbers only."""
    data = [(f"u{k % 7}", f"p{k % 11}", k % 5 + 1, "s" if k % 13 else None, f"text {k}", k) for k in range(200)]
    data += [(None, "p1", 3, "s", "t", 1), ("u1", None, 3, "s", "t", 1)]
    raw = reviews(spark, data)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        first = stored_by(cleaning.PAIR, cleaning.keep_first(cleaning.with_summary(raw)), len(data))
        got = cleaning.enrich(cleaning.clean(first)).drop("ord")
        plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
        assert moved and not any("text#" in columns or "summary#" in columns for columns in moved)
        assert rows(got) == rows(cleaning.enrich(cleaning.clean(raw)).drop("ord"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

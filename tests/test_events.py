import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ratemill import schemas
from ratemill.operators import events
from ratemill.sources import deltas
from ratemill.streaming import clicks

NOON = datetime(2024, 1, 2, 12)


def message(user, product, kind, **more):
    return json.dumps({"user_id": user, "product_id": product, "event_type": kind, "timestamp": 1.5, "session_id": "s", **more})


def test_decode(spark):
    texts = [message("u", "p", "view"), "not json", json.dumps({"product_id": "p", "event_type": "view"}), None]
    got = events.decode_events(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False]
    assert (got[0]["user_id"], got[0]["timestamp"]) == ("u", 1.5) and got[1]["raw"] == "not json"


def test_encode_is_keyed_by_user(spark):
    decoded = events.decode_events(spark.createDataFrame([(message("u", "p", "view"),)], "value string"))
    row = events.encode_events(decoded).first()
    assert row["key"] == "u" and json.loads(row["value"]) == json.loads(message("u", "p", "view"))


def test_trailing_window(spark):
    times = [datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 11, 59, 59), NOON, datetime(2024, 1, 2, 12, 0, 1)]
    frame = spark.createDataFrame([(t,) for t in times], "created_at timestamp")
    assert events.recent_event_count(frame, NOON).first()[0] == 2


def test_merge(spark):
    shape = "user_id string, product_id string, event_type string, event_count long, last_seen timestamp"
    late, early = datetime(2024, 1, 5), datetime(2024, 1, 1)
    old = spark.createDataFrame([("u", "p", "view", 2, late), ("u", "q", "view", 1, early)], shape)
    new = spark.createDataFrame([("u", "p", "view", 3, early), ("v", "p", "view", 1, late)], shape)
    want = [("u", "p", "view", 5, early), ("u", "q", "view", 1, early), ("v", "p", "view", 1, late)]
    assert rows(events.merge_processed(old, new)) == sorted(want, key=repr)


def write_lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def run(queries):
    for query in queries:
        query.awaitTermination(120)
        assert query.exception() is None


def test_ingest_restarts_without_loss_or_repeats(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    write_lines(source, "1.txt", [message("u", "p", "view"), "broken", message("u", "q", "purchase")])
    run(clicks.start_ingest(clicks.read_files(spark, str(source)), out, checkpoint, once=True))
    write_lines(source, "2.txt", [message("v", "p", "view"), '{"user_id": "x"}'])
    for _ in range(2):
        run(clicks.start_ingest(clicks.read_files(spark, str(source)), out, checkpoint, once=True))
    saved = clicks.read_events(spark, out)
    assert rows(saved.select("user_id", "product_id", "event_type")) == [
        ("u", "p", "view"), ("u", "q", "purchase"), ("v", "p", "view"),
    ]
    assert saved.filter("created_at is null or id is null").count() == 0
    assert rows(spark.read.parquet(f"{out}/dead_letters").select("raw")) == [("broken",), ('{"user_id": "x"}',)]


def test_running_total_and_approximate_features(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source, "1.txt", [message("u", "p", "view"), "broken", message("u", "q", "purchase"), message("v", "p", "view")])
    stream = clicks.decoded(clicks.read_files(spark, str(source)))
    for name, frame in (("total", clicks.running_total(stream)), ("features", clicks.approximate_user_features(stream))):
        query = frame.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        run([query])
    assert spark.table("total").first()[0] == 3
    assert rows(spark.table("features").drop("last_active")) == [("u", 2, 2, 1, 1), ("v", 1, 1, 0, 1)]


def test_continuous_tables_equal_the_batch_jobs(spark, tmp_path):
    source = tmp_path / "in"
    for number in range(3):
        lines = [message(f"u{i % 4}", f"p{i % 3}", "view" if i % 2 else "purchase") for i in range(number, number + 10)]
        write_lines(source, f"{number}.txt", lines + ["broken"])
    stream = clicks.decoded(clicks.read_files(spark, str(source), max_files=1))
    processed, features = str(tmp_path / "processed"), str(tmp_path / "features")
    run([clicks.start_processed_upsert(stream, processed, str(tmp_path / "cp1"), once=True)])
    run([clicks.start_user_features(stream, features, str(tmp_path / "cp2"), once=True)])
    whole = events.decode_events(spark.read.text(str(source))).filter("ok").withColumn("created_at", F.current_timestamp())
    current = deltas.processed_events(deltas.read_deltas(spark, processed, schemas.PROCESSED_EVENTS))
    assert deltas.read_deltas(spark, processed).select("batch_id").distinct().count() == 3
    assert rows(current.drop("last_seen")) == rows(events.aggregate_events(whole).drop("last_seen"))
    got = deltas.user_event_features(deltas.read_deltas(spark, features)).drop("last_active")
    assert rows(got) == rows(events.user_event_features(whole).drop("last_active"))


def test_deltas_repeat_and_compact(spark, tmp_path):
    shape = "user_id string, product_id string, event_type string, event_count long, last_seen timestamp"
    path = str(tmp_path / "t")
    late, early = datetime(2024, 1, 5), datetime(2024, 1, 1)
    deltas.write_delta(spark.createDataFrame([("u", "p", "view", 2, late)], shape), path, "s_1")
    for _ in range(2):
        deltas.write_delta(spark.createDataFrame([("u", "p", "view", 3, early)], shape), path, "s_2")
    deltas.write_delta(spark.createDataFrame([("u", "q", "view", 1, late)], shape), path, "s_3")
    want = [("u", "p", "view", 5, early), ("u", "q", "view", 1, late)]
    assert rows(deltas.processed_events(deltas.read_deltas(spark, path))) == sorted(want, key=repr)
    deltas.compact(deltas.read_deltas(spark, path), deltas.processed_events, "s_2", str(tmp_path / "c"))
    compacted = deltas.read_deltas(spark, str(tmp_path / "c"))
    assert compacted.count() == 2
    assert rows(deltas.processed_events(compacted)) == sorted(want, key=repr)


def test_daily_merge_can_run_twice(spark, tmp_path):
    times = [datetime(2024, 1, 1, 20), datetime(2024, 1, 2, 8), datetime(2024, 1, 2, 20)]
    shape = "user_id string, product_id string, event_type string, created_at timestamp"
    clicked = spark.createDataFrame([("u", "p", "view", t) for t in times], shape)
    path = str(tmp_path / "days")
    for day in (2, 3, 3):
        deltas.merge_day(clicked, datetime(2024, 1, day, 12), path)
    assert rows(deltas.processed_events(deltas.read_deltas(spark, path))) == [("u", "p", "view", 3, times[2])]


def clicked_at(spark, times):
    shape = "user_id string, product_id string, event_type string, created_at timestamp"
    return spark.createDataFrame([("u", "p", "view", t) for t in times], shape)


def total(spark, path):
    return deltas.processed_events(deltas.read_deltas(spark, path, schemas.PROCESSED_EVENTS)).first()["event_count"]


def test_two_runs_on_one_day_keep_all_events(spark, tmp_path):
    clicked = clicked_at(spark, [datetime(2024, 1, 1, 5), datetime(2024, 1, 2, 5), datetime(2024, 1, 2, 22)])
    path = str(tmp_path / "days")
    deltas.merge_day(clicked, datetime(2024, 1, 2), path)
    deltas.merge_day(clicked, datetime(2024, 1, 2, 23), path)
    assert total(spark, path) == 3


def test_event_at_the_moment_of_a_run_counts_once(spark, tmp_path):
    clicked = clicked_at(spark, [datetime(2024, 1, 1, 13), datetime(2024, 1, 2, 12)])
    path = str(tmp_path / "days")
    for day in (2, 3, 3, 4):
        deltas.merge_day(clicked, datetime(2024, 1, day, 12), path)
    assert total(spark, path) == 2
    assert len(deltas.windows(spark, path)) == 3


def test_a_gap_between_runs_is_caught_up_and_overlaps_are_refused(spark, tmp_path):
    clicked = clicked_at(spark, [datetime(2024, 1, day, 18) for day in range(1, 8)])
    path = str(tmp_path / "days")
    deltas.merge_day(clicked, datetime(2024, 1, 2), path)
    deltas.merge_day(clicked, datetime(2024, 1, 8), path)
    assert total(spark, path) == 7
    with pytest.raises(ValueError):
        deltas.merge_window(clicked, datetime(2024, 1, 1, 12), datetime(2024, 1, 2, 12), path)
    with pytest.raises(ValueError):
        deltas.merge_window(clicked, datetime(2024, 1, 9), datetime(2024, 1, 9), path)


def test_a_new_checkpoint_needs_a_new_name(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "t")
    write_lines(source, "1.txt", [message("u", "p", "view")])
    stream = clicks.decoded(clicks.read_files(spark, str(source)))
    run([clicks.start_processed_upsert(stream, path, str(tmp_path / "c1"), once=True, name="a")])
    with pytest.raises(ValueError):
        clicks.start_processed_upsert(stream, path, str(tmp_path / "c2"), once=True, name="a")
    run([clicks.start_processed_upsert(stream, path, str(tmp_path / "c1"), once=True, name="a")])
    run([clicks.start_processed_upsert(stream, path, str(tmp_path / "c2"), once=True, name="b")])
    assert total(spark, path) == 2


def test_publish_to_files(spark, tmp_path):
    decoded = events.decode_events(spark.createDataFrame([(message("u", "p", "view"),)], "value string"))
    clicks.publish(decoded, "json").save(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["key"] == "u"

"""Streams with state against the batch jobs, over restarts."""

import random
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F
from test_events import message, run, write_lines

from ratemill.operators import events
from ratemill.sources import deltas, versions
from ratemill.streaming import clicks, features, windows

START = datetime(2024, 3, 1)


def clicked(spark, folder, number, times):
    """One file of a stream."""
    spark.createDataFrame([(t,) for t in times], "created_at timestamp").coalesce(1).write.parquet(f"{folder}/{number}")
    return times


def stream_of(spark, folder):
    return spark.readStream.schema("created_at timestamp").option("recursiveFileLookup", True).parquet(folder)


def test_trailing_counts_equal_the_look_at_each_moment(spark, tmp_path):
    rng = random.Random(3)
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    known, most_state = [], 0
    for number in range(4):
        low = number * 20
        times = [START + timedelta(hours=low, seconds=rng.randrange(20 * 3600)) for _ in range(30)]
        times += [START + timedelta(hours=low + 3), START + timedelta(hours=low + 3, microseconds=-1)]  # on and before a moment
        known += clicked(spark, folder, number, times)
        query = windows.start_trailing_counts(stream_of(spark, folder), out, checkpoint, once=True, late="30 minutes")
        run([query])
        most_state = max(most_state, windows.state_rows(query))
        every = spark.createDataFrame([(t,) for t in known], "created_at timestamp")
        found = {r.as_of: r.event_count for r in spark.read.parquet(out).collect()}
        mark = max(known) - timedelta(minutes=30)
        assert found and max(found) <= mark
        for as_of, n in found.items():
            assert n == events.recent_event_count(every, as_of).first()[0], as_of
        assert most_state <= 24 + 20 + 2  # open moments only: those of 24 hours and of one file
    moments = {min(found) + timedelta(hours=k) for k in range(len(found))}
    assert set(found) == moments


def test_late_events_count_at_the_moments_still_open(spark, tmp_path):
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    parts = ([START, START + timedelta(hours=10)], [START + timedelta(hours=10, minutes=1), START + timedelta(hours=5)], [START - timedelta(hours=30), START + timedelta(hours=60)])
    dropped = 0
    for number, times in enumerate(parts):
        clicked(spark, folder, number, times)
        query = windows.start_trailing_counts(stream_of(spark, folder), out, checkpoint, once=True, late="30 minutes")
        run([query])
        dropped += sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    found = {r.as_of: r.event_count for r in spark.read.parquet(out).collect()}
    at = lambda h: START + timedelta(hours=h)
    assert found[at(0)] == found[at(9)] == 1  # closed before the late event came
    assert found[at(10)] == 3 and found[at(11)] == 4  # open then: the late one counts
    assert found[at(24)] == 4 and found[at(25)] == 3 and found[at(29)] == 3 and found[at(30)] == 2
    assert dropped > 0


def lines(rng, n):
    return [message(f"u{int(rng.random() ** 3 * 12)}", f"p{rng.randrange(30)}", rng.choice(["view", "purchase", "cart"])) for _ in range(n)] + ["broken"]


def test_user_features_from_state_equal_the_batch_job(spark, tmp_path):
    rng = random.Random(8)
    source, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "cp")
    for round_ in range(3):  # each round is a restart from the checkpoint
        for k in range(2):
            write_lines(source, f"{round_}-{k}.txt", lines(rng, 60))
        stream = clicks.decoded(clicks.read_files(spark, str(source), max_files=1))
        run([features.start_user_features(stream, table, checkpoint, once=True)])
        whole = events.decode_events(spark.read.text(str(source))).filter("ok").withColumn("created_at", F.current_timestamp())
        want = rows(events.user_event_features(whole).drop("last_active"))
        assert rows(features.current_features(spark, table).drop("last_active")) == want
        assert features.current_features(spark, table).where("last_active is null").count() == 0
        if round_ == 1:
            assert features.fold_features(spark, table, deltas.stream_batch("stream", 2))
            assert rows(features.current_features(spark, table).drop("last_active")) == want
    assert len(versions.load(spark, table).parts) == 4


def test_quiet_users_come_from_a_timer(spark, tmp_path):
    source, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "cp")
    write_lines(source, "1.txt", [message("u", "p", "view"), message("u", "q", "view"), message("v", "p", "purchase")])
    stream = clicks.decoded(clicks.read_files(spark, str(source)))
    query = features.start_user_features(stream, table, checkpoint, quiet_seconds=1)
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if versions.load(spark, table).parts and features.current_features(spark, table).count() == 2:
                break
    finally:
        query.stop()
    assert rows(features.current_features(spark, table).drop("last_active")) == [("u", 2, 2, 0, 2), ("v", 1, 1, 1, 0)]

"""Surrogate ids over retries and restarts; popular products against the batch job."""

import random
from datetime import datetime

import pytest
from conftest import rows
from test_events import message, run, write_lines

from ratemill.operators import events
from ratemill.sources import deltas, versions
from ratemill.streaming import clicks, numbered

NOON = datetime(2024, 1, 2, 12)


def test_ids_have_no_gap_or_repeat_over_crashes(spark, tmp_path, monkeypatch):
    source, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "cp")
    total, before = 0, {}
    publish = versions.publish
    for number in range(4):
        write_lines(source, f"{number}.txt", [message(f"u{number}", f"p{k}", "view") for k in range(5 + number)] + ["broken"])
        total += 5 + number
        stream = clicks.decoded(clicks.read_files(spark, str(source), max_files=1))
        if number in (1, 2):  # dies before (1) or after (2) the rows are the table's; then starts again

            def dies(*args, number=number):
                if number == 2:
                    publish(*args)
                raise OSError("gone")

            monkeypatch.setattr(versions, "publish", dies)
            query = numbered.start_numbered_ingest(stream, table, checkpoint, once=True)
            with pytest.raises(Exception):  # noqa: B017
                query.awaitTermination(120)
            monkeypatch.setattr(versions, "publish", publish)
        run([numbered.start_numbered_ingest(stream, table, checkpoint, once=True)])
        found = {(r.user_id, r.product_id): r.id for r in numbered.read_numbered(spark, table).collect()}
        assert sorted(found.values()) == list(range(1, total + 1))
        assert before.items() <= found.items()  # nobody's id changes
        before = found
    assert numbered.fold_numbered(spark, table, deltas.stream_batch("stream", 2))
    assert {(r.user_id, r.product_id): r.id for r in numbered.read_numbered(spark, table).collect()} == before
    assert len(versions.load(spark, table).parts) == 2 and deltas.next_number(spark, table) == total + 1
    assert numbered.append_numbered(spark.createDataFrame([("x",)], "user_id string"), table, deltas.stream_batch("stream", 1)) == range(0)


def test_two_writers_share_no_id(spark, tmp_path):
    table, load, other = str(tmp_path / "t"), versions.load, []
    batch = spark.range(50).selectExpr("concat('u', id) AS user_id").repartition(7)

    def overtaken(session, path, number=None):
        found = load(session, path, number)
        if not other:
            other.append(True)
            numbered.append_numbered(batch, path, "b_000000000000")
        return found

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(versions, "load", overtaken)
        assert len(numbered.append_numbered(batch, table, "a_000000000000")) == 50
    ids = [r.id for r in numbered.read_numbered(spark, table).collect()]
    assert sorted(ids) == list(range(1, 101))


@pytest.mark.parametrize("listed, n", [(1000, 10), (25, 5), (4, 3), (2, 10)])
def test_popular_now_equals_the_batch_job(spark, tmp_path, listed, n):
    rng = random.Random(listed)
    path, seen = str(tmp_path / "t"), []
    for number in range(4):
        batch = [(f"p{int(rng.paretovariate(0.7))}",) for _ in range(150)]
        seen += batch
        frame = spark.createDataFrame(batch, "product_id string")
        for _ in range(1 + number % 2):  # repeated batches replace themselves
            numbered.add_popular(frame, path, deltas.stream_batch("s", number), listed)
        if number == 2:
            numbered.fold_popular(spark, path, deltas.stream_batch("s", 1), listed)
    whole = spark.createDataFrame([(p, NOON) for (p,) in seen], "product_id string, created_at timestamp")
    want = events.popular_by_events(whole, NOON, n)
    assert rows(numbered.popular_now(spark, path, NOON, n, listed)) == rows(want)


def test_rare_products_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for number in range(3):
        frame = spark.range(40000).selectExpr("if(id < 20000, concat('top', id % 10), concat('rare', id)) AS product_id")
        numbered.add_popular(frame, path, deltas.stream_batch("s", number), 20)
    plan = numbered.popular_now(spark, path, NOON, 5, 20)
    assert plan.first()["interaction_count"] == 6000
    text = plan._jdf.queryExecution().toString()
    assert "In(product_id" in text or "PushedFilters: [Not" in text or "product_id IN" in text

"""Files with line ends inside quotes, cut into many splits, against Spark's reader of whole files."""

import csv
import random

import pytest
from conftest import rows
from pyspark.sql import types as T

from ratemill.sources import readers, split_csv
from ratemill.sources.split_csv import _records, read_csv_in_splits

SCHEMA = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("rating", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("note", T.StringType())])


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def awkward(seed, n=120):
    rng = random.Random(seed)
    pieces = ["plain", '"', '""', "\n", "\n\n", ",", " ", "é日", "'", "a,b\nc", '\n"', '"\n', "NA", "x" * 40]
    return [(f"u{k}", rng.choice(["1", "5", "4.0", "", "NA"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))), rng.choice(["", "end", 'say "no"', "last\n"])) for k in range(n)]


def write(path, data, ending="\n", all_quoted=False):
    with open(path, "w", newline="") as f:
        writer = csv.writer(f, lineterminator=ending, quoting=csv.QUOTE_ALL if all_quoted else csv.QUOTE_MINIMAL)
        writer.writerow([f.name for f in SCHEMA])
        writer.writerows(data)


@pytest.mark.parametrize("ending, all_quoted", [("\n", False), ("\r\n", False), ("\n", True)])
def test_equals_the_reader_of_whole_files(spark, tmp_path, small_splits, ending, all_quoted):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        write(folder / f"{k}.csv", awkward(k), ending, all_quoted)
    want = readers.read_csv(spark, str(folder), SCHEMA)
    got = read_csv_in_splits(spark, str(folder), SCHEMA)
    assert got.schema == want.schema
    assert rows(got) == rows(want) and want.count() == 360
    kinds = {r["kind"]: r["count"] for r in _records(spark, str(folder)).groupBy("kind").count().collect()}
    assert kinds[1] > 10 and kinds[2] > 10  # records that lie across splits
    assert _records(spark, str(folder)).select("file", "block").distinct().count() > 30


def test_a_field_across_several_splits(spark, tmp_path, small_splits):
    path = tmp_path / "one.csv"
    data = [("u1", "1", "long\n" * 400, ""), ("u2", "2", "short", "x"), ("u3", "3", '"\n' * 300, "y")]
    write(path, data)
    assert rows(read_csv_in_splits(spark, str(path), SCHEMA)) == rows(readers.read_csv(spark, str(path), SCHEMA))


def test_a_wrong_header_is_refused(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("user_id,text,rating,note\na,b,1,c\n")
    with pytest.raises(ValueError):
        read_csv_in_splits(spark, str(path), SCHEMA)


def test_files_without_rows(spark, tmp_path):
    path = tmp_path / "one.csv"
    write(path, [])
    assert read_csv_in_splits(spark, str(path), SCHEMA).count() == 0


def test_no_record_is_assembled_before_it_is_asked_for(spark, tmp_path, monkeypatch):
    """Headers are checked on first lines, and splits without pieces of records are left out where pieces are looked for."""
    for k in range(4):
        write(tmp_path / f"{k}.csv", [(f"u{k}", "5", "plain", "x"), (f"v{k}", "4", "a,b", 'say "no"'), (f"w{k}", "", " NA ", "")])
    asked = []
    kept = split_csv._of_splits
    monkeypatch.setattr(split_csv, "_of_splits", lambda lines, splits: asked.append(splits.count()) or kept(lines, splits))
    got = read_csv_in_splits(spark, str(tmp_path), SCHEMA)
    assert sorted(asked) == [0, 4]
    assert rows(got) == rows(readers.read_csv(spark, str(tmp_path), SCHEMA)) and got.count() == 12


def test_a_record_is_parsed_once(spark, tmp_path):
    """However many fields are filtered on afterwards: once for whole records, once for those put together."""
    write(tmp_path / "one.csv", awkward(1))
    got = read_csv_in_splits(spark, str(tmp_path), SCHEMA).na.drop(subset=["user_id", "rating", "text"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_csv(") <= 2
    assert rows(got) == rows(readers.read_csv(spark, str(tmp_path), SCHEMA).na.drop(subset=["user_id", "rating", "text"]))

"""One large CSV file with line ends inside quotes, read by many tasks.

Lines are read split by split. The number of quotes before a split, odd or even, tells whether it starts inside a quoted field,
so every task knows on its own where records begin and end. Only a record that lies across splits is put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.session import stored
from ratemill.sources.readers import NA_VALUES, _cast, nullify

#: What a row of `_records` is: a record, the end (or middle) of one that began in an earlier split, the start of one that ends in a later split.
WHOLE, HEAD, TAIL = 0, 1, 2


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split out of its lines, which come in order, a split after the other."""
    at, inside, held, kind = None, False, [], WHOLE
    names = ["file", "block", "kind", "first", "text"]

    def row(text: str, kind: int, first: bool) -> tuple:
        return (*at, kind, first, text)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    first = False
    for batch in batches:
        out: list[tuple] = []
        files, blocks = batch.column("file").to_pylist(), np.asarray(batch.column("block"))
        odd, starts, lines = np.asarray(batch.column("odd")), np.asarray(batch.column("inside")), batch.column("value").to_pylist()
        for k, line in enumerate(lines):
            if at != (files[k], blocks[k]):
                if held:
                    out.append(row("\n".join(held), HEAD if kind == HEAD else TAIL, first))
                at, inside, held = (files[k], int(blocks[k])), bool(starts[k]), []
                kind, first = (HEAD if inside else WHOLE), blocks[k] == 0
            inside ^= bool(odd[k])
            if inside:
                held.append(line)
            else:
                out.append(row("\n".join([*held, line]) if held else line, kind, first))
                held, kind, first = [], WHOLE, False
        if out:
            yield made(out)
    if held:
        yield made([row("\n".join(held), HEAD if kind == HEAD else TAIL, first)])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, odd): the lines of all files, `odd` where a line has an odd number of quotes."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return lines.withColumn("odd", (quotes % 2).cast("int"))


def _splits(lines: DataFrame) -> DataFrame:
    """(file, block, inside, ends_inside, line): a row per split, whether it starts and ends inside a quoted field, and its first line."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("place", F.monotonically_increasing_id()).groupBy("file", "block").agg(F.sum("odd").alias("quotes"), F.min_by("value", "place").alias("line"))
    inside = (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int")
    return counted.withColumn("inside", inside).withColumn("ends_inside", (F.col("inside") + F.col("quotes")) % 2).drop("quotes")


def _of_splits(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, block, kind, first, text): the records of the given splits, those across splits in pieces."""
    # A broadcast join leaves the lines where they are and in order.
    placed = lines.join(F.broadcast(splits.select("file", "block", "inside")), ["file", "block"])
    return placed.mapInArrow(_assembled, "file string, block long, kind int, first boolean, text string")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files, those across splits in pieces."""
    lines = _lines(spark, path)
    return _of_splits(lines, _splits(lines))


def _parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """(text, row): the records with their fields as text. Filters on fields stay behind the explode, so that a record is parsed once."""
    fields = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    row = F.from_csv("text", fields.simpleString()[len("struct<") : -1].replace(":", " "), options)
    return records.select("text", F.explode(F.array(row)).alias("row"))


def read_csv_in_splits(spark: SparkSession, path: str, schema: T.StructType, na_values: tuple[str, ...] = NA_VALUES) -> DataFrame:
    """What read_csv gives with a schema, for files of any size: header, doubled quotes, line ends inside quoted fields.

    Quotes have to be as RFC 4180 asks: a field that holds one is quoted, and doubles it. Each file is split wherever Spark splits
    text; the files are read twice, once for their quotes. A file whose header is not that of `schema` is an error. Lines without
    anything are passed over, as other readers do.
    """
    lines = _lines(spark, path)
    splits = stored(_splits(lines))
    wanted = F.array(*[F.lit(f.name) for f in schema])

    def check(heads: DataFrame) -> None:
        header = F.array(*[F.col("row")[f.name] for f in schema])
        wrong = _parsed(heads, schema).where(~header.eqNullSafe(wanted)).select("text").take(1)
        if wrong:
            raise ValueError(f"the header {wrong[0]['text']!r} does not name the columns {', '.join(f.name for f in schema)}")

    # Only where a header's first line ends inside quotes, all records are gone through for the headers.
    line = F.regexp_replace("line", r"\r\z", "")
    heads = splits.where("block = 0").select(line.alias("text"), ((F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))) % 2).alias("odd"))
    check(heads.where("odd = 0 and text <> ''"))

    # Pieces lie only in splits that start or end inside a record.
    broken = splits.where("inside = 1 or ends_inside = 1")
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = _of_splits(lines, broken).where(F.col("kind") != WHOLE).withColumn("number", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    in_order = F.sort_array(F.collect_list(F.struct("block", "kind", "text")))
    stitched = pieces.groupBy("file", "number").agg(F.bool_or("first").alias("first"), F.array_join(F.transform(in_order, lambda p: p.text), "\n").alias("text"))
    whole = _of_splits(lines, splits).where(F.col("kind") == WHOLE).select("first", "text").unionByName(stitched.select("first", "text"))
    whole = whole.withColumn("text", F.regexp_replace("text", r"\r\z", "")).where("text <> ''")
    if not heads.where("odd = 1").isEmpty():
        check(whole.where(F.col("first")))
    rows = _parsed(whole.where(~F.col("first")), schema)
    return rows.select(*[_cast(nullify(F.col("row")[f.name], na_values), f.dataType).alias(f.name) for f in schema])

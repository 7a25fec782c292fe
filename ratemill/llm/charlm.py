"""Interpolated Kneser-Ney models of characters within words, counted on Spark.

Small models are kept in sorted arrays and sent to the tasks; larger ones are estimated on Spark, kept as tables, and
joined with the grams of blocks of documents. Both give each gram the same probability; none is left out.

A symbol is a folded code point; a word is a run of symbols, with a mark before and after it. The four symbols up to a
place make one 64-bit gram, so shorter grams and contexts are bit ranges of it. Tasks count and score each distinct
word of a slice of text once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.llm import words
from ratemill.llm.tables import written

ORDER = 4
_START, _END, _FOLD = 1, 2, 0xF000
_MASKS = [words.U((1 << 16 * n) - 1) for n in range(ORDER)] + [words.U(0xFFFFFFFFFFFFFFFF)]
_MOST_GRAMS = 1 << 20
#: Grams times labels (four at least) of the largest model that is sent to the tasks; a larger one stays on Spark, with equal results.
HELD = 1 << 24
#: Bytes of text whose grams are looked up together in a model on Spark.
BLOCK_BYTES = 16 << 20
_tables: dict[str, np.ndarray] = {}
_SYMBOL = words.mix(np.arange(1, 65537, dtype=np.uint64))


def _fold(kind: str) -> np.ndarray:
    """Code point -> symbol, 0 between words. `letters`: lower-case letters; `visible`: all but white space, as it is."""
    if kind not in _tables:
        table = np.zeros(0x110000, np.uint16)
        for point in range(0x110000):
            char = chr(point)
            if kind == "letters":
                symbol = ord(char.lower()[0]) if char.isalpha() else 0
            else:
                symbol = 0 if char.isspace() else max(point, 3)
            table[point] = symbol if symbol < _FOLD else _FOLD + symbol % 0xE00
        _tables[kind] = table
    return _tables[kind]


@dataclass
class Spelled:
    """The distinct words of some texts: their grams and where each word's begin; of each word in the texts, its text and number."""

    grams: np.ndarray
    first: np.ndarray
    text: np.ndarray
    word: np.ndarray


def spell(column: pa.Array, kind: str) -> Spelled:
    data, offsets = words.text_bytes(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    symbols = _fold(kind)[points]
    bounds = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    start, end, text = words.runs(symbols > 0, bounds)
    _, one, word = np.unique(words.word_hashes(symbols, start, end, _SYMBOL), return_index=True, return_inverse=True)
    start, end = start[one], end[one]
    size = end - start + 2
    first = np.cumsum(size) - size
    total = int(size.sum())
    place = np.arange(total) - np.repeat(first, size)
    spelled = np.full(total, _END, np.uint64)
    spelled[first] = _START
    inner = (place > 0) & (place < np.repeat(size - 1, size))
    spelled[inner] = symbols[(np.repeat(start, size) + place - 1)[inner]]
    grams = spelled.copy()
    for back in range(1, ORDER):
        grams[back:] |= np.where(place[back:] >= back, spelled[:-back], words.U(0)) << words.U(16 * back)
    return Spelled(grams[place > 0], first - np.arange(len(first)), text, word)


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(grams, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)


def count(docs: DataFrame, kind: str) -> DataFrame:
    """label, gram, n of `docs` (label, text): how often each four-symbol gram stands in the texts of each label.

    A written table: the texts are read once, though the fit looks at the counts twice.
    """

    def emit(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for label, parts in held.items():
            grams, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], ["label", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for part in words.slices(batch, "text"):
                labels = part.column("label").dictionary_encode()
                codes = np.asarray(labels.indices)
                spelled = spell(part.column("text"), kind)
                lengths = np.diff(np.append(spelled.first, len(spelled.grams)))
                for code, label in enumerate(labels.dictionary.to_pylist()):
                    times = np.bincount(spelled.word[codes[spelled.text] == code], minlength=len(lengths))
                    weight = np.repeat(times, lengths)
                    found = _summed(spelled.grams[weight > 0], weight[weight > 0])
                    held.setdefault(label, []).append(found)
                    size += len(found[0])
                if size > 4 * _MOST_GRAMS:  # bounded memory: what is counted so far leaves the task
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    return written(docs.mapInArrow(run, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")))


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the values stand there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    spot = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return spot, table[spot] == wanted


@dataclass
class Model:
    """By order 1..4: sorted grams with a probability for each label, sorted contexts with a back-off weight for each."""

    labels: list[str]
    grams: list[np.ndarray]
    chance: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]
    unseen: np.ndarray

    def probabilities(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """(grams, labels): the interpolated probability of the last symbol after those before it."""
        if order == 0:
            return np.broadcast_to(self.unseen, (len(grams), len(self.labels)))
        grams = grams & _MASKS[order]
        spot, there = _find(self.grams[order - 1], grams)
        out = np.empty((len(grams), len(self.labels)), np.float32)
        out[there] = self.chance[order - 1][spot[there]]
        rest = np.flatnonzero(~there)
        if len(rest):
            out[rest] = self.backoff(grams[rest], order) * self.probabilities(grams[rest], order - 1)
        return out

    def backoff(self, grams: np.ndarray, order: int) -> np.ndarray:
        spot, there = _find(self.contexts[order - 1], grams >> words.U(16))
        out = np.ones((len(grams), len(self.labels)), np.float32)
        out[there] = self.weight[order - 1][spot[there]]
        return out


def _cuts(having: dict[int, int], modified: bool) -> np.ndarray:
    """Discounts for counts 1, 2 and 3 or more; `having`: how many grams occur one to four times."""
    n1, n2, n3, n4 = (max(1, having.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    if not modified:
        return np.full(3, y)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.9, 2.9])


def _discounts(counts: np.ndarray, modified: bool) -> np.ndarray:
    return _cuts({k: int((counts == k).sum()) for k in (1, 2, 3, 4)}, modified)


def _short(gram: Column, order: int) -> Column:
    return gram if order == ORDER else gram.bitwiseAND(F.lit(int(_MASKS[order])))


@dataclass
class TableModel:
    """A model on Spark. By order 1..4: (gram, p: label -> probability), and (context, w: label -> back-off weight) above order 1."""

    labels: list[str]
    chance: list[DataFrame]
    weight: list[DataFrame | None]
    first: list[float]
    unseen: list[float]

    def costs(self, grams: DataFrame) -> DataFrame:
        """gram, bits (one for each label) of `grams` (distinct gram)."""
        out = grams.select("gram", F.array(*map(F.lit, self.unseen)).alias("below"))
        for order in range(1, ORDER + 1):
            chance, short = self.chance[order - 1].withColumnRenamed("gram", "known"), _short(F.col("gram"), order)
            # There are no more single symbols than 2^16.
            out = out.join(F.broadcast(chance) if order == 1 else chance, short == F.col("known"), "left").drop("known")
            weights = [F.lit(w) for w in self.first]
            if order > 1:
                weight = self.weight[order - 1]
                out = out.join(F.broadcast(weight) if order == 2 else weight, F.shiftrightunsigned(short, 16) == F.col("context"), "left").drop("context")
                weights = [F.coalesce(F.try_element_at("w", F.lit(k)), F.lit(1.0)) for k in range(len(self.labels))]
            each = [F.coalesce(F.try_element_at("p", F.lit(k)), w * F.col("below")[k]) for k, w in enumerate(weights)]
            out = out.select("gram", F.array(*each).alias("below"))
        return out.select("gram", F.array(*(-F.log2(F.col("below")[k]) for k in range(len(self.labels)))).alias("bits"))


def fit(counts: DataFrame, modified: bool) -> Model | TableModel:
    """The model of `counts` (label, gram, n), from all grams: held by the driver if it is small, on Spark otherwise."""
    sizes = {r["label"]: r["grams"] for r in counts.groupBy("label").agg(F.count(F.lit(1)).alias("grams")).collect()}
    if sum(sizes.values()) * max(4, len(sizes)) > HELD:
        return _on_spark(counts, sorted(sizes), modified)
    table = counts.toArrow().combine_chunks()
    return estimate(table.column("label").to_pylist(), np.asarray(table.column("gram"), np.int64).view(np.uint64), np.asarray(table.column("n"), np.int64), modified)


def _on_spark(counts: DataFrame, labels: list[str], modified: bool) -> TableModel:
    """What `estimate` does, on tables: only discounts and the end of the back-off, a few numbers a label, reach the driver."""
    code = (F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("int")
    by_order = [counts.select(code.alias("label"), "gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        by_order.insert(0, written(by_order[0].groupBy("label", _short(F.col("gram"), order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    symbols = {r["label"]: r["n"] for r in by_order[0].groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = TableModel(labels, [], [], [], [1 / max(256, 1 + symbols[k]) for k in range(len(labels))])
    lower = None
    for order, table in enumerate(by_order, 1):
        having: list[dict[int, int]] = [{} for _ in labels]
        for r in table.where("n <= 4").groupBy("label", "n").agg(F.count(F.lit(1)).alias("grams")).collect():
            having[r["label"]][r["n"]] = r["grams"]
        cuts = F.array(*(F.array(*map(F.lit, _cuts(h, modified).tolist())) for h in having))
        table = table.withColumn("cut", cuts[F.col("label")][F.least(F.col("n"), F.lit(3)).cast("int") - 1])
        context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
        table = table.withColumn("context", context)
        totals = written(table.groupBy("label", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("lost")).withColumn("weight", F.col("lost") / F.col("total")))
        share = (F.col("n") - F.col("cut")) / F.col("total")
        table = table.join(F.broadcast(totals) if order == 1 else totals, ["label", "context"])
        if lower is None:
            first = {r["label"]: r["weight"] for r in totals.collect()}
            model.first += [first[k] for k in range(len(labels))]
            model.weight.append(None)
            rest = F.col("weight") * F.array(*map(F.lit, model.unseen))[F.col("label")]
        else:
            model.weight.append(written(totals.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("w"))))
            table = table.withColumn("low", _short(F.col("gram"), order - 1)).join(lower.select("label", F.col("gram").alias("low"), F.col("p").alias("below")), ["label", "low"])
            rest = F.col("weight") * F.col("below")
        lower = written(table.select("label", "gram", (share + rest).alias("p")))
        model.chance.append(written(lower.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("p"))))
    return model


def estimate(label: list[str], gram: np.ndarray, n: np.ndarray, modified: bool) -> Model:
    labels = sorted(set(label))
    code = np.searchsorted(labels, label) if labels else np.zeros(0, np.int64)
    model = Model(labels, [], [], [], [], np.zeros(len(labels), np.float32))
    own = [(gram[code == k], n[code == k]) for k in range(len(labels))]
    for k, (grams, _) in enumerate(own):
        model.unseen[k] = 1 / max(256, 1 + len(np.unique(grams & _MASKS[1])))
    # Counts of an order below the top are those of distinct symbols before the gram.
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [own]
    for order in range(ORDER - 1, 0, -1):
        by_order.insert(0, [_summed(g & _MASKS[order], np.ones(len(g))) for g, _ in by_order[0]])
    for order in range(1, ORDER + 1):
        tables = by_order[order - 1]
        every = np.unique(np.concatenate([g for g, _ in tables])) if labels else np.zeros(0, np.uint64)
        contexts = np.unique(every >> words.U(16)) if order > 1 else np.zeros(min(1, len(every)), np.uint64)
        share = np.zeros((len(every), len(labels)), np.float32)
        weight = np.ones((len(contexts), len(labels)), np.float32)
        for k, (grams, counts) in enumerate(tables):
            cut = _discounts(counts, modified)[np.minimum(counts, 3) - 1]
            place = np.searchsorted(contexts, grams >> words.U(16) if order > 1 else np.zeros(len(grams), np.uint64))
            total = np.bincount(place, counts, len(contexts))
            lost = np.bincount(place, cut, len(contexts))
            seen = total > 0
            weight[seen, k] = lost[seen] / total[seen]
            share[np.searchsorted(every, grams), k] = (counts - cut) / total[place]
        model.grams.append(every)
        model.contexts.append(contexts)
        model.weight.append(weight)
        model.chance.append(share + model.backoff(every if order > 1 else np.zeros(len(every), np.uint64), order) * model.probabilities(every, order - 1))
    return model


Result = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[pa.Array]]


def _measured(part: pa.RecordBatch, kind: str, labels: int, costs: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bits in all (texts, labels) and symbols of the texts of a slice, from the (grams, labels) costs of its distinct grams."""
    spelled = spell(part.column("text"), kind)
    bits = np.zeros((len(spelled.first), labels))
    lengths = np.diff(np.append(spelled.first, len(spelled.grams)))
    if len(spelled.grams):
        distinct, inverse = np.unique(spelled.grams, return_inverse=True)
        bits = np.add.reduceat(costs(distinct)[inverse], spelled.first, axis=0)
    total = np.zeros((len(part), labels))
    for k in range(labels):
        total[:, k] = np.bincount(spelled.text, bits[spelled.word, k], len(part))
    return total, np.bincount(spelled.text, lengths[spelled.word], len(part)).astype(np.int64)


def scored(docs: DataFrame, model: Model | TableModel, kind: str, result: Result, schema, names: list[str]) -> DataFrame:
    """Rows made by `result` from a slice of `docs`, its (texts, labels) bits in all, and its texts' symbols (word ends included)."""
    if isinstance(model, TableModel):
        return _scored_by_joins(docs, model, kind, result, schema, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                total, symbols = _measured(part, kind, len(model.labels), lambda grams: -np.log2(model.probabilities(grams)))
                yield pa.RecordBatch.from_arrays(result(part, total, symbols), names)

    return docs.mapInArrow(run, schema)


def _scored_by_joins(docs: DataFrame, model: TableModel, kind: str, result: Result, schema, names: list[str]) -> DataFrame:
    """As `scored`: blocks of texts that lie together are joined with the costs of their distinct grams."""
    labels = len(model.labels)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in words.slices(batch, "text"):
                if size > BLOCK_BYTES:
                    block, size = block + 1, 0
                size += len(words.text_bytes(part.column("text"))[0]) + 64 * len(part)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), block))], [*part.schema.names, "gram_block"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for block, grams in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block)), pa.array(grams.view(np.int64))], ["gram_block", "gram"])
            held.clear()

        for batch in batches:
            for part in words.slices(batch, "text"):
                blocks = np.asarray(part.column("gram_block"))
                for block in np.unique(blocks).tolist():
                    if block not in held and len(held) > 1:
                        yield from emit()
                    grams = spell(part.column("text").filter(pa.array(blocks == block)), kind).grams
                    held[block] = np.unique(np.concatenate((held.get(block, np.zeros(0, np.uint64)), grams)))
        yield from emit()

    def answer(texts: pa.Table, costs: pa.Table) -> pa.Table:
        grams, one = np.unique(np.asarray(costs.column("gram").combine_chunks(), np.int64).view(np.uint64), return_index=True)
        bits = costs.column("bits").combine_chunks()
        table = words.flat(bits.chunk(0) if isinstance(bits, pa.ChunkedArray) else bits)[0].reshape(-1, labels)[one] if len(grams) else np.zeros((0, labels))
        out = []
        for batch in texts.combine_chunks().to_batches():
            for part in words.slices(batch, "text"):
                total, symbols = _measured(part, kind, labels, lambda wanted: table[np.searchsorted(grams, wanted)])
                out.append(pa.RecordBatch.from_arrays(result(part, total, symbols), names))
        return pa.Table.from_batches(out)

    rows = written(docs.mapInArrow(blocked, T.StructType([*docs.schema, T.StructField("gram_block", T.LongType())])))
    pairs = written(rows.select("gram_block", "text").mapInArrow(asked, "gram_block long, gram long"))
    costs = pairs.join(model.costs(pairs.select("gram").distinct()), "gram").select("gram_block", "gram", "bits")
    return rows.groupBy("gram_block").cogroup(costs.groupBy("gram_block")).applyInArrow(answer, schema)

"""Secrets in texts, with multipart credentials linked; DataFrame functions only.

Assignments, access identifiers and hexadecimal runs are reported as they stand. Weak parts (identifiers, mixed-class
blobs, endpoints) say little alone; they are reported where complementary parts stand within one scope: a blob near an
identifier, an identifier near a secret, an endpoint near both. Parts meet by an interval join on document and scope.
Texts are scanned once; lengths of matches and of what stands between them are written, and running sums give their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratemill.llm.tables import written

#: Kinds in the order in which equal starts are listed: the base kinds, then the weak ones.
KINDS = ("assign", "access", "hex", "key_id", "blob", "endpoint")
#: Fixed patterns of the base kinds, as Java reads them; hexadecimal runs are whole runs, so their length is in the pattern.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KEY_ID = r"""(?i:(?:access_?)?key_?id|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]{4,}"""
BLOB = r"(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"
PATTERNS = (ASSIGN, ACCESS, HEX, KEY_ID, BLOB, ENDPOINT)
BASE = 3
_SPANS = "array<struct<start: int, kind: int, end: int>>"


#: One match: its kind and number, and the lengths of the text before it, of itself and of its value.
_MATCHES = "array<struct<kind: int, number: int, gap: int, size: int, value: int>>"
KEY = ["key1", "key2"]


def _found(text: Column, kind: int) -> Column:
    """All matches of a kind, in order, each with the length of the text since the one before, in code points."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else matches
    rows = F.slice(F.arrays_zip(matches.alias("match"), values.alias("value"), F.split(text, pattern, -1).alias("gap")), F.lit(1), F.size(matches))

    def lengths(row: Column, number: Column) -> Column:
        sizes = (F.length(row[a]).alias(b) for a, b in (("gap", "gap"), ("match", "size"), ("value", "value")))
        return F.struct(F.lit(kind).alias("kind"), number.alias("number"), *sizes)

    return F.when(text.rlike(pattern), F.transform(rows, lengths)).otherwise(F.expr(f"cast(array() as {_MATCHES})"))


def row_keys(*columns: str) -> list[Column]:
    """Two hashes of all that the columns hold and lack: rows with equal keys are equal in them."""
    lacks = [F.col(c).isNull() for c in columns]
    return [F.xxhash64(F.lit(seed), *lacks, *columns).alias(name) for seed, name in enumerate(KEY)]


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    lines = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.concat_ws(",", lines)


def _role(kind: Column) -> Column:
    """identifier: access, key_id; secret: assign, hex, blob; endpoint."""
    return F.when(kind.isin(1, 3), "identifier").when(kind == 5, "endpoint").otherwise("secret")


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, base (array of spans of the base kinds), linked (array of reported weak spans), key1 and key2 of `docs` (doc_id, text).

    A span is (start, kind as a place in KINDS, end): code points, end exclusive. Two parts are in one scope if at most
    `scope` code points lie between them. Null and empty texts have no spans. Every row is judged by its own text, whether its
    id is missing or stands twice; key1 and key2 are row_keys("doc_id", "text"). Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    matches = F.concat(*(_found(text, k) for k in range(len(KINDS)))).alias("matches")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = written(docs.select("doc_id", *row_keys("doc_id", "text"), matches))

    once = scanned.where(F.size("matches") > 0).groupBy(*KEY).agg(F.first("matches").alias("matches"))
    so_far = Window.partitionBy(*KEY, "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = once.select(*KEY, F.inline("matches")).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    parts = parts.where((F.col("kind") != 0) | (F.col("value") >= 6)).withColumn("start", F.col("end") - F.col("size"))
    parts = written(parts.select(*KEY, "start", "kind", "end", _role(F.col("kind")).alias("role")))

    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    asked = parts.where(F.col("kind") >= BASE).select(*KEY, "start", "kind", "end", "role", F.explode(F.sequence(first, last)).alias("cell"))
    near = parts.select(*KEY, F.col("start").alias("a"), F.col("end").alias("b"), F.col("role").alias("other"), F.explode(F.sequence(first - 1, last + 1)).alias("cell")).distinct()
    met = asked.join(near, [*KEY, "cell"]).where((F.col("other") != F.col("role")) & (F.greatest("start", "a") - F.least("end", "b") <= scope))
    roles = met.groupBy(*KEY, "start", "kind", "end", "role").agg(
        F.max(F.col("other") == "identifier").alias("identifier"), F.max(F.col("other") == "secret").alias("secret")
    )
    complete = F.when(F.col("role") == "endpoint", F.col("identifier") & F.col("secret")).when(F.col("role") == "secret", F.col("identifier")).otherwise(F.col("secret"))
    shown = parts.where(F.col("kind") < BASE).unionByName(roles.where(complete).select(*KEY, "start", "kind", "end", "role"))
    spans = shown.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    out = scanned.select("doc_id", *KEY).join(spans, KEY, "left")
    every = F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})"))
    base, linked = F.filter(every, lambda s: s["kind"] < BASE), F.filter(every, lambda s: s["kind"] >= BASE)
    return out.select("doc_id", base.alias("base"), linked.alias("linked"), *KEY)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of `find_secrets`."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(BASE)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "linked")).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """`text` with every stretch covered by spans replaced by `mask`; spans may overlap."""

    def step(seen: Column, s: Column) -> Column:
        upto = F.greatest(seen["at"], s["end"])
        gap = F.substring(text, seen["at"] + 1, s["start"] - seen["at"])
        out = F.when(s["start"] >= seen["at"], F.concat(seen["out"], gap, F.lit(mask))).otherwise(seen["out"])
        return F.struct(upto.alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(spans), start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))

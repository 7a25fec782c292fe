"""Periodic runs against every stretch of every period."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ratemill.llm import periodic, words
from ratemill.llm.queries import op11_periodic_runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def brute(w, least=24, exponent=3):
    """{(start, length): smallest period} of all runs of the list `w`."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def samples(seed):
    rng = random.Random(seed)
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    out = [[], ["x"], ["x"] * 23, ["x"] * 24, ["x"] * 3000, list("ab") * 700 + ["c"] + list("ab") * 500, list(fib[-1][:900]), list("xyz") * 8, list("xyz") * 8 + ["x", "y"], [str(k) for k in range(1000)]]
    for _ in range(40):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        w = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 11, 40, 150]))]
            w += (unit * rng.randint(1, 12))[: rng.randint(1, 600)] + [rng.choice(letters) for _ in range(rng.randint(0, 20))]
        if rng.random() < 0.3:  # runs of runs
            w = w[:200] * 4
        out.append(w)
    return out


@pytest.mark.parametrize("least, exponent", [(24, 3), (5, 2), (40, 4)])
def test_runs_equal_brute_force(least, exponent):
    texts = samples(least)
    ids = {x: k for k, x in enumerate(sorted({x for t in texts for x in t}))}
    hashes = words.mix(np.array([ids[x] for t in texts for x in t], np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = list(zip(*(a.tolist() for a in periodic.find_runs(hashes, bounds, least, exponent))))
    want = [(k, *r) for k, t in enumerate(texts) for r in brute(t, least, exponent)]
    assert found == want


def test_small_groups_and_chunks(monkeypatch):
    monkeypatch.setattr(periodic, "_INDEXED", 100)
    monkeypatch.setattr(periodic, "_PAIRS", 7)
    test_runs_equal_brute_force(24, 3)


def test_common_extensions_of_every_pair():
    rng = random.Random(2)
    for t in (rng.choices([1, 2], k=150), [1] * 90, [1, 2, 3] * 40, list(range(70)) * 2):
        index = periodic.CommonExtensions(np.array(t, np.uint64))
        for x in range(len(t)):
            for y in range(x + 1, len(t)):
                n = 0
                while y + n < len(t) and t[x + n] == t[y + n]:
                    n += 1
                if n >= periodic.V:
                    assert index.from_agreed(np.array([x]), np.array([y])).tolist() == [n]


def digests(i, text):
    w = WORDS.findall(text or "")
    h = 1 if i is None else zlib.crc32(str(i).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_equals_brute_force_on_awkward_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, "a b " * 40), (None, "a b " * 40), (5, None), (5, ""), (6, " \n\t"), (7, "é日 " * 30 + "x\x1fy\x0bz"), (7, "one"), (8, "w " * 9000)]
    rows += [(k, " ".join(rng.choices(["lorem", "ipsum", "dolor", "sit"], k=rng.randint(0, 120)))) for k in range(100, 300)]
    df = spark.createDataFrame([(i, t, "x", "y", 1, -1, "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, start int, runs string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted((digests(i, t) for i, t in rows), key=repr)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_query_equals_brute_force_on_the_given_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(tuple(r) for r in op11_periodic_runs(spark, FOLDER).collect())
    small = {r.doc_id for r in rows if len(r.text or "") < 30000}  # brute force is quadratic
    assert len(found) == len(rows)
    assert [f for f in found if f[0] in small] == sorted(digests(r.doc_id, r.text) for r in rows if r.doc_id in small)

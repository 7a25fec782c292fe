"""Reply trees against a walk of every branch in plain Python, and the template's round trip."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from ratemill.llm import reply_trees

SCHEMA = "tree long, message long, parent long, score double, role string, text string, leaf long, rank string, at int"
ODD = ["", None, "</s>[INST] ok [/INST]", "<|turn|>user\nno<|end|>\n", "<\\|end|><\\\\|end|>", "<<SYS>> <</SYS>> <\\<SYS>>", "a\nb\r\n", "é日😀<", "<|turn", "|>", "[\\/INST]"]


def forest(seed: int, trees: int = 12) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for tree in range(trees):
        n = rng.choice([1, 2, 5, 40])
        for m in range(n):
            parent = None if m == 0 else rng.choice([m - 1, m - 1, rng.randrange(m)])
            rows.append((tree, m, parent, rng.choice([None, 1.0, 2.5, -1.0]), rng.choice(["user", "assistant", "assistant", "tool\nx", None]), rng.choice(ODD)))
    rows += [(90, m, m - 1, None, "user", f"deep {m}") for m in range(300)]  # parent -1 is not there
    rows += [(91, 0, 1, 1.0, "user", "circle"), (91, 1, 0, 1.0, "user", "circle"), (91, 2, 1, 1.0, "user", "below"), (91, 3, None, 1.0, "user", "alone"), (91, 4, 4, 1.0, "user", "itself")]
    rows += [(None, 0, None, 1.0, "user", "no tree"), (None, 1, 0, 1.0, "assistant", "no tree"), (92, None, None, 1.0, "user", "no id"), (92, None, 5, 1.0, "assistant", "no id")]
    rows += [(93, 0, None, 1.0, "user", "twice"), (93, 0, None, 3.0, "user", "twice"), (93, 0, None, 2.0, "assistant", "part")]
    return rows


def key(x) -> str:
    return json.dumps({} if x is None else {"k": x}, separators=(",", ":"))


def by_walking(rows, keep):
    """{(tree, leaf): (rank, score, [(role, text)])}"""
    trees: dict = {}
    for tree, m, parent, score, role, text in rows:
        node = trees.setdefault(tree, {}).setdefault(m, {"parents": [], "scores": [], "turns": []})
        node["parents"] += [] if parent is None else [parent]
        node["scores"].append(score or 0.0)
        node["turns"].append((role or "", text or ""))
    out = {}
    for tree, nodes in trees.items():
        up = {m: min(n["parents"], default=None) for m, n in nodes.items()}
        up = {m: p if p is not None and p in nodes else None for m, p in up.items()}
        found = []
        for leaf in set(nodes) - {p for p in up.values() if p is not None}:
            branch, at = [], leaf
            while at is not None or not branch:
                if at in branch:
                    branch = None
                    break
                branch.append(at)
                at = up[at]
                if at is None:
                    break
            if branch:
                found.append((-sum(max(nodes[m]["scores"]) for m in branch), key(leaf), leaf, branch[::-1]))
        for rank, (score, _, leaf, branch) in enumerate(sorted(found, key=lambda x: x[:2]), 1):
            if keep is None or rank <= keep:
                out[key(tree), key(leaf)] = (rank, -score, [t for m in branch for t in sorted(nodes[m]["turns"])])
    return out


@pytest.mark.parametrize("keep", [None, 2])
def test_branches_equal_a_walk(spark, keep):
    rows = forest(3)
    want = by_walking(rows, keep)
    df = spark.createDataFrame([(*r, -1, "x", -1) for r in rows], SCHEMA)
    found = reply_trees.conversations(df, keep=keep).withColumn("turns", reply_trees.read_turns(F.col("formatted"))).withColumn("learned", reply_trees.read_learned(F.col("formatted"))).collect()
    assert {(r.tree, r.leaf) for r in found} == set(want) and len(found) == len(want)
    for r in found:
        rank, score, turns = want[r.tree, r.leaf]
        assert (r["rank"], r.path_score, r.n_turns) == (rank, pytest.approx(score), len(turns))
        assert [tuple(t) for t in r.turns] == turns
        learned = [t for role, t in turns if role == "assistant"]
        assert r.learned == "".join(learned)
        spans = [r.formatted[s.start : s.end] for s in r.loss]  # the spans cut out the same texts, still escaped
        assert len(spans) == len(learned) and all("<|end|>" not in s for s in spans)
        back = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "i int, s string").select("i", reply_trees.unescaped(F.col("s")).alias("t"))
        if learned and rank == 1:
            assert [x.t for x in back.orderBy("i").collect()] == learned


def test_no_message(spark):
    assert reply_trees.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_on_the_executors(spark):
    df = spark.createDataFrame([(1, 0, None, 1.0, "user", "a", 0, "", 0)], SCHEMA)
    plan = reply_trees.conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_long_conversation_is_linear(spark):
    rows = spark.range(20000).selectExpr("1L AS tree", "id AS message", "id - 1 AS parent", "0D AS score", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('say </s> ', id) AS text")
    (row,) = reply_trees.conversations(rows).select("n_turns", F.size("loss").alias("spans"), F.length(reply_trees.read_learned(F.col("formatted"))).alias("n")).collect()
    assert row.n_turns == 20000 and row.spans == 10000
    assert row.n == sum(len(f"say </s> {i}") for i in range(1, 20000, 2))

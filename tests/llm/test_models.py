"""Vectors, pages, language models and the pipeline, against brute force and planted cases."""

from __future__ import annotations

import collections
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratemill.llm import charlm, components, embed_dup, langid, quality, wrapper
from ratemill.llm.queries import QUERIES, trusted
from llm.test_documents import table

FOLDER = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(205, 203), (203, 201), (201, 205), (300, 300)]
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, **{k: 201 for k in (201, 203, 205)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(vectors: dict[int, list | None]) -> tuple[dict[int, int], dict[int, int]]:
    sound = {i: np.array(v, float) for i, v in vectors.items() if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in sound.items()}
    links, least = dict.fromkeys(vectors, 0), {i: i for i in vectors}
    pairs = [(i, j) for i in unit for j in unit if i < j and unit[i] @ unit[j] >= 0.95]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in vectors:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return links, least


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors: dict[int, list | None] = {1: None, 2: [], 3: [0.0] * 16, 4: [float("nan")] + [1.0] * 15, 5: [float("inf")] * 16, 6: [None] + [1.0] * 15}
    for group in range(6):
        centre = rng.normal(size=16)
        for k in range(14):
            noise = (0.02, 0.06, 0.09)[k % 3]
            v = centre + noise * np.linalg.norm(centre) * rng.normal(size=16) / 2
            vectors[100 + 20 * group + k] = v.tolist()
        vectors[100 + 20 * group + 15] = vectors[100 + 20 * group]
        vectors[100 + 20 * group + 16] = (2 * np.array(vectors[100 + 20 * group])).tolist()
    vectors[900], vectors[901] = [1e-320] * 16, [1e300] * 16
    links, least = brute_links({k: v for k, v in vectors.items() if k < 900})
    frame = table(spark, list(vectors.items()), "vec_id long, embedding array<double>").drop("label")
    for chunk in (embed_dup.CHUNK, 3):
        monkeypatch.setattr(embed_dup, "CHUNK", chunk)
        found = embed_dup.near_vectors(frame).toPandas().set_index("vec_id")
        counts = found.n_links.to_dict()
        assert all(counts[i] <= n for i, n in links.items())
        assert sum(counts[i] for i in links) >= 0.97 * sum(links.values())
        assert all(counts[i] == 0 for i in range(1, 7)) and counts[115] == counts[100] >= 2
        assert (found.component_id.loc[list(least)] == pd.Series(least)).mean() > 0.97
        assert (found.kept == (found.index == found.component_id)).all() and len(found) == len(vectors)
        assert counts[900] == counts[901] == 1
    assert embed_dup.near_vectors(table(spark, [], "vec_id long, embedding array<float>")).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="x">'
    '<header><a href="/">Site</a></header><nav><ul><li>{menu}<li>b</ul></nav><div class="cookie-notice">We use cookies {n}</div>'
    '<div id="wrap"><div class="story"><h2>Head {n} &amp; &eacute;</h2><div>Share this story</div><p>First <b>para</b>\n {body}<p>Second&nbsp;{n}<br>line</p>'
    '<form><input name="q">Search {n}</form></div><div class="sidebar"><p>Also {n}</p></div></div>'
    '<div class="comments"><p>Nice {n}!</p></div><div class="ad">Buy {menu}</div><!-- c {n} --><footer>&copy; {n}</footer></body></html>'
)


def page_rows() -> list[tuple]:
    rows = [(k, f"http://Host.example.com:80/{k}", PAGE.format(n=k, menu=f"m{k * 7 % 5}", body="text " * (k + 3))) for k in range(12)]
    rows += [(100 + k, "https://host.example.com/copy", rows[0][2]) for k in range(30)]
    return rows


def test_main_text_of_pages_with_one_template(spark):
    found = {r["page_id"]: r["text"] for r in wrapper.main_text(table(spark, page_rows(), "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert found[k] == f"Head {k} & é\n\nFirst para {('text ' * (k + 3)).strip()}\n\nSecond {k} line"
    assert all(found[100 + k] == found[0] for k in range(30))


def test_pages_that_share_an_id(spark):
    rows = page_rows()
    rows = [*rows, rows[3], (3, "http://host.example.com/3", rows[4][2]), (None, None, rows[5][2]), (None, None, rows[5][2])]
    found = wrapper.main_text(table(spark, rows, "page_id long, url string, html string")).collect()
    texts = collections.Counter(r["text"][:7] for r in found if r["page_id"] == 3)
    assert len(found) == len(rows) and texts == {"Head 3 ": 2, "Head 4 ": 1}
    assert sum(r["page_id"] is None and r["text"].startswith("Head 5") for r in found) == 2


def test_main_text_of_odd_pages(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    rows = [
        (1, None, None), (2, "not a url", ""), (3, "http://a/", "just text &lt;b&gt; here"), (4, "http://a/", "<p>unclosed <p>two"),
        (5, "http://b/", "<article><h1>One</h1><p>x &#233; y</p></article"), (6, "http://c/", deep), (7, "http://d/", "<nav>only a menu</nav>"),
        (8, "http://e/", "<main><p>" + "long " * 100_000 + "</p></main>"), (None, "http://f/", "<p>no id</p>"), (9, "http://g/", "< b <p>a < b</p> <!-- open"),
    ]
    found = {r["page_id"]: r["text"] for r in wrapper.main_text(table(spark, rows, "page_id long, url string, html string")).collect()}
    assert found[1] == found[2] == found[7] == "" and found[3] == "just text <b> here" and found[4] == "unclosed\n\ntwo"
    assert found[5].startswith("One\n\nx é y") and "deep text" in found[6] and found[8] == ("long " * 100_000).strip() and found[None] == "no id"
    assert "a < b" in found[9]
    assert wrapper.main_text(table(spark, [], "page_id long, url string, html string")).count() == 0


@given
def test_main_text_of_given_pages_is_their_article(spark):
    import html as entities

    found = {r["page_id"]: r["text"] for r in QUERIES["op2_html_extraction"](spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page["html"] or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
        assert found[page["page_id"]] == "\n\n".join(x for x in parts if x)


def test_tree_matching_keeps_parents_and_order():
    a = ("x", (("p", ()), ("q", (("r", ()),)), ("p", ())))
    b = ("x", (("q", (("r", ()), ("s", ()))), ("p", ())))
    assert wrapper.match(a, b) == 4 and wrapper.align(a, b) == {0: 0, 2: 1, 3: 2, 4: 4} and wrapper.match(a, ("y", a[1])) == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    text = ["".join(rng.choice(list("abcab"), 4)) + " abc" for _ in range(60)]
    import pyarrow as pa

    spelled = charlm.spell(pa.array(text), "letters")
    lengths = np.diff(np.append(spelled.first, len(spelled.grams)))
    grams, counts = charlm._summed(spelled.grams, np.repeat(np.bincount(spelled.word), lengths))
    for modified in (False, True):
        model = charlm.estimate(["l"] * len(grams), grams, counts, modified)
        for context in np.unique(grams >> np.uint64(16)):
            symbols = np.arange(65536, dtype=np.uint64)
            seen = np.concatenate((model.grams[0], symbols[:256]))
            total = model.probabilities((context << np.uint64(16)) | np.unique(seen)).sum()
            # What is left is the share of symbols never seen, which the uniform end of the back-off spreads over 256.
            assert 0.97 < total < 1.03


def test_counts_are_those_of_all_texts(spark):
    texts = [("a", "Ab ab"), ("a", "ab"), ("b", "AB!"), ("b", None), ("b", "")] * 3
    found = charlm.count(spark.createDataFrame(texts, "label string, text string"), "letters").collect()
    mark = lambda *s: sum(x << 16 * k for k, x in enumerate(reversed(s)))
    a, b = ord("a"), ord("b")
    word = {mark(1, a): 1, mark(1, a, b): 1, mark(1, a, b, 2): 1}
    assert {(r["label"], r["gram"]): r["n"] for r in found} == {("a", g): 9 for g in word} | {("b", g): 3 for g in word}


@given
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = QUERIES["op3_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    out = found[found.held_out]
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()
    model = langid.learn(docs)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "日本語 " * 3), (5, "thing that and the"), (5, "thing that and the"), (6, "the " * 200_000)]
    seen = langid.predict(table(spark, odd), model).toPandas().sort_values("doc_id").reset_index()
    assert seen.lang_pred[:3].tolist() == ["und"] * 3 and seen.score[:3].tolist() == [0] * 3
    assert seen.lang_pred[3] in model.labels and seen.lang_pred[4:].tolist() == ["en"] * 3
    limits = langid.rejection_limits(docs, model)
    assert set(limits) == set(model.labels)
    strict = langid.predict(table(spark, odd), model, limits).toPandas().set_index("doc_id")
    assert strict.lang_pred[4] == "und" and set(strict.lang_pred[5]) == {"en"}


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    found = langid.predict(table(spark, [(1, "words"), (2, None)]), langid.learn(empty)).collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)] * 2
    judged = quality.judge(spark.createDataFrame([(1, "words", "en"), (2, None, None)], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long"))
    assert {r["doc_id"]: r["rejected"] for r in judged.collect()} == {1: False, 2: True}
    assert quality.judge(empty, spark.createDataFrame([], "doc_id long")).count() == 0


@given
def test_quality_keeps_trusted_text_and_rejects_junk(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = QUERIES["op7_quality_classifier"](spark, FOLDER).join(labels, "doc_id").toPandas()
    good = found[(found.quality == 1) & (found.toxic == 0)]
    assert good.rejected.mean() < 0.02 and found[found.quality == 0].rejected.mean() > 0.6
    extra = [(-1, None, "en"), (-2, "", None), (-3, "  ", "en"), (-4, "THE!! OF!! AND!! ING$$$ " * 40, None), (-5, "the of and ing that", "xx"), (-5, "the of and ing that", "xx")]
    more = docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    seen = quality.judge(more.withColumn("bits", F.lit(1)), trusted(labels)).where("doc_id < 0").toPandas().sort_values("doc_id", ascending=False)
    assert seen.rejected.tolist() == [True, True, True, True, False, False]


@given
def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = {r["doc_id"] for r in quality.judge(docs, trusted(spark.read.parquet(f"{folder}/labels.parquet"))).where("rejected").collect()}
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    squeezed = lambda t: re.sub(r"[^a-z0-9\x80-\U0010ffff]", "", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        assert docs.columns == corpus_pipeline.COLUMNS
        before, now = now, {r["doc_id"]: r["text"] for r in docs.collect()}
        if number == 0:
            assert set(now) == set(before) - judged
        elif number == 1:
            shingles = {}
            for i, t in before.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
                shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            least = {i: i for i in before}
            pairs = [(i, j) for i in before for j in before if i < j and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j])]
            for _ in before:
                for i, j in pairs:
                    least[i] = least[j] = min(least[i], least[j])
            assert set(now) == {i for i, c in least.items() if i == c}
        elif number == 2:
            exact = {i for i, t in before.items() if any(squeezed(x) in squeezed(t) for x in items)}
            assert set(now) == set(before) - exact
        else:
            assert set(now) == set(before) and not any(re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in now.values())
            changed = [i for i in now if now[i] != before[i]]
            assert all("[REDACTED]" in now[i] for i in changed)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, folder).toPandas()
    assert set(packed.doc_id) == set(now) and packed.groupby("sequence_id").length.sum().max() <= 1024
    whole = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert collections.Counter(map(tuple, whole[key].values)) == collections.Counter(map(tuple, packed[key].values))

"""Markup that is awkward to read: scripts, quotes, depth, small hosts, rows with nulls."""

from __future__ import annotations

import time

import pytest


from ratemill.llm import wrapper
from tests.llm.test_page_slots import texts


def flat(page: str) -> list[str]:
    return wrapper.blocks(wrapper.parse(page), set())


@pytest.mark.parametrize(
    "script",
    [
        "<script>for(i=0;i<n;i++){}</script>",
        "<script>if(a<b){x='</div><nav>'}</script>",
        "<script>var s='<!--';</script>",
        "<style>a:after{content:'<b'}</style>",
        "<SCRIPT type=x>'</scripty>' < n</ScRiPt >",
        "<script src=x />",
        "<textarea><p>form</textarea><title>a<b</title>",
        "<noscript><img src='a'></noscript>",
        "<template><div>never</div></template>",
    ],
)
def test_scripts_do_not_swallow_the_page(spark, script):
    pages = [f"<html><body>{script}<article><h1>Head {k}</h1><p>Text {k}</p></article>{script}</body></html>" for k in range(5)]
    assert texts(spark, pages) == [f"Head {k}\n\nText {k}" for k in range(5)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>see <a href=it's>this</a> and <a title='a > b' href=\"x>y\">that</a></p>", ["see this and that"]),
        ("<p>a<!-->b</p><!---><p>c<!-- <p>x --></p>", ["ab", "c"]),
        ("<p>1 < 2 and 3<4 </> <3 &lt;b&gt;</p>", ["1 < 2 and 3<4 <3 <b>"]),
        ("<p class=ad>x</p><p data-class=ad>y</p><p class='a' class='ad'>z</p>", ["y", "z"]),
        ("<p>one</p><!DOCTYPE html><?php echo ?><p>two", ["one", "two"]),
        ("<p a=b/c =d e = f g/>text<br/>more</p>", ["text more"]),
        ("<p>kept</p><a href='never ends", ["kept"]),
        ("<p>kept</p><script>never ends", ["kept"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", ["a", "b", "c", "d", "e", "f", "g"]),
        ("<plaintext><p>a &amp;", ["<p>a &amp;"]),
        ("</div></p>x</article>", ["x"]),
    ],
)
def test_markup_is_read_as_html(page, want):
    assert flat(page) == want


@pytest.mark.parametrize("piece", ['<a "', "<a '=", "<", "<!--", "</", "<p class='", "<div>", "<li><fieldset>", "<script>", "<p a=\"", "&#", "<x y=z "])
def test_time_is_linear(piece):
    start = time.perf_counter()
    flat("<p>kept</p>" + piece * 100_000)
    assert time.perf_counter() - start < 20


def test_nesting_of_any_depth(spark):
    for depth in (160, 400, 3000):
        pages = ["<div>" * depth + f"<nav>menu</nav><p>one {k}</p><p>two</p>" + "</div>" * depth + "<p>end</p>" for k in range(2)]
        assert texts(spark, pages) == [f"one {k}\n\ntwo\n\nend" for k in range(2)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_hosts_keep_headline_and_lead(spark, n):
    pages = [f"<nav>menu</nav><div class=post><h1>Head {k}</h1><div class=lead>Lead {k}</div><div class=body>{'long text ' * 9}{k}</div></div>" for k in range(n)]
    assert texts(spark, pages) == [f"Head {k}\n\nLead {k}\n\n{'long text ' * 9}{k}" for k in range(n)]


def test_rows_with_nulls_and_repeats(spark):
    rows = [(1, "http://a.b/c", None), (1, None, "http://a.b/c"), (None, "http://a.b/c", "<p>x"), (None, "http://a.b/c", "<p>x"), (None, None, None), (2, "", ""), (2, "", "<p>y"), (2, "", "<p>z")]
    found = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = [(1, "http://a.b/c", ""), (1, None, "http://a.b/c"), (None, "http://a.b/c", "x"), (None, "http://a.b/c", "x"), (None, None, ""), (2, "", ""), (2, "", "y"), (2, "", "z")]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)

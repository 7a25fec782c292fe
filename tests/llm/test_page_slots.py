"""Articles of pages without an article or main element, and marks in class names."""

from __future__ import annotations

import pytest

from ratemill.llm import wrapper


def texts(spark, pages):
    rows = [(k, f"http://host.example.com/{k}", page) for k, page in enumerate(pages)]
    found = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


def page(k: int, body: str, frame: str = "<div class=post>{}</div>") -> str:
    return f"<html><body><div class=top>Our site</div>{frame.format(body)}<div class=base>All rights</div></body></html>"


def test_headline_and_lead_beside_the_body(spark):
    pages = [page(k, f"<h1>Head {k}</h1><div class=lead>Lead {k}</div><div class=post-body><p>{'text ' * 20}{k}</p><p>Second {k}</p></div>") for k in range(6)]
    assert texts(spark, pages) == [f"Head {k}\n\nLead {k}\n\n{'text ' * 20}{k}\n\nSecond {k}" for k in range(6)]


def test_sections_of_different_shape(spark):
    body = "<h1>Head {0}</h1><section><p>First part {0}</p><ul><li>item {0}</ul></section><section><p>Longer second part {0}</p><table><tr><td>cell {0}</table></section>"
    found = texts(spark, [page(k, body.format(k)) for k in range(6)])
    assert found == [f"Head {k}\n\nFirst part {k}\n\nitem {k}\n\nLonger second part {k}\n\ncell {k}" for k in range(6)]


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "comments-open", "ad-free", "share-enabled", "with-banner", "layout-sidebar"])
def test_names_that_tell_of_a_state(spark, name):
    frame = "<div class='" + name + "'>{}<div class=sidebar><p>Side</div><div class='post-comments'><p>Comment</div></div>"
    pages = [page(k, f"<h1>Head {k}</h1><p class='social-history'>Text {k}</p><p class=ad>Buy {k}</p>", frame) for k in range(5)]
    assert texts(spark, pages) == [f"Head {k}\n\nText {k}" for k in range(5)]


def test_marked_parts_stay_out(spark):
    pages = [page(k, f"<h1>Head {k}</h1><p>Text {k}</p><div class='site-nav'>Menu {k}</div><div id=comments><p>Long comment {k}</p></div><div class='share-buttons'>Share {k}</div>") for k in range(5)]
    assert texts(spark, pages) == [f"Head {k}\n\nText {k}" for k in range(5)]

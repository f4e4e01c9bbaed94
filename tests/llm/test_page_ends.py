"""Pages with elements that are left open or closed in themselves."""

import re

import pytest

from lexspark.llm import mincut


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><meta charset=x><script>a('<div>')</script><body><p>One <b>two</b></p><p>three</p>",
        "<head><title>t</title><p>One two</p><p>three</p>",
        "<head><title>t</title>One two<p>three</p>",
        "<head><title>t</title></head><p>One <svg class='i'/>two</p><p>three</p>",
        "<p>One <template id=x />two</p><p>three</p><p><svg><text>not this</text></svg></p>",
        "<p>One <noscript>two</p><p>three</p>",
        "<p>One <svg viewBox='0'>two</p><style>p {}</style><p>three</p>",
        "<p>One <STYLE>x</STYLE >two<script></p><p>three</p>",
        """<p title="a > b" data-x='3 >'>One two</p><p alt='>'>three</p>""",
        """<p title="a>One two</p><p>three</p>""",
    ],
)
def test_no_text_is_swallowed(page):
    assert [b.text for b in mincut.blocks(page)] == ["One two", "three"]


def test_pages_without_telling_elements_are_judged(spark):
    """Articles, navigation and the like renamed to div, so that only the classifier and the cut can tell them."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    weights = mincut.train(spark.createDataFrame(list(enumerate(pages[::2])), "page_id bigint, html string"))
    right = wrong = 0
    for page in pages[1::2]:
        plain = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|form|select)\b", r"<\1div", page)
        plain = re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", plain)
        told, blind = mincut.blocks(page), mincut.blocks(plain)
        assert [b.text for b in told] == [b.text for b in blind] and not any(b.good or b.bad for b in blind)
        for b, label in zip(told, mincut.min_cut(*mincut.graph(blind, weights))):
            if b.good != b.bad:
                right, wrong = right + (label == b.good), wrong + (label != b.good)
    assert right > 0.9 * (right + wrong) > 500


def test_many_open_elements_take_linear_time():
    assert len(mincut.blocks("<p title=\"x" * 20_000)) == 1
    assert len(mincut.blocks("<p>x<svg><script>" * 50_000)) == 50_000

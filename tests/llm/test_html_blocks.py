"""The page parser on hostile and awkward pages."""

import time

import pytest

from canopyflow.llm import html_blocks
from canopyflow.llm.html_blocks import blocks

SIZE = 1 << 20
HOSTILE = ["<a", '<a "', "<p x=y ", "<!--", "<div>", "<a '>'", "&#1", "</b>", "<svg ", "<script>", "<", "</", '<a class="', "<li><p>", "<table><tr><td>", "&amp;", "<p id"]


@pytest.mark.parametrize("unit", HOSTILE)
def test_time_grows_with_the_length(unit):
    page = unit * (SIZE // len(unit))
    blocks(page[: SIZE // 64])
    begin = time.process_time()
    blocks(page)
    assert time.process_time() - begin < 15  # about a second alone; a quadratic parser takes hours


def test_deep_stacks():
    page = "".join(f"<div class=c{i}>x" for i in range(20_000)) + "<x>" * 50_000 + "<h1>" * 50_000
    begin = time.process_time()
    found = blocks(page)
    assert len(found) == 20_000 and time.process_time() - begin < 15
    assert max(len(b.features) for b in found) < html_blocks.MOST_NAMES + 20


def text(page):
    return [b.text for b in blocks(page)]


def test_awkward_markup():
    assert text(None) == text("") == []
    assert text("a < b <p>c &lt; d") == ["a < b", "c < d"]
    assert text("<p>one<!-- two <p> --> three</p>four") == ["one three", "four"]
    assert text("<p>one<!-- never closed <p>two") == ["one"]
    assert text('<p title="a > b">c</p>') == ["c"]
    assert text("<p title='a > b>c</p>d") == ["b>c", "d"]
    assert text("<p>a<script>if (a < b) '</p>'</script>b<p>c</script>d") == ["a", "b", "c", "d"]
    assert text("<SCRIPT>x</ScRiPt >y") == ["y"]
    assert text("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["a", "b", "c", "d"]
    assert text("<p>a<br>b<img src=x>c<wbr>d<b>e</b>f") == ["a bcdef"]
    assert text("a &#" + "1" * 5000 + "; b &#0000000000065; &#x0000000041;") == ["a � b A A"]
    assert text("end <a") == ["end <a"] and text("end <") == ["end <"]

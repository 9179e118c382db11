"""Silent elements without their end tags, and formulas."""

import pytest

from tallyloom.llm import blocks


def texts(page):
    return [text for _, text, _ in blocks.blocks_of(page)]


@pytest.mark.parametrize("name", ["svg", "select", "object", "noscript", "template"])
def test_unclosed_elements_end_with_their_parent(name):
    rest = "<article><p>One</p><p>Two</p></article>"
    assert texts(f"<body><div>a<{name} class='x'>no</div>{rest}</body>") == ["a", "One", "Two"]
    assert texts(f"<article><p>a <{name}>no</p><p>One</p></article><p>Two") == ["a", "One", "Two"]
    assert texts(f"<p>a <a href='x'><b>b</b><{name}><i>no</i></a> c</p>{rest}") == ["a b", "c", "One", "Two"]
    assert texts(f"<div>a<{name}>no</div><p>b</p><div><{name}>no</{name}>c</div>{rest}") == ["a", "b", "c", "One", "Two"]
    assert texts(f"<head><{name}>no<body>{rest}") == ["One", "Two"]
    closed = f"<div><p>a<{name}><g><{name}>no</{name}>no<i>no</i></{name}>b</p>{rest}"
    assert texts(closed) == ["a", "b", "One", "Two"]
    assert blocks.blocks_of(closed)[1][0] == ("div", "p")


@pytest.mark.parametrize("name", ["object", "noscript", "template"])
def test_paragraphs_inside_end_nothing_outside(name):
    assert texts(f"<ul><li><p>a<{name}><p>no<ul><li>no</ul><a href='x'>no</{name}>b</p><li>c") == ["a", "b", "c"]


@pytest.mark.parametrize("name", ["svg", "select"])
def test_blocks_end_an_unclosed_svg_or_select(name):
    assert texts(f"<body><{name}><g>no<article><h1>One</h1>Two</article><div><{name}>no</{name}></div>") == ["One", "Two"]
    assert texts(f"<body><{name}><div>no</div></{name}><p>One") == ["One"]


def test_svg_with_html_and_titles():
    assert texts("<p>a<svg><foreignObject><div>no<svg><title>no</svg></div></foreignObject>no</svg>b</p><p>c") == ["a", "b", "c"]


def test_raw_text_runs_on():
    for name in ("script", "style", "textarea", "title", "iframe"):
        assert texts(f"<div>a<{name}><p>no</div></{name}>b</div>c") == ["a", "b", "c"]
        assert texts(f"<div>a<{name}><p>no</div><p>no") == ["a"]


def test_formulas_stay(pages):
    formula = "<math><mrow><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mn>4</mn></mrow></math>"
    assert texts(f"<p>Let {formula} hold.</p>") == ["Let x2=4 hold."]
    body = f"<article><h1>Head line</h1><p>First part of the story that goes on, where {formula} stands.</p><p>Second part, with <svg><path d='M0'><b>bold</b> words.</p><p>Third part, as long as the other ones.</p></article>"
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now<object></div>{body}<footer>(c) us</footer></body></html>'
    found = blocks.extract(pages([(1, "u", page)])).collect()[0]["text"]
    assert found == "Head line First part of the story that goes on, where x2=4 stands. Second part, with Third part, as long as the other ones."

"""Pages nested deeper than the parser's blocks."""

import time

from sedge.llm import dom


def family_of_text(page, word):
    """Tags from the block of a word up."""
    blocks = dom.parse(page)
    at = next(i for i, b in enumerate(blocks) if any(word in t for t in b.items if isinstance(t, str)))
    tags = []
    while at >= 0:
        tags.append(blocks[at].tag)
        at = blocks[at].parent
    return tags


def test_end_tags_of_deep_elements_close_their_own():
    for n in (50, 399, 450, 2000):
        page = "<div><article><div>" + "<div>" * n + "deep" + "</div>" * n + "</div><p>after</p></article></div>"
        assert "article" in family_of_text(page, "after"), n
        assert "article" in family_of_text(page, "deep"), n


def test_deep_pages_take_little_time():
    for tag, end in (("<div>", "</section>"), ("<div>", "<li>x"), ("<span>", "</b>"), ("<b>", "<p>x")):
        start = time.process_time()
        dom.parse(tag * 5000 + end * 5000)
        assert time.process_time() - start < 20


def test_end_tags_and_implied_ends_across_blocks():
    """Reading stays linear where what a tag would end is beyond a block."""
    n = 20_000
    pages = ["<i><div>" + "<b></i>" * n, "<a><div>" + "<b></a>" * n, "<p><div>" + "<b>" * n + "<hr>" * n, "<li><ul>" + "<b>" * n + "<li>x" * n, "<td><table>" + "<b>" * n + "<td>x" * n, "<dt><dl>" + "<b>" * n + "<dd>x" * n]
    pages += ["<li><ul>" + "<div>" * n + "<li></li>" * n, "<tr><table>" + "<div>" * n + "<td></td><tr></tr>" * (n // 2), "<b><p>" + "<i></b>" * n]
    for page in pages:
        start = time.process_time()
        dom.parse(page)
        assert time.process_time() - start < 10, page[:20]


def test_what_implied_ends_close():
    """An item ends the one before it in its own list, a row the cells of its table only."""
    family = family_of_text("<ul><li>a<ul><li>b</ul><li>c</ul>", "c")
    assert family.count("li") == family.count("ul") == 1
    assert family_of_text("<ul><li>a<ul><li>b", "b").count("li") == 2
    assert family_of_text("<table><tr><td>a<table><tr><td>b<tr><td>c", "c").count("table") == 2
    assert family_of_text("<table><tr><td>a<b>x<tr><td>c", "c").count("tr") == 1

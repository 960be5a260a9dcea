"""Operator 4 on pages with known articles."""

import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import html, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<div id="cookie-notice">We use cookies, truly, on all our pages. Accept?</div>
<header class="site"><h1>Site</h1><a href="/">Home</a></header>
<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav>
<div class="wrap"><main><article class="story">
<h1>The &amp; title</h1>
<p>First long paragraph, with <a href="x">a link</a>, commas, and more words than the menus have.<br>Next line.
<p>Second <b>paragraph, also <i>long</b> enough</i>, to count as text; it has an entity: &eacute;&nbsp;&#x41;.</p>
<p>Short.</p>
<ul><li>One item</li><li>Two items</li></ul>
<blockquote><p>A quoted sentence, with a comma.</p></blockquote>
<script>document.write("<p>not text</p>")</script>
<div class="ad">Buy this, buy that, buy it now, before it is gone.</div>
<section class="comments"><h2>Comments</h2><p>I disagree with the writer, strongly, and at great length, as readers do.</p></section>
</article></main>
<aside class="sidebar"><p>Other stories you may like, of which there are many, and more.</p></aside></div>
<form><label>Mail</label><input><button>Send</button></form>
<footer>&copy; site, all rights reserved.</footer></body></html>"""

WANT = [
    "The & title",
    "First long paragraph, with a link, commas, and more words than the menus have. Next line.",
    "Second paragraph, also long enough, to count as text; it has an entity: é A.",
    "Short.",
    "One item",
    "Two items",
    "A quoted sentence, with a comma.",
]


def test_article():
    assert html.extract(PAGE).split("\n\n") == WANT


def test_page_without_article_element():
    page = "<body><div class=nav><a href=1>One</a> <a href=2>Two</a></div><div class=post><h2>Head</h2><p>Some text, of length.</p><p>More text, of greater length, indeed.</p></div><div class=footer>Copyright, us.</div>"
    assert html.extract(page).split("\n\n") == ["Head", "Some text, of length.", "More text, of greater length, indeed."]


def test_class_names():
    page = "<div class='content has-sidebar'><article><header class=entry-header><h1>Head</h1></header><p>Some text, of length.</p><p>More text, of greater length, indeed.</p><div class='entry-share'>Share this, everyone, now.</div></article><div id=right-sidebar>Other, things.</div></div>"
    assert html.extract(page).split("\n\n") == ["Head", "Some text, of length.", "More text, of greater length, indeed."]


def test_cut_off_pages_and_odd_input(spark):
    whole = "<html><body><article><h1>Head</h1><p>Some text, of length.</p><p>More text, of gre"
    rows = [(1, "u", whole), (2, None, None), (3, "u", ""), (4, "u", "<<>>&&; <p <a"), (5, "u", "plain, no tags"), (None, "v", whole), (None, "v", whole), (6, "w", "<div>" * 3000 + "deep, text" + "</div>" * 3000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html.main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[None].text == "Head\n\nSome text, of length.\n\nMore text, of gre"
    assert (by[2].text, by[3].text, by[5].text, by[6].text) == ("", "", "plain, no tags", "deep, text")
    assert all(r.n_chars == len(r.text) for r in got)


def test_query_keeps_every_page(spark):
    got = queries.op4_tag_path_ratios(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 50 and all(r.text and "©" not in r.text for r in got)


# --- a plain version over trees: (tag, class, children) or a text ---------------------------------------------------
def written(node):
    if isinstance(node, str):
        return node
    tag, cls, below = node
    return f"<{tag}{f' class={cls}' if cls else ''}>{''.join(map(written, below))}</{tag}>"


def plain_blocks(node, above, out):
    """(text, elements from the root, with their place in page order) of each block; texts stand alone in their elements."""
    tag, cls, below = node
    me = (*above, (len(out["elements"]), tag, cls))
    out["elements"].append(me)
    for x in below:
        if isinstance(x, str):
            out["blocks"].append((x, me))
        elif x[0] == "a":
            out["blocks"].append((x[2][0], me))
            out["links"].add(len(out["blocks"]) - 1)
        else:
            plain_blocks(x, me, out)


def plain_factor(elements):
    low, held = 1.0, False
    for _, tag, cls in elements:
        own = html.LOWEST if tag in ("nav", "footer", "aside") or tag == "header" and not held else html.LOW if tag == "form" else 1.0
        if cls in ("ad", "comments") and tag not in ("article", "body"):
            own = min(own, html.LOW)
        low, held = min(low, own), held or tag == "article"
    return low


def plain_extract(tree, sigma=1.0, share=0.5):
    found = {"blocks": [], "elements": [], "links": set()}
    plain_blocks(tree, (), found)
    blocks = found["blocks"]
    path = [tuple((tag, cls, plain_factor(e[:k]) < plain_factor(e[: k - 1]) if k else None) for k, (_, tag, cls) in enumerate(e, 1)) for _, e in blocks]
    order = list(dict.fromkeys(path))
    if not order:
        return ""
    n = {p: path.count(p) for p in order}
    chars = {p: sum(len(b[0]) for b, q in zip(blocks, path, strict=True) if q == p) for p in order}
    links = {p: sum(len(b[0]) for k, (b, q) in enumerate(zip(blocks, path, strict=True)) if q == p and k in found["links"]) for p in order}
    marks = {p: sum(b[0].count(",") + b[0].count(".") for b, q in zip(blocks, path, strict=True) if q == p) for p in order}
    factor = {q: plain_factor(b[1]) for b, q in zip(blocks, path, strict=True)}
    text = [(chars[p] - links[p]) / n[p] for p in order]
    dots = [(marks[p] + 1) / n[p] for p in order]

    def smoothed(values, i):
        near = [(math.exp(-0.5 * ((j - i) / sigma) ** 2), v) for j, v in enumerate(values) if abs(j - i) <= math.ceil(2 * sigma)]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    fused = [math.sqrt(text[i] * smoothed(text, i) * dots[i] * smoothed(dots, i)) * factor[p] for i, p in enumerate(order)]
    if max(fused) < html.LEAST:
        return ""
    mean = sum(fused) / len(fused)
    limit = min(share * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)), max(fused))
    good = {p for p, f in zip(order, fused, strict=True) if f > 0 and f >= limit - 1e-9 and links[p] < 0.5 * chars[p]}
    core = [b for b, q in zip(blocks, path, strict=True) if q in good]
    if not core:
        return ""
    shared = [x for k, x in enumerate(core[0][1]) if all(len(b[1]) > k and b[1][k] == x for b in core)]
    around = list(shared)
    while shared and shared[-1][1] != "article":
        shared.pop()
    shared = shared or around
    inside = shared and shared[-1][1] != "body"
    out, heads = [], []
    for k, (b, q) in enumerate(zip(blocks, path, strict=True)):
        mine = q in good or inside and b[1][: len(shared)] == tuple(shared) and plain_factor(b[1]) >= plain_factor(shared) and k not in found["links"]
        if mine:
            out, heads = [*out, *heads, b[0]], []
        elif not inside and b[1][-1][1] == "h2" and k not in found["links"] and plain_factor(b[1]) >= plain_factor(core[0][1]):
            heads.append(b[0])
        else:
            heads = []
    return "\n\n".join(out)


texts = st.sampled_from(["ab", "Home", "A short one.", "One, two, three, and four.", "A longer text, with commas, and with more words than most others have in them. " * 2]).map(str.strip)
leaves = st.tuples(st.sampled_from(["p", "h2", "li", "div"]), st.sampled_from(["", "", "x", "ad"]), st.lists(texts, min_size=1, max_size=1) | texts.map(lambda t: [("a", "", [t])]))
holders = st.sampled_from(["div", "section", "article", "nav", "footer", "aside", "header", "form"])
trees = st.recursive(leaves, lambda below: st.tuples(holders, st.sampled_from(["", "", "x", "ad", "comments"]), st.lists(below, min_size=1, max_size=5)), max_leaves=25)


@settings(max_examples=400, deadline=None)
@given(st.lists(trees, max_size=5))
def test_agrees_with_a_plain_version(parts):
    tree = ("body", "", parts)
    assert html.extract(written(tree)) == plain_extract(tree)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="<>![]/?-&#;x=\"' abpdiv\n", max_size=200) | st.lists(st.sampled_from(["<![", "<![x[", "]]>", "<!--", "-->", "<p>", "</p>", "<a href='", ">", "<svg/>", "&", "text, ", "</", "<div class=ad>", "<!x", "<?"]), max_size=40).map("".join))
def test_any_markup_gives_text(page):
    got = html.extract(page)
    assert "\n\n\n" not in got and got == got.strip()


@pytest.mark.parametrize("page", ["<![x[y]]> hi, there", "<p>hi, there<![CDATA[ z ]]>", "<p>hi, there<!", "<p>hi, there<![ x", "<p>hi, there</p><a href='x"])
def test_unknown_declarations_are_skipped(page):
    assert html.extract(page) == "hi, there"


@pytest.mark.parametrize("page", ["<div>x, y. " * 100_000 + "</div>" * 100_000, "<b>" * 50_000 + "<i>" * 50_000 + "</b>" * 50_000, "<p><td>" + "<x>" * 50_000 + "<h1>a</h1>" * 50_000, "<!--" * 100_000, "<a " * 100_000, "<a href='" * 100_000 + ">", "</" * 100_000, "<![x" * 100_000])
def test_time_is_linear(page):
    at = time.time()
    html.extract(page)
    assert time.time() - at < 20


def test_ratios_decide():
    """With every path taken for content, menus, adverts and footers come along."""
    page = "<body><nav><ul><li><a href=1>One</a></li></ul></nav><div class=ad>Buy this.</div><article><h1>Head</h1><p>Some text, of length.</p><p>More text, of greater length, indeed.</p></article><footer>Copyright, us.</footer></body>"
    reader = html.Reader()
    reader.feed(page)
    reader.close()
    every = {b.path for b in reader.blocks}
    chosen = html.content_paths(reader.blocks, 1.0, 0.5)
    assert len(chosen) < len(every)
    assert html.main_blocks(reader, every) == ["One", "Buy this.", "Head", "Some text, of length.", "More text, of greater length, indeed.", "Copyright, us."]
    assert html.main_blocks(reader, chosen) == ["Head", "Some text, of length.", "More text, of greater length, indeed."]


@pytest.mark.parametrize("wrap", ["<div class='content-with-sidebar'>{}</div>", "<form id=aspnetForm>{}</form>", "<section id='legal-notice'>{}</section>", "<div class='layout two-col-sidebar'>{}</div>"])
def test_a_wrapper_around_all_takes_nothing(wrap):
    page = "<body>" + wrap.format("<h1>Head</h1><p>Some text, of length, and with some more words in it.</p><p>More text, of greater length, indeed.</p><div class=ad>Buy this.</div>") + "</body>"
    assert html.extract(page).split("\n\n")[:3] == ["Head", "Some text, of length, and with some more words in it.", "More text, of greater length, indeed."]


def test_only_a_menu():
    assert html.extract("<body><nav><a href=1>One</a> <a href=2>Two</a></nav><footer>Copyright, us.</footer></body>") == ""

"""Extraction: the scan against brute force, and that scan and weights decide."""

import random

import pytest

from tidemark.llm import html


def page(i, body=True):
    r = random.Random(i)
    words = lambda n: " ".join(r.choice("the of and tion er ing stone river light house".split()) for _ in range(n))
    paragraphs = [words(r.randrange(3, 40)) for _ in range(r.randrange(1, 6))]
    head = words(5)
    article = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs[:1]) + f'<div class="zug">{words(9)}</div>' + "".join(f"<p>{p}" for p in paragraphs[1:])
    tag = "article" if body else "div"
    text = f"<html><body><nav><ul><li><a href=/>{words(2)}</a></li><li><a>{words(1)}</a></li></ul></nav><{tag}>{article}</{tag}><div class='zug'>{words(12)}</div><footer>{words(15)}</footer></body></html>"
    return text, "\n".join([head, *paragraphs])


@pytest.fixture(scope="module")
def learnt():
    sums = {}
    for i in range(60):
        # in labelled pages zug stands outside content only
        p = page(i)[0]
        a = p.index("<div class=\"zug\">")
        p = p[:a] + p[p.index("</div>", a) + 6 :]
        for k, (x, y) in html.count_labels(p).items():
            u, v = sums.get(k, (0, 0))
            sums[k] = (u + x, v + y)
    return html.weights(sums)


def test_best_region_against_brute_force():
    r = random.Random(4)
    for _ in range(300):
        s = [r.choice((-3, -1, -0.5, 0, 0.5, 1, 2, 4)) for _ in range(r.randrange(0, 14))]
        best = max([sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)], default=0)
        a, b = html.best_region(s)
        assert (a, b) == (0, 0) if best <= 0 else sum(s[a:b]) == best


def test_words_positive_tags_negative(learnt):
    words, tags = learnt
    assert all(0 < w <= 1 for w in words.values()) and all(t < 0 for t in tags.values())
    assert words["article"] > 0.9 > 0.1 > words["nav"] and words["div.zug"] < 0.1 and words["^plain"] > 0.9 and tags["<nav"] < tags["<p"]


def test_learnt_class_goes_from_the_region(learnt):
    for i in range(100, 160):
        for marked in (True, False):
            p, want = page(i, marked)
            assert html.extract(p, *learnt) == want


def test_scan_and_weights_decide(learnt, monkeypatch):
    pages = [page(i, i % 2) for i in range(200, 240)]
    flat = ({k: 0.8 for k in learnt[0]}, {k: -0.3 for k in learnt[1]})
    assert sum(html.extract(p, *flat) == want for p, want in pages) < 8
    monkeypatch.setattr(html, "best_region", lambda s: (0, len(s)))
    assert sum(html.extract(p, *learnt) == want for p, want in pages) < 8


def test_other_pages(learnt):
    text = "<body><p>one two three four</p><p>five six</p></body>"
    assert html.extract(text, *learnt) == html.extract(text, {}, {}) == "one two three four\nfive six"
    said = "<main><h2>T</h2><p>aa bb cc</p><div id=comments>" + "<div class='comment-body'><p>" + "xx " * 300 + "</p></div>" * 9 + "</div></main><aside>q</aside>"
    assert html.extract(said, *learnt) == "T\naa bb cc"
    assert html.extract("<div>" * 20_000 + "deep" + "</p>" * 20_000, {}, {}) == "deep"
    assert html.extract("a < b & c &lt; d", {}, {}) == "a < b & c < d"
    assert html.extract("<form><article><p>in</p></article>", {}, {}) == "in"
    assert html.extract("<article><header><h1>H</h1></header><ul><li><a>x</a></li></ul></article><header>no</header>", {}, {}) == "H\nx"
    assert html.extract('<article><p>to be <span hidden>x</span>read</p><span class="sponsored">z</span></article>', {}, {}) == "to be read"


def test_whole_class_names_only(learnt):
    kept = ("dialogue", "commentary", "socialism", "searchable", "noticeable", "headers-guide", "shared-memory", "promotion-history", "related-work", "menu-of-the-day", "header", "post-header", "adage")
    gone = ("dialog", "comments", "comment-list", "social", "search-box", "notice", "site-footer", "share_links", "promo", "related", "menu", "ads", "sponsored", "x related")
    for words, tags in (learnt, ({}, {})):
        for tag in ("article", "main"):
            page = lambda name: f"<body><nav><a>n</a></nav><{tag}><h1>T</h1><p>aa bb cc dd</p><div class='{name}'><p>in here</p></div><p>ee ff gg</p></{tag}></body>"  # noqa: B023, E731
            assert {n for n in kept if html.extract(page(n), words, tags) != "T\naa bb cc dd\nin here\nee ff gg"} == set()
            assert {n for n in gone if html.extract(page(n), words, tags) != "T\naa bb cc dd\nee ff gg"} == set()

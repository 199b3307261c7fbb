"""Page extraction against a plain one: another parser, and all windows of a host in a dictionary."""

import collections
import random
import re
import time
from html.parser import HTMLParser

import pytest

from tallgrass.llm import pages

AWAY = {"nav", "header", "footer", "aside", "form"}
NOISY = {"ad", "ad-banner", "comments", "site-footer", "related"}


class Plain(HTMLParser):
    """Blocks of well-formed pages of div, p, nav and the like."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.held = [("", 1)], [], ""
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        text = re.sub(r"\s+", " ", self.held).strip()
        if text and self.stack[-1][1] is not None:
            self.blocks.append((self.stack[-1][1], text))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        zone = self.stack[-1][1]
        if tag in ("b", "i", "a"):
            return
        self.flush()
        if tag == "br":
            self.held += " "
            return
        if tag in ("script", "style", "title"):
            zone = None
        elif zone is not None and zone != 0:
            if tag in ("article", "main"):
                zone = 2
            elif tag in AWAY and not (tag == "header" and zone == 2) or dict(attrs).get("class") in NOISY:
                zone = 0
        self.stack.append((tag, zone))

    def handle_endtag(self, tag):
        if tag in ("b", "i", "a"):
            return
        self.flush()
        self.stack.pop()

    def handle_data(self, data):
        self.held += data


def plain(rows, window, array=True, run=16):
    parsed = [Plain(html or "").blocks for _, _, html in rows]
    where = collections.defaultdict(set)
    streams = []
    for (_, url, html), own in zip(rows, parsed, strict=True):
        host = re.match(r"https?://([^/:]*)", url or "")
        host = host[1].lower() if host else ""
        tokens = [(w, b) for b, (z, t) in enumerate(own) if z != 2 for w in t.split()]
        streams.append((host, tokens))
        for k in range(len(tokens) - window + 1):
            where[host, tuple(w for w, _ in tokens[k : k + window])].add(html)
    out = []
    for (page_id, _, _), own, (host, tokens) in zip(rows, parsed, streams, strict=True):
        covered = set()
        for k in range(len(tokens) - window + 1):
            if array and len(where[host, tuple(w for w, _ in tokens[k : k + window])]) > 1:
                covered |= set(range(k, k + window))
        long = set()
        for k in covered:
            if k - 1 not in covered:
                end = next(j for j in range(k, len(tokens) + 1) if j not in covered)
                long |= set(range(k, end)) if end - k >= run else set()
        kept = []
        for b, (zone, text) in enumerate(own):
            places = [k for k, (_, c) in enumerate(tokens) if c == b]
            if zone == 2:
                kept.append(text)
            elif zone == 1 and 2 * sum(k in covered for k in places) <= len(places):
                kept.append(" ".join(tokens[k][0] for k in places if k not in long))
        out.append((page_id, "\n".join(t for t in kept if t)))
    return sorted(out)


def made(seed, many):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(("tea", "&amp;", "café", "r&eacute;e")) if rng.random() < 0.1 else f"w{rng.randrange(900)}" for _ in range(n))
    boiler = {h: [words(rng.randrange(8, 50)) for _ in range(6)] for h in range(4)}
    rows = []
    for k in range(many):
        h = rng.choice((0, 0, 0, 1, 2, 3))

        def body(depth, h=h):
            out = ""
            for _ in range(rng.randrange(1, 5)):
                tag = rng.choice(("p", "p", "div", "div", "nav", "header", "footer", "aside", "article", "section") if depth < 3 else ("p",))
                mark = rng.choice(("", "", "", ' class="ad-banner"', ' class="comments"', ' class="content no-sidebar"', ' id=page', ' class="has-comments wide"')) if tag == "div" else ""
                text = rng.choice(boiler[h]) if rng.random() < 0.4 else words(rng.randrange(1, 40))
                inner = f"{text[:9]}<b>{text[9:]}</b>" if rng.random() < 0.2 and "&" not in text[:12] else text
                out += f"<{tag}{mark}>{inner}{body(depth + 1) if tag != 'p' else ''}</{tag}>\n"
            return out

        html = f"<html><head><title>t {k}</title><style>p &gt; b</style></head><body>{body(0)}</body></html>"
        rows.append((k, f"https://H{h}.example/{k}" if h else rng.choice((None, "odd")), html))
        if rng.random() < 0.1:
            rows.append((many + k, rows[-1][1], html))  # a copy is no repeat
    return rows + [rows[0], (-1, "https://h1.example", ""), (-2, "https://h1.example", None)]


@pytest.mark.parametrize("seed,window,most", [(1, 16, 10**6), (2, 6, 10**6), (2, 6, 0)])
def test_extraction_by_brute_force(spark, monkeypatch, seed, window, most):
    monkeypatch.setattr(pages, "MAX_BROADCAST", most)
    rows = made(seed, 150)
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), window, 12).collect()
    got = sorted((r["page_id"], r["text"]) for r in out)
    assert got == plain(rows, window, run=12)
    assert sum(a != b for a, b in zip(got, plain(rows, window, array=False), strict=True)) > 50  # the array decides much of it
    assert sum(r["n_settled"] for r in out) > 300


def test_whole_table_by_brute_force(spark, sf):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    out = pages.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    want = {}
    for page_id, _, html in rows:
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        own = [re.sub(r"\s+", " ", Plain(f"<div>{x}</div>").blocks[0][1]) for x in re.split(r"</?(?:p|h1|div|ul|li)>", article.replace("<br>", " ")) if re.sub(r"<[^>]*>|\s", "", x)]
        want[page_id] = "\n".join(own)
    assert {r["page_id"]: r["text"] for r in out} == want


@pytest.mark.parametrize("names,chrome", [("content no-sidebar", False), ("page has-comments", False), ("sidebar left", True), ("main-nav", True), ("adContainer", True), ("shared-values", False), ("address", False), ("cookie-notice", True), ("without-ads", False), ("side-bar", True)])
def test_names_of_wrappers(names, chrome):
    assert pages.blocks(f'<div class="{names}"><p>text</p></div>') == [(0 if chrome else 1, "text")]
    assert pages.blocks(f'<div class="{names}"><article><header class="header"><h1>Title</h1></header>text</article></div>') == ([(0, "Title"), (0, "text")] if chrome else [(2, "Title"), (2, "text")])


@pytest.mark.parametrize("part", ['<h2 id="related-work">T</h2>', '<section id="notice-of-risk">T</section>', '<p class="share-price">T</p>', '<h2 id="menu-prices">T</h2>', '<h3 class="ad-hoc">T</h3>', '<div id="comment-on-law">T</div>'])
def test_articles_keep_what_names_only_sound_like_chrome(part):
    assert pages.blocks(f"<article>{part}</article>") == [(2, "T")]


def test_articles_lose_what_is_chrome():
    for part in ('<div class="comments">T</div>', '<div class="ad-slot">T</div>', '<div id="newsletter-signup">T</div>', "<aside>T</aside>", '<section class="related-posts">T</section>'):
        assert pages.blocks(f"<article>{part}</article>") == [(0, "T")], part


@pytest.mark.parametrize("html,want", [
    ('<a href="x>broken</a> <p>more', ["broken", "more"]), ("a < b <c", ["a < b"]), ("x<!-- never closed", ["x"]), ("<p>a<math><mi>x</mi><mo>=</mo><annotation>tex</annotation></math>b</p>", ["ax=b"]),
    ('<p title="a>b">t</p>', ["t"]), ('<p>a<span hidden>x</span>b<i style="display:none">y</i>c</p>', ["abc"]), ("<article>a<span class='ad'>x</span>b</article>", ["a", "x", "b"]), ("<script>if (a < b) {}</script>t", ["t"]), ("<p>one<p>two<li>three<li>four", ["one", "two", "three", "four"]), ("<![CDATA[x]]>y<?php z ?>", ["y"]), ("<title>t</title><body>u", ["u"]),
])
def test_broken_markup(html, want):
    assert [t for _, t in pages.blocks(html)] == want


def test_parsing_is_linear():
    began = time.time()
    for html in ("<a " * 300_000, "<div>" * 100_000 + "x", '<a "x>"' * 100_000 + "'", "<p><td>" + "<b>" * 50_000 + "<h1>x" * 50_000, "<script>" * 50_000, "<!-- " * 100_000, "<" * 500_000, "<textarea><title>" * 50_000):
        pages.blocks(html)
    assert time.time() - began < 20


def test_no_rows_and_a_long_page(spark):
    schema = "page_id long, url string, html string, text string"
    assert pages.extract(spark.createDataFrame([], schema)).count() == 0
    words = " ".join(f"w{k}" for k in range(400_000))
    row = pages.extract(spark.createDataFrame([(1, "http://a.b", f"<nav>n</nav><article><p>{words}</p></article>", "x")], schema)).first()
    assert row["text"] == words

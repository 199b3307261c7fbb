"""Main-text extraction by the repeats of a suffix array over each host's pages.

A page is split into blocks of visible text by its markup; each block has a zone, a hint from tags, roles, classes
and ids: content (inside article or main), chrome (inside nav, header, footer, aside, form, an advert, notice, comment
or menu) or open (neither). What lies outside content is settled by the host's suffix array: the token streams of these
blocks of all its pages are concatenated, and each suffix is a row (host, first WINDOW tokens, page, place). Suffixes that
agree in these tokens are an interval of the array; one with two distinct pages is a long repeated substring, and
overlapping ones make up the longer runs. Intervals are found by a grouped minimum and maximum of the page, which
combines before the shuffle, so that a host with a third of all pages or a passage that all pages have is many tasks'
work; within an interval the array's order plays no part and is not kept. A block that its runs cover by more than half
is boilerplate on this evidence, whatever its hint. Of other open blocks the covered runs of RUN tokens or more are cut
out and the unique runs kept; hints alone drop chrome that the array has no evidence on. Content stays in any case: an
article that many pages repeat is still their article.

Pages are distinct if their html is: copies of a page do not make its text a repeat.

Defined results: null or empty html has no blocks and gives the empty text with n_chars 0; pages without a url, or
with one that names no host, are a host together. Repeated rows each get a row. Further columns are dropped. An empty
table gives no rows. A page is read once from start to end, whatever its nesting and however broken, and is in memory as
a whole. A tag that never ends swallows the rest; from a quote on that never ends, tags end at the first `>`.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, flat_text, mixed, slices, word_bounds, word_hashes, written

#: Tokens that suffixes must share to be a repeat, and those of a run that is cut out of an open block.
WINDOW, RUN = 8, 16
CHROME, OPEN, CONTENT = 0, 1, 2
# Elements by what they do to text.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas", "textarea", "select", "button", "annotation", "annotation-xml"}
AWAY = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
BODY = {"article", "main"}
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math semantics annotation annotation-xml mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom mfenced menclose mtable mtr mtd".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An open p or li ends where one of these begins.
ENDS_P = {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "footer", "header", "nav", "aside", "form", "table", "blockquote", "pre", "main", "figure", "hr"}
NOISE = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social|comments?|replies|disqus|sidebar|menu|nav\w*|breadcrumbs?|footer|header|related|widget|pagination|pager|toolbar|skip)\Z")
#: What may follow such a word in a name without making it one of something else (an ad-slot, not ad-hoc).
WRAPPER = re.compile(r"(?:area|articles?|bar|block|body|bottom|box|buttons?|col\w*|container|content|form|frame|group|holder|icons?|inner|items?|left|links?|list|main|outer|panel|placeholder|popup|posts?|right|row|section|signup|slot|stories|tabs?|text|thread|top|unit|widget|wrap|wrapper|zone|[0-9]+)\Z")
#: Elements of an article that no name makes chrome, and those that only a class does.
PLAIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "figure", "figcaption", "td", "th", "tr", "li", "dl", "dt", "dd"}
CLASS_ONLY = {"section"}
#: A class that begins so tells of a page's layout, not of what an element is.
LAYOUT = {"no", "has", "with", "without", "is", "not"}
NAME_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
ROLES = re.compile(r"(?i)\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu)")
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
TO_QUOTE = re.compile(r"[^>\"']*")
MARKS = re.compile(r"(?i)\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*none\b")
#: What may start inside head without closing it.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "noframes", "template"}
SPACES = re.compile(r"\s+")


def unseen(attributes: str) -> bool:
    """Whether an element's attributes hide it: hidden, aria-hidden="true", or a style of display: none."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and NO_DISPLAY.search(value):
            return True
    return False


def noisy(names: str) -> set[str]:
    """The words of a class or id that speak for chrome: the last part of one of its names, or the first where only words
    for wrappers follow."""
    found = set()
    for name in names.replace("side-bar", "sidebar").split():
        parts = [p.lower() for p in NAME_PARTS.split(name) if p]
        if not parts or parts[0] in LAYOUT:
            continue
        if NOISE.match(parts[-1]):
            found.add(parts[-1])
        if NOISE.match(parts[0]) and all(WRAPPER.match(p) or NOISE.match(p) for p in parts[1:]):
            found.add(parts[0])
    return found


def is_chrome(tag: str, attributes: str, zone: int) -> bool:
    """Whether an element begins chrome. A header within content belongs to it: it has the title."""
    own = {"header"} if zone == CONTENT else set()
    if tag in AWAY - own or attributes and ROLES.search(attributes):
        return True
    if not attributes or tag in BODY or tag in ("html", "body") or zone == CONTENT and tag in PLAIN:
        return False
    marks = MARKS.findall(attributes)
    return any(noisy(x[1] or x[2] or x[3]) - own for x in marks if not (zone == CONTENT and tag in CLASS_ONLY and x[0].lower() == "id"))


class Tags:
    """The tags of a page from start to end: (text before, end tag, name, attributes) each, the rest after the last."""

    def __init__(self, page: str):
        self.page, self.at, self.quotes = page, 0, True

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin here; -1 where the rest has no end for it."""
        page, start = self.page, at
        while self.quotes:
            at = TO_QUOTE.match(page, at).end()
            if at == len(page):
                return -1
            if page[at] == ">":
                return at
            at = page.find(page[at], at + 1) + 1
            if not at:
                self.quotes = False  # looked for in vain once, and never again
        return page.find(">", start)

    def __iter__(self) -> Iterator[tuple[str, bool, str, str]]:
        page, held = self.page, []
        while (k := page.find("<", self.at)) >= 0:
            held.append(page[self.at : k])
            m = NAME.match(page, k + 1)
            if m:
                end = self._end(m.end())
                self.at = end + 1 if end >= 0 else len(page)
                if end >= 0:
                    closing = page[k + 1] == "/"
                    yield "".join(held), closing, m[0].lstrip("/").lower(), page[m.end() : end]
                    held = []
                continue
            for opened, closed in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
                if page.startswith(opened, k):
                    end = page.find(closed, k + len(opened))
                    self.at = end + len(closed) if end >= 0 else len(page)
                    break
            else:
                held.append("<")
                self.at = k + 1
        yield "".join(held) + page[self.at :], False, "", ""


class Open:
    """The open elements, with the places of each name."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []  # (tag, zone, hidden)
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []

    def push(self, tag: str, zone: int, hidden: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in WALLS:
            self.walls.append(len(self.stack))
        self.stack.append((tag, zone, hidden))

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def pop(self, k: int) -> tuple[int, bool]:
        """Closes all from the k-th on; the zone and whether it is hidden, outside them."""
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in WALLS:
                self.walls.pop()
        return self.stack[-1][1:] if self.stack else (OPEN, False)


#: What an open p or li does not end beyond.
WALLS = {"article", "main", "section", "div", "ul", "ol", "td"}
RAW = {tag: re.compile(rf"(?i)</{tag}\s*>") for tag in ("script", "style", "textarea", "title")}


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block of visible text, in page order."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    inner, tags = Open(), Tags(page)
    zone, hidden = OPEN, False
    gone: set[str] = set()  # raw elements whose end tag the rest does not have

    def flush() -> None:
        text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((zone, text))

    for before, closing, tag, attributes in tags:
        if inner.stack and inner.stack[-1][0] == "head" and before.strip():
            zone, hidden = inner.pop(len(inner.stack) - 1)  # text ends the head, whose end tag is optional
        if not hidden:
            held.append(before)
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            held.append(" ")
        if closing:
            k = inner.last(tag)
            if k >= 0 and (tag not in INLINE or zone != (inner.stack[k - 1][1] if k else OPEN)):
                flush()
            if k >= 0:
                zone, hidden = inner.pop(k)
            continue
        if tag not in IN_HEAD and inner.last("head") > inner.last("template"):
            zone, hidden = inner.pop(inner.last("head"))
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in ENDS_P:
            k = max(inner.last("p"), inner.last("li") if tag == "li" else -1)
            if k >= 0 and k > (inner.walls[-1] if inner.walls else -1):
                zone, hidden = inner.pop(k)
        now, away = zone, hidden or tag in HIDDEN or unseen(attributes)
        if tag in BODY and zone != CHROME:
            now = CONTENT
        elif is_chrome(tag, attributes, zone):
            now = CHROME
        if now != zone or away != hidden and tag not in INLINE:
            flush()
        if tag in RAW:  # raw text up to its own end tag
            end = None if tag in gone else RAW[tag].search(page, tags.at)
            if end is None:
                gone.add(tag)
            tags.at = end.end() if end else len(page)
            continue
        inner.push(tag, now, away)
        zone, hidden = now, away
    flush()
    return out


def suffix_ranks(texts: list[str], site: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """A number for each suffix of a page's token stream by its first window tokens (equal for equal ones of a host), and
    the block of each token. Suffixes that are shorter have none."""
    data, offsets = flat_text(pa.array([" ".join(texts)]))
    starts, ends = word_bounds(~SPACE[data], offsets)
    words = word_hashes(data, starts, ends)
    sizes = np.cumsum([0] + [len(t.encode("utf-8", "replace")) + 1 for t in texts])
    block = np.searchsorted(sizes, starts, "right") - 1
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), block
    ranks = np.full(n, np.array([site], np.int64).view(np.uint64)[0])
    for k in range(window):
        ranks = mixed(ranks * np.uint64(3) ^ words[k : n + k])
    return ranks.view(np.int64), block


SEP = "\x1f"
PARSED = "page_id long, url string, site long, page long, packed binary, ranks array<long>"
#: Repeated ranks that are broadcast at most, 8 bytes each; beyond that their places are joined to the pages.
MAX_BROADCAST = 1_000_000


def parse(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """PARSED of each page: its host's and its html's hash, its blocks, compressed, and the ranks of the suffixes of what
    lies outside content."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "html", 1 << 20):
            packed, ranks = [], []
            for page, site in zip(batch.column("html").to_pylist(), batch.column("site").to_pylist(), strict=True):
                own = blocks(page or "")
                packed.append(press.compress("\n".join(f"{z}{SEP}{t}" for z, t in own).encode("utf-8", "replace")))
                ranks.append(suffix_ranks([t for z, t in own if z != CONTENT], site, window)[0])
            edges = pa.array(np.cumsum([0, *map(len, ranks)]), pa.int32())
            lists = pa.ListArray.from_arrays(edges, pa.array(np.concatenate(ranks)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("site"), batch.column("page"), pa.array(packed, pa.binary()), lists], names=[c.split()[0] for c in PARSED.split(", ")])

    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(host).alias("site"), F.xxhash64("html").alias("page"), "html")
    return keyed.mapInArrow(run, PARSED)


def unpacked(packed: bytes, opened: zstandard.ZstdDecompressor) -> list[tuple[int, str]]:
    raw = opened.decompress(packed, max_output_size=1 << 31).decode() if packed else ""
    return [(int(b[0]), b[2:]) for b in raw.split("\n")] if raw else []


def repeated(parsed: DataFrame) -> DataFrame:
    """Ranks of substrings that two pages of a host have outside content; a rank is a hash that includes the host's."""
    array = parsed.select("page", F.explode("ranks").alias("rank"))
    return array.groupBy("rank").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo < hi").select("rank")


def placed(parsed: DataFrame, ranks: DataFrame) -> DataFrame:
    """(site, page, places): where the repeated substrings begin."""
    array = parsed.select("site", "page", F.posexplode("ranks").alias("place", "rank"))
    return array.join(ranks, "rank", "left_semi").groupBy("site", "page").agg(F.collect_set(F.col("place").cast("long")).alias("places"))


RESULT = "page_id long, url string, text string, n_chars long, n_blocks long, n_dropped long, n_settled long"


def covered_runs(places: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n tokens the substrings of window tokens cover that begin at the places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + window, -1)
    return np.cumsum(change[:-1]) > 0


def settled(own: list[tuple[int, str]], places: np.ndarray, window: int, run: int) -> tuple[list[str], int]:
    """The blocks that stay, and how many the repeats decided."""
    outside = [k for k, (z, _) in enumerate(own) if z != CONTENT]
    stays: list[str | None] = [t if z != CHROME else None for z, t in own]
    decided = 0
    if len(places) and outside:
        _, block = suffix_ranks([own[k][1] for k in outside], 0, window)
        covered = covered_runs(places, len(block), window)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
        long = np.zeros(len(block), bool)
        for a, z in zip(edges[::2], edges[1::2], strict=True):
            long[a:z] = z - a >= run
        first = np.searchsorted(block, np.arange(len(outside) + 1))
        for j, k in enumerate(outside):
            at = slice(first[j], first[j + 1])
            n, hit = first[j + 1] - first[j], int(covered[at].sum())
            if 2 * hit > n:
                stays[k], decided = None, decided + 1
            elif own[k][0] == OPEN and long[at].any():
                words, decided = own[k][1].split(" "), decided + 1
                stays[k] = " ".join(w for w, cut in zip(words, long[at], strict=True) if not cut) if len(words) == n else own[k][1]
    return [t for t in stays if t], decided


def extract(pages: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """RESULT of each page; n_settled counts the blocks that the repeats decided."""
    parsed = written(parse(pages, window), "parsed")
    ranks = written(repeated(parsed), "ranks")
    few = ranks.count() <= MAX_BROADCAST
    if few:  # each page looks its own ranks up, and no page moves
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(ranks.toArrow().column("rank").to_numpy()))
        whole = parsed.select("page_id", "url", "packed", "ranks")
    else:
        whole = parsed.join(placed(parsed, ranks), ["site", "page"], "left").select("page_id", "url", "packed", "places")

    def places_of(own: list | None) -> np.ndarray:
        own = np.array(own or [], np.int64)
        if not few or not len(own) or not len(shared.value):
            return own if not few else own[:0]
        at = np.minimum(np.searchsorted(shared.value, own), len(shared.value) - 1)
        return np.flatnonzero(shared.value[at] == own)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in slices(batches, "packed", 1 << 20):
            made = []
            for page_id, url, packed, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = unpacked(packed, opened)
                kept, decided = settled(own, places_of(found), window, run)
                text = "\n".join(kept)
                made.append((page_id, url, text, len(text), len(own), len(own) - len(kept), decided))
            types = (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return whole.mapInArrow(rows, RESULT)

"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags
negative, with weights from labelled pages (those that mark their content with
``<article>`` or ``<main>``):

* a word's weight is the share of content among the words of its place. Its
  place is the innermost element around it with a class, an id, a role or a
  sectioning name; elements of unknown classes take the place around them. Each
  labelled page counts twice, as it is and with its marks taken for plain
  ``<div>``, so pages without marks have weights of their own.
* a tag's weight follows how often it stands outside content.

One linear scan finds the contiguous region with the largest sum. A region that
touches a marked element takes the whole of it, however adverts part it. Then
the words of the region are scanned by their own weights: those under a half
(adverts, notices, reader comments ...) go from within marked elements and from
between the first and the last content word. Raw elements, scripts, styles,
forms and hidden elements are never read.

Classes that labelled pages do not show have prior counts if their whole name
speaks of what is not content (``PRIOR_NAMES``); the learnt counts are added to
them, and they keep comments and adverts inside a marked element from being
learnt as content. Any other class has the weight of what is around it.

White space inside a block becomes one space; blocks are joined by one newline.
Null, empty and tagless input: the plain words, or an empty text. Broken markup
(unclosed elements, cut tags) ends at the end of the page; very long pages cost
time in proportion. Repeated rows are extracted alike; other columns stay out
of the result. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Element names of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object"}
UNREAD = RAW | {"form", "button", "select"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTENT = {"article", "main"}
SECTIONS = CONTENT | {"nav", "footer", "aside", "menu", "dialog", "header"}
# Class words that pages use for what is not content, and words that only tell its form. They are prior counts, not a rule.
PRIOR_NAMES = {
    "ad", "advert", "advertisement", "adsense", "alert", "banner", "breadcrumb", "comment", "complementary", "consent", "contentinfo", "cookie", "copyright",
    "dialog", "disqus", "footer", "header", "hidden", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "pager", "pagination", "popup", "promo", "recommended", "related", "respond", "search", "searchbar", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "widget",
}
PRIOR_FORMS = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "container", "form", "global", "group", "icon", "inner", "item", "left", "link", "list", "outer",
    "panel", "primary", "right", "row", "secondary", "site", "slot", "thread", "top", "unit", "wrap", "wrapper",
}
#: How many words the prior counts stand for, and the weight that they give by themselves.
PRIOR_WORDS, PRIOR_LOW = 20.0, 0.001
#: Tags without a learnt weight: links, others, and those of elements whose words weigh under a half.
LINK, PLAIN, FORMAT, LOW_TAG, DEAREST = -1.0, -0.3, -0.1, -2.0, -3.0
_FORMATS = {"b", "i", "em", "strong", "span", "br", "u", "sub", "sup", "small", "code", "p", "mark", "s", "q", "cite", "abbr", "time"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)|([^<]+|<)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][\w:-]*)([^>]*)(>|\Z)()", re.S)
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_BARE = re.compile(r"\bhidden\b", re.I)
_WORD = re.compile(r"[a-z]+")
_ENDS = {raw: re.compile(rf"</{raw}\b[^>]*>?", re.I) for raw in RAW}


@functools.lru_cache(maxsize=20_000)
def _labels(attributes: str) -> tuple[str, tuple[str, ...], bool]:
    """First class (or id), the names in class, id and role, and whether the element is hidden."""
    found = {a.lower(): (b or c or d).lower() for a, b, c, d in _ATTRIBUTE.findall(attributes)}
    hidden = found.get("aria-hidden") == "true" or "hidden" in attributes.lower() and bool(_BARE.search(_ATTRIBUTE.sub("", attributes)))
    first = (found.get("class", "").split() or found.get("id", "").split() or [""])[0]
    return first, tuple(" ".join(found.get(k, "") for k in ("class", "id", "role")).split()), hidden


@functools.lru_cache(maxsize=20_000)
def _low_name(name: str) -> bool:
    """Whether a whole class name speaks of what is not content: each of its words must be of the lists, and one of them of PRIOR_NAMES.

    ``comment-list`` and ``ads`` do, ``commentary``, ``dialogue`` and ``related-work`` do not.
    """
    forms = [{w, w.removesuffix("s")} for w in _WORD.findall(name)]
    return any(f & PRIOR_NAMES for f in forms) and all(f & (PRIOR_NAMES | PRIOR_FORMS) for f in forms)


def _prior(key: str) -> tuple[float, float]:
    """Prior counts (inside, outside) of a place."""
    if key in CONTENT or key == "^plain":
        return PRIOR_WORDS, PRIOR_WORDS * PRIOR_LOW
    if key in SECTIONS or key == "^marked" or _low_name(key.partition(".")[2]):
        return PRIOR_WORDS * PRIOR_LOW, PRIOR_WORDS
    return 1.0, 1.0


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', '', words), ('open', 'close' or 'void', tag name, attributes) in page order; contents of raw elements are left out."""
    raw, position = "", 0
    while position < len(page):
        if raw:
            end = _ENDS[raw].search(page, position)
            position = end.end() if end else len(page)
            yield "close", raw, ""
            raw = ""
            continue
        m = _TOKEN.match(page, position)
        if m[5] == "<":  # a tag that its quotes leave open, or a plain sign
            m = _LOOSE.match(page, position) or m
        position = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
            elif name in VOID or m[3].endswith("/"):
                yield "void", name, m[3]
            else:
                yield "open", name, m[3]
                if name in RAW:
                    raw = name
        elif m[5]:
            yield "text", "", m[5]


class Walk:
    """Follows the open elements of a page: the place of words, whether they are read, and the marked element around them.

    blind takes marked elements for plain ones. known gives the weights of learnt places.
    """

    def __init__(self, marked: bool, known: dict[str, float] | None = None, blind: bool = False) -> None:
        self.known, self.blind = {} if known is None else known, blind
        root = "^marked" if marked and not blind else "^plain"
        self.root = (root, self._weight(root))
        self.stack: list[tuple[str, str, tuple[str, float], bool, int]] = []  # name, tag key, place with its weight, unread, marked element
        self.open: Counter[str] = Counter()
        self.unread = self.inside = self.marks = 0

    def _weight(self, key: str) -> float:
        if key in self.known:
            return self.known[key]
        a, b = _prior(key)
        return a / (a + b)

    def place(self) -> tuple[str, float]:
        return self.stack[-1][2] if self.stack else self.root

    def mark(self) -> int:
        """Number of the innermost marked element, 0 outside."""
        return self.stack[-1][4] if self.stack else 0

    def _place_of(self, name: str, first: str, names: tuple[str, ...]) -> tuple[str, float]:
        if name in ("html", "body"):
            return self.place()
        if name in CONTENT and not self.blind:
            return name, self._weight(name)
        if first:
            key = f"{name}.{first}"
            if key in self.known:
                return key, self.known[key]
        told = [w for w in names if "." + w in self.known or _low_name(w) and not (self.inside and w == "header")]
        if told:
            return min(((f"{name}.{first}" if first else "." + w, self._weight("." + w)) for w in told), key=lambda x: x[1])
        if name in SECTIONS - CONTENT and not (name == "header" and self.inside):
            return name, self._weight(name)
        return (f"{name}.{first}", self.place()[1]) if first else self.place()

    def step(self, kind: str, name: str, attributes: str) -> list[tuple[str, float]]:
        """Enters or leaves elements; gives the key and the place's weight of each tag passed."""
        if kind == "close":
            out = []
            if self.open[name]:
                while True:
                    top = self._pop()
                    if top[0] == name:
                        return [*out, (top[1], top[2][1])]
            return [("<" + name, self.place()[1])]
        first, names, hidden = _labels(attributes)
        key = f"<{name}.{first}" if first and name not in SECTIONS and name not in ("html", "body") else "<" + name
        if kind == "void":
            return [(key, self.place()[1])]
        marks = name in CONTENT and not self.blind
        if marks and self.unread and not self.inside:  # an unclosed form ends here
            self.stack, self.open, self.unread = [], Counter(), 0
        if name == "p" and self.stack and self.stack[-1][0] == "p":
            self._pop()
        place = self._place_of(name, first, names)
        unread = name in UNREAD or hidden and name not in ("html", "body")
        self.marks += marks
        self.stack.append((name, key, place, unread, self.marks if marks else self.mark()))
        self.open[name] += 1
        self.unread += unread
        self.inside += name in CONTENT
        return [(key, place[1])]

    def _pop(self) -> tuple[str, str, tuple[str, float], bool, int]:
        top = self.stack.pop()
        self.open[top[0]] -= 1
        self.unread -= top[3]
        self.inside -= top[0] in CONTENT
        return top


def is_marked(page: str) -> bool:
    return bool(re.search(r"<(?:article|main)\b", page, re.I))


def count_labels(page: str) -> dict[str, list[int]]:
    """For a labelled page: of each tag ('<' in front) and each place of words, how many stand inside and outside its content."""
    out: dict[str, list[int]] = {}

    def add(key: str, inside: bool, n: int) -> None:
        out.setdefault(key, [0, 0])[not inside] += n

    seen, blind = Walk(True), Walk(True, blind=True)
    for kind, name, data in events(page):
        if kind == "text":
            n = len(data.split())
            if n and not seen.unread:
                inside = bool(seen.inside) and seen.place()[1] >= 0.5
                for walk in (seen, blind):
                    key = walk.place()[0]
                    add(key, inside, n)
                    if "." in key[1:]:
                        add("." + key.partition(".")[2], inside, n)
            continue
        for key, weight in seen.step(kind, name, data):
            if not seen.unread:
                add(key, name in CONTENT or bool(seen.inside) and weight >= 0.5, 1)
        blind.step(kind, name, data)
    return out


def weights(counts: dict[str, tuple[int, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words by their place (above 0) and of tags (below 0)."""
    words, tags = {}, {}
    for key, (inside, outside) in counts.items():
        if key[:1] == "<":
            odds = math.log((inside + 1) / (outside + 1))
            tags[key] = min(-0.05, max(DEAREST, odds - 1 if odds < 0 else -1 / (1 + odds)))
        else:
            a, b = _prior(key)
            words[key] = (inside + a) / (inside + outside + a + b)
    return words, tags


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and next-to-last place of the contiguous run with the largest sum; (0, 0) if none is above 0."""
    best = here = 0.0
    start, region = 0, (0, 0)
    for k, score in enumerate(scores):
        if here <= 0:
            here, start = 0.0, k
        here += score
        if here > best:
            best, region = here, (start, k + 1)
    return region


def _tag_score(name: str, key: str, weight: float, tags: dict[str, float]) -> float:
    if key in tags:
        return tags[key]
    if weight < 0.5:
        return LOW_TAG
    return LINK if name == "a" else FORMAT if name in _FORMATS else PLAIN


def extract(page: str | None, words: dict[str, float], tags: dict[str, float]) -> str:
    """The main text of a page."""
    if not page:
        return ""
    walk = Walk(is_marked(page), words)
    # score, words (None: a block ends here), weight of a word here (None for tags), marked element
    parts: list[tuple[float, str | None, float | None, int]] = []
    for kind, name, data in events(page):
        if kind == "text":
            if not walk.unread:
                weight = walk.place()[1]
                parts.append((weight * len(data.split()), data, weight, walk.mark()))
            continue
        off, mark = walk.unread, walk.mark()
        passed = walk.step(kind, name, data)
        edge = None if name in BLOCKS else " " if name == "br" else ""
        if off and walk.unread:
            continue
        score = 0.0 if off or walk.unread else sum(_tag_score(name, key, weight, tags) for key, weight in passed)
        parts.append((score, edge, None, max(mark, walk.mark())))
    start, end = best_region([p[0] for p in parts])
    touched = {p[3] for p in parts[start:end] if p[2] is not None and p[3]}
    if touched:
        held = [k for k, p in enumerate(parts) if p[3] in touched]
        start, end = min(start, held[0]), max(end, held[-1] + 1)
    content = [k for k in range(start, end) if (parts[k][2] or 0) >= 0.5 and parts[k][1].strip()]
    first, last = (content[0], content[-1]) if content else (end, start)
    blocks, block = [], []
    for k in range(start, end + 1):
        _, text, weight, mark = parts[k] if k < end else (0.0, None, None, 0)
        if text is None:
            joined = " ".join(entities.unescape("".join(block)).split())
            if joined:
                blocks.append(joined)
            block = []
        elif weight is None or weight >= 0.5 or not (mark or first < k < last):
            block.append(text)
    return "\n".join(blocks)


def learn(pages: DataFrame, sample_rows: int = 2000, min_pages: int = 3) -> tuple[dict[str, float], dict[str, float]]:
    """Weights from the labelled pages of at most ``sample_rows`` ids (least seeded hashes); a key counts from ``min_pages`` of them on."""
    # ids are chosen first, so no task gathers pages; the chosen ones are sample_rows at most and may be broadcast
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b") & F.col("page_id").isNotNull())
    chosen = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id", F.lit(3)), "page_id").limit(sample_rows)
    # of pages with one id the one with the least hash
    labelled = marked.select("page_id", "html").join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min_by("html", F.xxhash64("html")).alias("html")).select("html")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: dict[str, list[int]] = {}
            for page in b.html:
                for key, (i, o) in count_labels(page).items():
                    t = total.setdefault(key, [0, 0, 0])
                    t[0] += i
                    t[1] += o
                    t[2] += 1
            yield pd.DataFrame([(k, *t) for k, t in total.items()], columns=["key", "inside", "outside", "pages"])

    counts = labelled.mapInPandas(count, "key string, inside long, outside long, pages long").groupBy("key").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"), F.sum("pages").alias("n"))
    return weights({r.key: (r.i, r.o) for r in counts.where(F.col("n") >= min_pages).collect()})


def main_text(pages: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    small_batches(pages.sparkSession)
    words, tags = learn(pages, sample_rows)

    @F.pandas_udf("string")
    def run(page: pd.Series) -> pd.Series:
        return page.map(lambda p: extract(p, words, tags))

    out = pages.select("page_id", "url", run(F.coalesce("html", F.lit(""))).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

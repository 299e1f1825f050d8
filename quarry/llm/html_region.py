"""Main text of web pages: the maximum-scoring contiguous region of words and tags.

A page is read as a sequence of words and tags. Words score positive and tags negative, by class: a word's class is
what holds it (running text, heading, list, link) and whether it stands in the page's own landmark, a tag's is its name. The
weights are log odds of standing in the article, from labelled pages: those of a bounded sample that mark their
article themselves, by an article or main element. Names in class and id attributes have weights too, from the same pages; a name made of
nothing but words for boilerplate (`ad-box`, but not `social-science`) starts from a weak prior, as does one for content. An element is worth the sum of its names;
what stands in one that is clearly negative is left out. One linear scan finds the contiguous region of the highest sum.

Link words of one block take off no more than LINKED, so that a linked paragraph doesn't part an article. Controls of forms (button, select) are left out without
breaking their block. Elements that HTML itself sets apart (nav, footer, aside, form, ...), roles and hidden elements are boilerplate.

Character references are decoded after parsing; white space inside a block becomes one space; blocks are joined by two
line ends. Headings of a header inside the article are kept. Reading takes time in proportion to a page's length however broken
its markup is and however deep it nests: each open element keeps the worst worth of those around it.

Nulls and odd rows: a null or empty page gives an empty text. Markup cut off at the end is dropped. Ties
go to the first and longest region. Repeated rows give a row each; null ids and urls stay null. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import html as charrefs
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import hash_limit, small_batches

#: Pages in the labelled sample, at most about so many, by a hash of their id and url.
SAMPLE = 2_000

TAG_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
#: What follows a tag's name. Quotes hold only after an equals sign; no stretch can be read in two ways.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
NAME = re.compile(r"[a-z]+")
HIDDEN_NOW = re.compile(r"(?:^|\s)hidden(?:\s|$)")

# Element names by their part in a page.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "object", "canvas", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTROLS = {"button", "select"}
SKIPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "audio", "video"} | CONTROLS
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | (SKIPPED - CONTROLS) | {"p", "div", "section", "article", "main", "header", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "hr", "address", "details", "summary", "body", "html", "center"}
LANDMARKS = {"article", "main"}
BOILERPLATE = set(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs "
    "header footer masthead topbar sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments disqus respond replies widget toolbar pagination pager skiplink copyright legal disclaimer".split()
)
CONTENT = set("article articles body content entry main post posts story text".split())
#: Words that may stand beside one of those.
STRUCTURE = set("area bar block box button buttons container content form icon icons inner item items link links list outer panel row section slot unit wrap wrapper".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}
CLOSED_BY_BLOCK = {"p", *HEADINGS}
SAME_LEVEL = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}}
INLINE = {"a", "span"}
DIGITS = re.compile(r"\d+")
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
#: Class of the tags inside boilerplate elements.
HIDDEN = "<hidden"
#: Score of a stretch of boilerplate. It is left out of the text anyway, so it need not part an article in two.
ASIDE = -1.0
#: Score of a tag that the labelled pages don't have, and the bounds of tags' scores.
UNSEEN, TAGS = -0.2, (-0.5, -0.1)
#: What the link words of one block take off at most, and a word outside the page's landmark at most.
LINKED, OUTSIDE = -3.0, -1.5
#: An element of less worth is left out.
CLEAR = -1.0
#: Names of classes and ids on fewer labelled pages say nothing; of the others so many are kept, those on most pages.
MIN_PAGES, LABELS = 5, 2_000

#: What the odds start from: (in, out) seen before any page.
PRIOR = {"text": (30, 3), "heading": (10, 3), "list": (30, 10), "link": (2, 6), "boilerplate": (1, 200), "out": (1, 8)}
#: The same for a class or id of nothing but words for boilerplate, or for content.
NAMED = {"boilerplate": (1, 8), "content": (4, 1)}


class Item:
    """A run of words, or a tag (words 0). inside: number of the landmark that holds it, 0 for none; low: whether an element around it is of clearly negative worth."""

    __slots__ = ("kind", "words", "text", "block", "inside", "low")

    def __init__(self, kind: str, words: int, text: str, block: int, inside: int, low: bool = False):
        self.kind, self.words, self.text, self.block, self.inside, self.low = kind, words, text, block, inside, low


def _kind(name: str, attrs: str) -> str:
    """'' for content, 'skip' for boilerplate, 'header' for a header of which headings may stay; by the element, its role and whether it shows."""
    if name in SKIPPED:
        return "skip"
    if "=" in attrs or "hidden" in attrs:
        for key, a, b, c in ATTR.findall(attrs):
            key, value = key.lower(), (a or b or c).lower()
            if (key == "role" and value in ROLES) or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                return "skip"
        if HIDDEN_NOW.search(attrs):
            return "skip"
    return "header" if name == "header" else ""


def _labels(name: str, attrs: str, inside: bool) -> list[str]:
    """'.name' for each name of the element's class and id, digits as #. A heading's id names a place, and a header inside an article may hold its title."""
    if "=" not in attrs or name in ("html", "body", "main"):
        return []
    found = [t for key, a, b, c in ATTR.findall(attrs) if (k := key.lower()) == "class" or (k == "id" and name not in HEADINGS) for t in (a or b or c).lower().split()]
    return ["." + DIGITS.sub("#", t) for t in dict.fromkeys(found) if not (inside and "header" in NAME.findall(t))]


@lru_cache(10_000)
def named(label: str) -> tuple[int, int]:
    """What the odds of a name start from."""
    words = set(NAME.findall(label))
    for kind, some in (("boilerplate", BOILERPLATE), ("content", CONTENT)):
        if words & some and words <= some | STRUCTURE:
            return NAMED[kind]
    return 1, 1


def worth(labels: list[str], weight: dict[str, float]) -> float:
    total = 0.0
    for x in labels:
        w = weight.get(x)
        total += math.log(named(x)[0] / named(x)[1]) if w is None else w
    return total


class Open:
    """The open elements."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, int, float, list[str], int]] = []  # element, boilerplate or not, number of the landmark it opened, worst worth around it, names, first item
        self.at: dict[str, list[int]] = {}  # element -> its places in the stack
        self.kinds: Counter = Counter()
        self.headings = self.inside = 0
        self.worst = 0.0
        self.spans: list[tuple[str, int, int]] = []  # name, first item, item after the last

    def push(self, name: str, kind: str, mark: int, labels: list[str], value: float, first: int) -> None:
        self.stack.append((name, kind, mark, self.worst, labels, first))
        self.at.setdefault(name, []).append(len(self.stack) - 1)
        self.kinds[kind] += 1
        self.headings += name in HEADINGS
        self.inside = self.inside or mark
        self.worst = min(self.worst, value)

    def cut(self, k: int, now: int) -> None:
        """Close what stands at place k and all after it; `now` is the number of items so far."""
        for name, kind, mark, _, labels, first in self.stack[k:]:
            self.at[name].pop()
            self.kinds[kind] -= 1
            self.headings -= name in HEADINGS
            if mark:
                self.inside = 0
            self.spans += [(x, first, now) for x in labels]
        self.worst = self.stack[k][3]
        del self.stack[k:]

    def last(self, *names: str) -> int:
        """Place of the innermost of these elements, -1 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)


def next_tag(page: str, at: int) -> tuple[int, int, str, str] | None:
    """(start, end, name, rest) of the first markup from `at` on; the name has a slash in front if it closes, and is empty for comments and the like."""
    while (at := page.find("<", at)) >= 0:
        if m := TAG_NAME.match(page, at):
            rest = REST.match(page, m.end())
            if not rest:  # cut off
                return at, len(page), "", ""
            return at, rest.end(), ("/" if page[at + 1] == "/" else "") + m[1].lower(), page[m.end() : rest.end() - 1]
        if page[at + 1 : at + 2] in ("!", "?", "/"):
            mark, skip = ("-->", 2) if page.startswith("<!--", at) else ("]]>", 9) if page.startswith("<![CDATA[", at) else (">", 1)
            end = page.find(mark, at + skip)
            return at, len(page) if end < 0 else end + len(mark), "", ""
        at += 1
    return None


def parse(page: str, weight: dict[str, float] | None = None) -> list[Item]:
    """The page's runs and tags. weight: of the names, which start from their priors."""
    return read(page, weight or {})[0]


def read(page: str, weight: dict[str, float]) -> tuple[list[Item], list[tuple[str, int, int]]]:
    """The page's runs and tags, and where each name's elements begin and end among them."""
    items: list[Item] = []
    now = Open()
    block, at, end, marks = 0, 0, len(page), 0

    def add(text: str) -> None:
        n = len(text.split())
        if not n and not (items and items[-1].words and items[-1].block == block):
            return
        if now.kinds["skip"] or (now.kinds["header"] and not (now.headings and now.inside)):
            kind = "boilerplate"
        elif now.headings:
            kind = "heading"
        elif now.at.get("a"):
            kind = "link"
        elif now.at.get("li"):
            kind = "list"
        else:
            kind = "text"
        items.append(Item(kind, n, text, block, now.inside, now.worst < CLEAR))

    while tag := next_tag(page, at):
        begin, stop, name, rest = tag
        if begin > at:
            add(page[at:begin])
        at = stop
        if not name:
            continue
        closing, name = name[0] == "/", name.lstrip("/")
        if name in BLOCKS:
            block += 1
        if name == "br":
            add(" ")
        inside, single = now.inside, rest.rstrip().endswith("/")
        if closing:
            k = now.last(name)
            # a stray end tag doesn't close the article
            if k >= 0 and not (name in ("div", "p", "span", "section") and now.last(*LANDMARKS) > k):
                now.cut(k, len(items))
            inside = now.inside
        elif name in RAW and not (name == "svg" and single):
            close = RAW_END[name].search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not single:
            if name in BLOCKS:
                while now.stack and now.stack[-1][0] in CLOSED_BY_BLOCK:
                    now.cut(len(now.stack) - 1, len(items))
            if name in SAME_LEVEL and (k := now.last(name)) > now.last(*SAME_LEVEL[name]):
                now.cut(k, len(items))
            if name == "a" and (k := now.last("a")) >= 0:
                now.cut(k, len(items))
            if name in BLOCKS or name in INLINE or name in CONTROLS:
                mark, kind, labels = 0, _kind(name, rest), _labels(name, rest, bool(now.inside))
                value = worth(labels, weight)
                if name in LANDMARKS and kind != "skip" and not now.kinds["skip"] and not now.inside and min(value, now.worst) >= CLEAR:
                    marks += 1
                    mark = marks
                now.push(name, kind, mark, labels, value, len(items))
        items.append(Item(HIDDEN if now.kinds["skip"] else ("</" if closing else "<") + name, 0, "", block, inside, now.worst < CLEAR))
    if at < end:
        add(page[at:])
    if now.stack:
        now.cut(0, len(items))
    return items, now.spans


def _marked(items: list[Item]) -> bool:
    """Whether a landmark of the page holds words outside boilerplate."""
    return any(x.inside and x.words and x.kind != "boilerplate" and not x.low for x in items)


def tally(pages: Iterable[str]) -> dict[str, list[int]]:
    """class or name -> [inside, outside, pages] over the pages that mark their article."""
    seen: dict[str, list[int]] = {}
    for page in pages:
        items, spans = read(page, {})
        if not _marked(items):
            continue
        here = set()
        inside, outside = [0], [0]
        for x in items:
            content = bool(x.inside) and x.kind != "boilerplate" and not x.low
            for k in (x.kind, *(() if content or not x.words else ("out",))):
                seen.setdefault(k, [0, 0, 0])[not content] += max(1, x.words)
                here.add(k)
            inside.append(inside[-1] + x.words * content)
            outside.append(outside[-1] + x.words * (not content))
        reach: dict[str, int] = {}
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= reach.get(k, 0) and a < b:  # an element of a name inside another of that name counts with it
                reach[k] = b
                n = seen.setdefault(k, [0, 0, 0])
                n[0] += inside[b] - inside[a]
                n[1] += outside[b] - outside[a]
                here.add(k)
        for k in here:
            seen[k][2] += 1
    return seen


def weights(seen: dict[str, list[int]]) -> dict[str, float]:
    """Log odds of each class and name, within -8 and 2.

    Text, headings and lists are worth at least 1 a word where no element says otherwise. A tag's score is within TAGS, a landmark's too: the
    labelled pages come from few templates, and a tag that these use in menus only may well stand in another's article.
    """
    out = {}
    for kind in {*seen, *PRIOR}:
        a, b = PRIOR.get(kind) or (named(kind) if kind.startswith(".") else (1, 1))
        x, y = seen[kind][:2] if kind in seen else (0, 0)
        w = max(-8.0, min(2.0, math.log((a + x) / (b + y))))
        if kind.startswith("<"):
            w = max(TAGS[0], min(w, TAGS[1]))
        elif kind in ("text", "heading", "list"):
            w = max(w, 1.0)
        elif kind == "out":
            w = max(OUTSIDE, min(w, -0.5))
        elif kind == "link":
            w = min(w, 0.5)
        out[kind] = w
    return out


def scores(items: list[Item], weight: dict[str, float]) -> list[float]:
    """The value of each run and tag. A stretch of boilerplate costs once, and the tags inside it nothing."""
    marked = _marked(items)
    out, stretch, linked, block = [], False, 0.0, -1
    for x in items:
        aside = x.kind == "boilerplate" or x.low
        if x.kind == HIDDEN or (aside and not x.text):
            out.append(0.0)
        elif aside:
            out.append(0.0 if stretch or x.inside else ASIDE)
            stretch = True
        else:
            if x.block != block:
                linked, block = 0.0, x.block
            value = weight.get("out" if marked and x.words and not x.inside else x.kind, UNSEEN) * max(1, x.words)
            if x.kind == "link" and value < 0 and not (marked and not x.inside):
                value = max(value, LINKED - linked)
                linked += value
            out.append(value)
            stretch = stretch and not x.words
    return out


def best_region(value: list[float]) -> tuple[int, int]:
    """The contiguous stretch of the highest sum, by one pass; (0, 0) if no sum is above 0."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(value):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The text of the best region."""
    if not page:
        return ""
    items = parse(page, weight)
    a, b = best_region(scores(items, weight))
    blocks: dict[int, list[str]] = {}
    for x in items[a:b]:
        if x.text and x.kind != "boilerplate" and not x.low:
            blocks.setdefault(x.block, []).append(x.text)
    texts = (" ".join(charrefs.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


#: Tags that have a weight of their own.
WEIGHED = BLOCKS | VOID | INLINE | {"b", "i", "em", "strong", "u", "small", "code"}


def learn(pages: DataFrame, sample: int = SAMPLE, rows: int | None = None) -> dict[str, float]:
    """Weights from the pages whose hashes are least, about `sample`; more where these hold no landmark at all.

    Only counts reach the driver: of a few dozen classes, and of LABELS names of classes and ids. `rows` is the size of the
    table, counted if not given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = tally(t for t in b.column(0).to_pylist() if t)
            known = {k: v for k, v in seen.items() if not k.startswith("<") or k.strip("</") in WEIGHED}
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), *(pa.array([v[n] for v in known.values()], pa.int64()) for n in range(3))], names=["kind", "within", "outside", "pages"])

    share = min(1.0, sample / max(1, pages.count() if rows is None else rows))
    label = F.col("kind").startswith(".")
    while True:
        chosen = small_batches(pages).filter(F.xxhash64("page_id", "url") <= hash_limit(share)).select("html")
        sums = chosen.mapInArrow(run, "kind string, within long, outside long, pages long").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("within", "outside", "pages")))
        found = sums.filter(~label | (F.col("pages") >= MIN_PAGES)).orderBy(label, F.desc("pages"), "kind").limit(LABELS).collect()
        if found or share >= 1:
            return weights({r["kind"]: [r["within"], r["outside"]] for r in found})
        share = min(1.0, 16 * share)


def extract_pages(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weight = weight or learn(pages)
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(t, weight) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select("page_id", "url", "html").mapInArrow(run, schema)

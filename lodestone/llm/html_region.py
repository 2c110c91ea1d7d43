"""Main text of web pages: the maximum-scoring contiguous region of a page's tokens.

A page is read as a sequence of tags and runs of words. Words score positive and tags
negative, and one linear scan finds the contiguous region of the highest sum. All weights
are log-odds of standing inside against outside the main element, learned from the pages
that mark one: of a word by its block, of a tag, and of an element by its tag or by the
words of its class, id and role. Words inside an element that is found outside main text
score negative and are no text of the region. A few names of page parts have a prior, some
pseudo-words that labelled pages outweigh, for what no labelled page shows.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
MAIN = {"article", "main"}

# Names of page parts. Each counts as PRIOR_WORDS words seen outside (inside) a
# main element before any page is read; the labelled pages' counts are added to that.
OUTSIDE_TAGS = set("head title nav header footer aside form button select textarea dialog menu label".split())
OUTSIDE_WORDS = set("ad ads advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus footer form gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets search complementary contentinfo alert".split())
INSIDE_WORDS = set("article body content entry main post story text".split())
PRIOR_WORDS = 50
#: Bound of a log-odds, and the one of any feature below which an element is no main text.
BOUND, OUTSIDE = 3.0, -0.5
#: What a tag inside a marked main element costs at most.
MARKED = -0.05
#: What a word that is no main text costs a region that runs on over it.
SKIP = -0.25
RAW = "script|style|textarea|noscript|template|iframe|svg|title|object|canvas|math|audio|video"

TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\b[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
MARKS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PIECE = re.compile(r"[a-z]+")

#: Labelled pages (those that mark their main element) the weights are learned from.
SAMPLE_PAGES = 2000


#: Elements that the start of another like them ends, and the rest of the text-level ones.
SELF_ENDING = set("p li dt dd tr td th option".split())


def features(tag: str, attrs: str) -> tuple[str, ...]:
    """What tells of an element's role: the words of its class, id and role, else its tag; a
    tag that names a page part counts beside its words. The page's frame and a main element
    take all kinds of layout words and are known by their tags alone."""
    if tag in ("html", "body"):
        return ()
    words: list[str] = []
    if tag != "main" and attrs and "=" in attrs:
        for values in MARKS.findall(attrs):
            found = PIECE.findall("".join(values).lower())
            # what an element lacks or stands beside is not what it is; an article has a header of its own
            words += [w for i, w in enumerate(found) if i == 0 or not (found[i - 1] in ("has", "with", "no", "without") or w == "header" and found[i - 1] in INSIDE_WORDS)]
    named = (tag,) if not words or tag in OUTSIDE_TAGS else ()
    return tuple(dict.fromkeys([*(f"<{t}>" for t in named), *words]))


@dataclass
class Item:
    """A tag (text is None) or a run of text, with the element and block it stands in."""

    name: str  # the tag, `/tag`, or for text the enclosing block's tag
    text: str | None
    element: int  # index of the innermost open element
    block: int  # number of the block
    link: bool  # inside a link


@dataclass
class Element:
    tag: str
    features: tuple[str, ...]
    parent: int


def parse(page: str) -> tuple[list[Item], list[Element]]:
    """The page's tokens in order and its elements, the first of which is the page.

    Unclosed elements end with their parent or with the next like them; an end tag without
    its start closes nothing; a tag cut off by the page's end goes. Scripts, styles and other
    raw elements are one token without text."""
    found: list[Item] = []
    elements = [Element("", (), -1)]
    stack, links = [0], 0
    name, number, at = "body", 0, 0

    def text(upto: int) -> None:
        if upto > at:
            found.append(Item(name, page[at:upto], stack[-1], number, links > 0))

    for m in TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        if m[1]:
            found.append(Item(m[1].lower(), None, stack[-1], number, False))
            continue
        close, tag, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if any(elements[i].tag == tag for i in stack):
                while elements[top := stack.pop()].tag != tag:
                    links -= elements[top].tag == "a"
                links -= tag == "a"
            if tag in BLOCK:
                number += 1
                name = next((elements[i].tag for i in reversed(stack) if elements[i].tag in BLOCK), "body")
            found.append(Item("/" + tag, None, stack[-1], number, False))
            continue
        if tag in BLOCK:
            number, name = number + 1, tag
            if elements[stack[-1]].tag == "p" or tag in SELF_ENDING and elements[stack[-1]].tag == tag:
                stack.pop()
        found.append(Item(tag, None, stack[-1], number, False))
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        marks = features(tag, attrs)
        if tag in BLOCK or tag == "a" or tag in OUTSIDE_TAGS or marks != (f"<{tag}>",):
            elements.append(Element(tag, marks, stack[-1]))
            stack.append(len(elements) - 1)
            links += tag == "a"
    text(len(page))
    return found, elements


@dataclass
class Weights:
    """Log-odds of main text: `element` by feature, `word` by block, `tag` (a cost), of words
    of blocks that are all links, and of words beside a page's marked main element."""

    element: dict[str, float] = field(default_factory=dict)
    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)
    link: float = 0.0
    beside: float = 0.0

    @classmethod
    def learn(cls, pages: list[str]) -> Weights:
        """Counts words and tags inside and outside the main elements that pages mark.

        Of a word outside, only the outermost element that holds no main text is told by it:
        what stands inside a menu says nothing about lists elsewhere. Without labelled pages
        the priors are left."""
        inside, outside = defaultdict(float), defaultdict(float)
        words, tags = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        link, beside = [0, 0], [0, 0]
        prior = cls(element=_odds({}, {}))
        for page in pages:
            found, elements = parse(page)
            main, hidden = prior.marked(elements)
            if not any(main):
                continue
            holds = [False] * len(elements)
            for i, e in enumerate(elements):
                if main[i] and not (e.parent >= 0 and main[e.parent]):
                    while i >= 0 and not holds[i]:
                        holds[i], i = True, elements[i].parent
            only = _link_blocks(found)
            for x in found:
                here = main[x.element]
                if x.text is None:
                    if not hidden[x.element]:
                        tags[x.name][here] += 1
                    continue
                n = len(x.text.split())
                if x.block in only:
                    link[here] += n
                beside[here] += n
                i, last = x.element, -1
                if here:
                    while i >= 0 and main[i]:
                        for f in elements[i].features:
                            inside[f] += n
                        i = elements[i].parent
                    words[x.name][1] += n
                    continue
                while i >= 0 and not holds[i]:
                    last, i = i, elements[i].parent
                if last < 0:
                    words[x.name][0] += n
                else:
                    for f in elements[last].features:
                        outside[f] += n
        return cls(
            _odds(inside, outside),
            {k: _clip(math.log((n[1] + 1) / (n[0] + 1)), 0.1, BOUND) for k, n in words.items()},
            {k: -_clip(math.log((n[0] + 1) / (n[1] + 1)) + 1, 0.05, 8.0) for k, n in tags.items()},
            _clip(math.log((link[1] + 1) / (link[0] + 1)), -BOUND, 0.0),
            _clip(math.log(1 / (beside[0] + 1)), -BOUND, 0.0),
        )

    def marked(self, elements: list[Element]) -> tuple[list[bool], list[bool]]:
        """Whether each element lies in a marked main element, and whether in one that is none."""
        main, hidden = [], []
        for e in elements:
            out = e.parent >= 0 and hidden[e.parent] or any(self.element.get(f, 0.0) < OUTSIDE for f in e.features)
            hidden.append(out)
            main.append((e.parent >= 0 and main[e.parent] or e.tag in MAIN) and not out)
        return main, hidden


def _clip(x: float, lo: float, hi: float) -> float:
    return max(lo, min(hi, x))


def _odds(inside: dict[str, float], outside: dict[str, float]) -> dict[str, float]:
    """Log-odds of every feature that was counted or has a prior."""
    names = {*inside, *outside, *(f"<{t}>" for t in (*OUTSIDE_TAGS, *MAIN)), *OUTSIDE_WORDS, *INSIDE_WORDS}
    prior_in = lambda f: PRIOR_WORDS * (f in INSIDE_WORDS or f[1:-1] in MAIN)
    prior_out = lambda f: PRIOR_WORDS * (f in OUTSIDE_WORDS or f[0] == "<" and f[1:-1] in OUTSIDE_TAGS)
    return {f: _clip(math.log((inside.get(f, 0) + prior_in(f) + 1) / (outside.get(f, 0) + prior_out(f) + 1)), -BOUND, BOUND) for f in names}


def _link_blocks(found: list[Item]) -> set[int]:
    """Blocks that have words, all of them in links."""
    linked, plain = set(), set()
    for x in found:
        if x.text is not None and not x.text.isspace():
            (linked if x.link else plain).add(x.block)
    return linked - plain


def scores(found: list[Item], elements: list[Element], weights: Weights) -> list[float]:
    """Score of every token: positive for words of main text, negative for other words and
    for tags. What is left out anyway costs words little and tags nothing, so that a page's
    articles are one region whatever stands between them."""
    main, hidden = weights.marked(elements)
    marks = any(main[x.element] and x.text is not None and not x.text.isspace() for x in found)
    only = _link_blocks(found)
    out = []
    for x in found:
        if x.text is None:
            apart = hidden[x.element] or marks and not main[x.element] and weights.beside < 0
            cost = weights.tag.get(x.name, -1.0)
            out.append(0.0 if apart else max(cost, MARKED) if main[x.element] else cost)
            continue
        each = weights.word.get(x.name, 1.0)
        if hidden[x.element] or marks and not main[x.element] and weights.beside < 0 or x.block in only and not main[x.element] and weights.link < 0:
            each = SKIP
        out.append(each * len(x.text.split()))
    return out


def best_region(score: list[float]) -> tuple[int, int]:
    """The contiguous region of the highest sum, by one scan; of equal ones the first that
    ends, and of these the shortest. (0, 0) if no sum is positive."""
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(score):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, span = run, (start, i + 1)
    return span


def main_text(page: str | None, weights: Weights) -> str:
    """The article of one page: its blocks in page order, joined by a line end.

    Character references are decoded, white space inside a block becomes one space, empty
    blocks go. Null, empty and text-free pages give the empty string.
    """
    if not page:
        return ""
    found, elements = parse(page)
    score = scores(found, elements, weights)
    a, b = best_region(score)
    blocks: list[list[str]] = [[]]
    for x, points in zip(found[a:b], score[a:b], strict=True):
        if x.text is not None:
            if points >= 0:
                blocks[-1].append(x.text)
        elif x.name.lstrip("/") in BLOCK:
            blocks.append([])
        elif x.name == "br":
            blocks[-1].append(" ")
    out = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks if parts)
    return "\n".join(x for x in out if x)


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = SAMPLE_PAGES) -> Weights:
    """Weights from about `rows` pages that mark a main element, chosen by a hash of the id."""
    marked = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    n = marked.count()
    rate = min(1.0, rows / max(1, n))
    draw = F.pmod(F.xxhash64("id", F.lit(31)), F.lit(1 << 30))
    got = marked.where(draw < F.lit(int(rate * (1 << 30)))).collect()
    return Weights.learn([r["html"] for r in sorted(got, key=lambda r: (r["id"] is None, r["id"], r["html"]))])


def extract_main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points of the text).

    Null or empty html gives an empty text. Nothing is cut however long the page; repeated
    rows are each returned; an empty table gives an empty result; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # one number a tag name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                texts = [main_text(t, shared.value) for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)



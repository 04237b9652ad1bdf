"""The main text of a web page as its maximum-scoring run of tokens.

A page is a sequence of words and tags. Words score by where they stand (the section around
them, the block, whether they are a link's) and by the words in the class and id of that section, tags score below
zero; all weights are log odds counted on labelled pages, which are pages that mark one article themselves. One
linear scan finds the contiguous run of the highest total score, which is the content region. What lies in it below
menus, headers, footers, sidebars, notices, adverts, forms and reader comments is cut out, and the rest is
given as one line per block.

An element is known for one of these by its tag, by a class, id or role that says nothing else (``cookie-notice``,
``comment-list``), or by a name that holds such a word among others (``login-info``) if most of its words are
links or the labelled pages tell that its name stands outside of articles. What holds the page's main heading, its
``main`` element or most of its running text is a wrapper and none of these.

The fit reads at most ``BOUND`` labelled pages, those of lowest id hash; without any the weights are the priors.
Null pages are empty; a page without words or with no run above zero has the empty text. Character
references are decoded and white space of a block becomes one space. Repeated rows each get their own
text. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import slices, text_of

#: Labelled pages that a fit reads at most, and how often a place must be seen to have its own weight.
BOUND, SEEN = 1_000, 20
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|select|textarea|object|title)\b.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)"""
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role|style|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Elements, and words in class, id or role, of what is never part of the article.
OUTSIDE = frozenset("nav header footer aside form button dialog menu".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notification alert popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager toolbar comment comments respond reply replies discussion disqus share "
    "sharing social related recommended recommendations widget masthead header footer copyright login search complementary "
    "contentinfo dialog".split()
)
#: Words that say nothing in a name beside one of those.
NEUTRAL = frozenset(
    "area bar bottom box button buttons container form icons inner item items left link links list outer posts right section "
    "site stories thread top unit wrap wrapper global main primary secondary".split()
)
GOOD = frozenset("article content post entry story main body text page".split())
SECTIONS = frozenset("article main section div td body center details figure".split()) | OUTSIDE
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th summary address".split())
#: Elements that end a line of text.
BREAKS = SECTIONS | BLOCKS | frozenset("ul ol dl table tr thead tbody tfoot hr html head option fieldset legend".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
WORD = re.compile(r"[^\W\d_]+")


class Place:
    """An open element: the section and block that words in it stand in, and whether it lies outside of articles.

    What it holds is known when the page has been read; ``settle`` tells then what it is.
    """

    __slots__ = ("article", "block", "cut", "heads", "kind", "linked", "links", "name", "names", "near", "outside", "parent", "section", "words")

    def __init__(self, name: str, attributes: str, parent: Place | None):
        self.name, self.parent, self.kind, self.names = name, parent, "", ()
        #: Why it may be cut: hidden, its tag, a name that says nothing else, or a name that holds such a word.
        self.cut = "tag" if name in OUTSIDE else ""
        if attributes:
            given = [[w.lower() for w in WORD.findall(n)] for _, v in NAMED.findall(attributes) for n in v.strip("\"'").split()]
            self.names = tuple(sorted({w for n in given for w in n}))
            if name not in ("article", "main", "body", "html") and not self.cut:
                marked = [n for n in given if not MARKS.isdisjoint(n)]
                if any(MARKS.union(NEUTRAL).issuperset(n) for n in marked):
                    self.cut, self.kind = "name", "-"
                elif marked:
                    self.cut = "part"
            if not self.kind and not GOOD.isdisjoint(self.names):
                self.kind = "+"
            if HIDDEN.search(attributes):
                self.cut = "hidden"
        self.words = self.links = self.heads = 0
        self.outside, self.article = False, 0
        self.section, self.block, self.linked = "body", "", ""
        #: The name words of the element, or of those around it up to the section.
        self.near = self.names or (parent.near if parent is not None and name not in SECTIONS else ())

    def settle(self, running: int, weights: dict[tuple[str, str], float]) -> None:
        """What the element is, once its parent is settled, on a page of ``running`` words of running text."""
        parent, name = self.parent, self.name
        cut = self.cut
        if cut in ("name", "part") or name == "form" and cut == "tag":
            # Reader comments may outweigh the article, but hold none of its heads.
            talk = any(w.startswith(("comment", "repl", "respon", "discus", "disqus")) for w in self.names)
            if self.heads or 2 * self.words > running and not talk:
                cut = ""
            elif cut == "part":
                known = [weights["n", w] for w in self.names if ("n", w) in weights]
                if 2 * self.links <= self.words + self.links and not (known and sum(known) < 0):
                    cut = ""
        if not cut and self.kind == "-":
            self.kind = ""
        self.outside = bool(cut) or (parent is not None and parent.outside)
        if parent:
            self.section, self.block, self.linked = parent.section, parent.block, parent.linked
        if name in SECTIONS and (name not in OUTSIDE or cut):
            self.section, self.block, self.linked = name + ("-" if cut == "part" else self.kind), "", ""
        elif name in BLOCKS:
            self.block = name
        elif name == "a":
            self.linked = "a"
        # 2 within an article of the page's own marking, 1 within what is named like one.
        above = parent.article if parent else 0
        self.article = 2 if name in ("article", "main") else max(above, int(self.kind == "+"))

    def at(self) -> str:
        return f"{self.section}>{self.block}>{self.linked}"


Token = tuple[str, str, str, Place]


def tokens(page: str, weights: dict[tuple[str, str], float] | None = None) -> list[Token]:
    """(type, what, text, element): type ``w`` words, ``t`` a tag with its name; the elements are settled."""
    root = Place("", "", None)
    places, stack, out = [root], [root], []
    opened: Counter = Counter()
    at = 0

    def words(raw: str) -> None:
        if raw.strip():
            place = stack[-1]
            out.append(("w", "", entities.unescape(raw), place))
            n = len(raw.split())
            if any(p.name == "a" for p in stack[-3:]):
                place.links += n
            else:
                place.words += n

    for m in TOKEN.finditer(page):
        if m.start() > at:
            words(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        place = stack[-1]
        if m[2]:
            while opened[name]:
                opened[gone := stack.pop().name] -= 1
                if gone == name:
                    break
        elif name not in VOID and not m[4].endswith("/"):
            if name in BREAKS:
                # A paragraph ends where the next block begins, with what is open in it.
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p" or name == "li" and stack[k].name == "li":
                        for p in stack[k:]:
                            opened[p.name] -= 1
                        del stack[k:]
                        break
                    if stack[k].name in BREAKS or not opened["p"] and name != "li":
                        break
            opened[name] += 1
            place = Place(name, m[4], stack[-1])
            stack.append(place)
            places.append(place)
            place.heads = int(name in ("h1", "main"))
        out.append(("t", name, "", place))
    if at < len(page):
        words(page[at:])
    for place in reversed(places):
        if (above := place.parent) is not None and place.cut != "hidden":
            above.links += place.links
            # Headings and words of what is cut for its tag are none of the element's around it.
            if place.cut != "tag" or place.name == "form":
                above.words, above.heads = above.words + place.words, above.heads + place.heads
    for place in places:
        place.settle(root.words, weights or {})
    return out


def count(page: str) -> Counter:
    """How often each place's and name's words and each tag stand inside and outside the one article of a page; else nothing."""
    if len(re.findall(r"<article\b", page, re.I)) + len(re.findall(r"<main\b", page, re.I)) != 1:
        return Counter()
    out: Counter = Counter()
    for kind, what, text, place in tokens(page):
        inside = place.article == 2 and not place.outside
        if kind == "t":
            out[kind, what, inside] += 1
            continue
        n = len(text.split())
        out[kind, place.at(), inside] += n
        for name in place.near:
            out["n", name, inside] += n
    return out


def prior(what: str) -> float:
    """A word's weight where no labelled page tells it."""
    section, block, linked = what.split(">")
    if section.rstrip("+-") in OUTSIDE or section.endswith("-"):
        return -0.5
    if linked:
        return -0.3
    return 1.0 if block or section.rstrip("+") in ("article", "main") or section.endswith("+") else 0.3


def weigh(counts: Counter) -> dict[tuple[str, str], float]:
    """Log odds of standing in the article; bounded, and below zero for tags."""
    out = {}
    for kind, what in {k[:2] for k in counts}:
        inside, outside = counts[kind, what, True], counts[kind, what, False]
        if inside + outside >= SEEN:
            odds = math.log((inside + 0.5) / (outside + 0.5))
            out[kind, what] = min(-0.1, max(-1.0, odds)) if kind == "t" else min(1.0, max(-0.5, odds))
    return out


def scores(found: list[Token], weights: dict[tuple[str, str], float]) -> list[float]:
    """What each token adds to a run."""
    out = []
    for kind, what, text, place in found:
        if kind == "w":
            what = place.at()
            weight = weights.get((kind, what))
            weight = prior(what) if weight is None else weight
            known = [weights["n", n] for n in place.near if ("n", n) in weights]
            if known:
                weight = (weight + sum(known) / len(known)) / 2
        else:
            weight = weights.get((kind, what))
            weight = (-0.1 if what in BLOCKS else -0.5) if weight is None else weight
        if place.article:
            # An advert or a form within an article must not cut it in two.
            weight = max(weight, -0.05)
        out.append(weight * len(text.split()) if kind == "w" else weight)
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """Where the contiguous run of the highest sum begins and ends; empty if none is above zero."""
    best, total, start, run = 0.0, 0.0, 0, (0, 0)
    for i, value in enumerate(values):
        total += value
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, run = total, (start, i + 1)
    return run


def extract(page: str, weights: dict[tuple[str, str], float]) -> str:
    """The main text of one page."""
    found = tokens(page, weights)
    blocks: list[list[str]] = [[]]
    for kind, what, text, place in found[slice(*best_run(scores(found, weights)))]:
        if kind == "t":
            if what in BREAKS:
                blocks.append([])
            elif what == "br":
                blocks[-1].append(" ")
        elif not place.outside:
            blocks[-1].append(text)
    lines = (" ".join("".join(b).split()) for b in blocks if b)
    return "\n".join(line for line in lines if line)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bound: int = BOUND) -> dict:
    """Weights from at most ``bound`` labelled pages, counted on the executors."""
    marks = F.regexp_count(html_col, F.lit("(?i)<article\\b")) + F.regexp_count(html_col, F.lit("(?i)<main\\b"))
    ids = pages.filter(marks == 1).select(F.col(id_col).cast("bigint").alias("id")).filter("id IS NOT NULL").distinct()
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(bound)
    # At most ``bound`` ids.
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), text_of(html_col).alias("html"))
    rows = rows.join(F.broadcast(chosen), "id").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                out += count(page)
        rows = [(*k, n) for k, n in out.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["kind", "what", "inside", "n"])

    counted = rows.mapInArrow(run, "kind string, what string, inside boolean, n bigint")
    # Places of a bounded number of pages, and only those seen often enough.
    sums = counted.groupBy("kind", "what", "inside").agg(F.sum("n").alias("n")).collect()
    return weigh(Counter({(r["kind"], r["what"], r["inside"]): r["n"] for r in sums}))


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict | None = None
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    weights = fit(pages, id_col, html_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 21):
            texts = [extract(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html")
    )
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")

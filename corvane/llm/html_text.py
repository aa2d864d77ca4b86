"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of tags and text runs. Each word counts the weight of its context (the nearest telling element
around it, else its block: p, li, div ...), each tag its own, mostly negative, weight; weights are log odds of lying inside the
article, counted on labelled pages (those that mark one article themselves). One linear scan finds the contiguous run of the
greatest sum. What lies in menus, forms, notices and the like counts nothing and is left out of the run.

The run decides what is text. Short blocks at its ends, which may score below their tags, come with it: it is widened to the
element that holds it whole, to the outermost article or else main around that, and from a section to the sections beside it.
Where nothing but the page itself holds it, it is widened to the blocks next to it that lie in no other element.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8

#: Attributes end at the next <, quoted ones aside, and what has no end is given up at once, so matching takes linear time.
_ATTRIBUTES = r"""(?:"[^"]*+"|'[^']*+'|[^'"<>]++)*+"""
PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|iframe|noembed|noframes|xmp|svg|math|object)\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attr>{_ATTRIBUTES})>"
    r"""|<(?P<broken>/?[a-zA-Z][^<>"']*+)(?=<)""",
    re.S | re.I,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold others; the rest of the blocks (p, h1, li, td ...) only separate.
HOLDERS = frozenset("html body main article section div nav header footer aside form ul ol dl menu table tbody thead tfoot tr figure details dialog fieldset center blockquote select button head search".split())
DROPPED = frozenset("nav footer aside form dialog menu select button head search datalist optgroup option title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words that mark what is no article text, where a class or id name has no other words than these and those of PLACES.
NOTICE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion promoted banner banners
    cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox paywall newsletter subscribe subscription signup login
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc sidebar sidebars rail footer foot masthead topbar toolbar
    comment comments commentlist disqus respond reply replies discussion
    related recommended recommendations share sharing social widget widgets skip hidden""".split()
)
#: Words that say of a marked element where it is or what it looks like.
PLACES = frozenset(
    """site page main primary secondary global top bottom left right upper lower inner outer mobile desktop sticky fixed floating visually is js wp
    box bar block area wrap wrapper container holder panel list item items link links button buttons text message unit slot section region row column""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A marked element with this share of the words outside of links, or more, is the text itself.
WHOLE = 0.9
NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@dataclass(frozen=True)
class Weights:
    """words: by context; tags: by name (a leading / for end tags). Unknown ones get the default of their kind."""

    words: Mapping[str, float] = field(default_factory=dict)
    tags: Mapping[str, float] = field(default_factory=dict)
    word: float = 1.0
    link_word: float = -0.5
    tag: float = -1.0


@dataclass(frozen=True)
class HtmlText:
    """sample: labelled pages that the weights are counted on at most (those of the smallest id hashes). contexts: contexts and tags
    that get weights at most, the most frequent; others have the defaults of their kinds."""

    sample: int = 2000
    contexts: int = 10_000
    least: float = 0.05
    most: float = 4.0


class Node:
    """An element that holds others.

    number counts elements in page order and last is the greatest number inside, so holding is a comparison however deep a
    page is nested. marked: dropped for its names, which _spare() may take back; firm: dropped, or inside what is, for another reason. article is the outermost article around, or the element itself; main is the outermost main likewise.
    """

    __slots__ = ("article", "dropped", "firm", "kind", "last", "main", "marked", "number", "own_header", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, kind: str, number: int = 0) -> None:
        self.tag, self.parent, self.dropped, self.kind, self.number, self.last = tag, parent, dropped, kind, number, number
        self.article: Node | None = (parent and parent.article) or (self if tag == "article" else None)
        self.main: Node | None = (parent and parent.main) or (self if tag == "main" else None)
        self.marked = False
        self.firm: bool = parent is not None and parent.firm
        self.own_header: bool = tag in ("article", "main") or (parent is not None and parent.own_header)


def _notice(names: str) -> str:
    """The first word of NOTICE in a name that has none but such and those of PLACES."""
    for name in names.split():
        words = [x.lower() for x in NAME.findall(name)]
        marked = [x for x in words if x in NOTICE]
        if marked and all(x in NOTICE or x in PLACES for x in words):
            return marked[0]
    return ""


def _dropped(tag: str, attr: str, inside: Node | None) -> tuple[bool, str]:
    """Whether an element is no article text, and its context for word weights."""
    if tag in DROPPED:
        return True, tag
    bad = ""
    if attr.strip(" /"):
        for m in ATTR.finditer(attr):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "class" or (key == "id" and tag not in INLINE):
                bad = bad or _notice(value)
            elif (key == "role" and value.strip().lower() in ROLES) or key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return True, "hidden"
    # an article in another one is a comment or the like and goes by its names
    if bad and tag not in ("body", "html", "main") and tag not in HEADINGS and not (tag == "article" and not (inside and inside.article)):
        return True, f".{bad}"
    if tag == "header":  # of the page; an article may have its own
        return not (inside and inside.own_header), "header"
    return False, tag


class Part:
    """A text run or a tag, with the element around it. words is 0 for tags. inner: the block that text is in, as <name>."""

    __slots__ = ("block", "inner", "key", "node", "text", "words")

    def __init__(self, text: str, words: int, node: Node, block: int, key: str, inner: str = "") -> None:
        self.text, self.words, self.node, self.block, self.key, self.inner = text, words, node, block, key, inner


def parse(page: str) -> list[Part]:
    """Text runs and tags in page order. Text runs of one block have the same block number."""
    root = Node("html", None, False, "html")
    node, block, link, inner = root, 0, 0, ""
    nodes, opened = [root], Counter(["html"])
    out: list[Part] = []
    at = 0

    def enter(tag: str, dropped: bool, kind: str, verdict: str = "") -> Node:
        new = Node(tag, node, dropped, kind, len(nodes))
        new.marked = verdict.startswith(".")
        new.firm |= bool(verdict) and not new.marked
        nodes.append(new)
        opened[tag] += 1
        return new

    def leave() -> Node:
        if node.parent is None:
            return root
        opened[node.tag] -= 1
        return node.parent

    def text(raw: str) -> None:
        if raw:
            s = entities.unescape(raw) if "&" in raw else raw
            n = len(s.split())
            out.append(Part(s, n, node, block, "a" if link > 0 else node.kind, f"<{inner or node.tag}>"))

    for m in PART.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m["raw"] or not m["tag"]:
            if m["raw"]:
                out.append(Part("", 0, node, block, m["raw"].lower()))
            elif m[0].startswith("<![CDATA["):
                pass
            continue
        tag, end = m["tag"].lower(), bool(m["end"])
        if tag in INLINE:
            if tag == "br":
                out.append(Part(" ", 0, node, block, ""))
            elif tag == "a":
                link = 0 if end else 1
                out.append(Part("", 0, node, block, "/a" if end else "a"))
            elif not end and m["attr"] and tag not in VOID:
                bad, why = _dropped(tag, m["attr"], node)
                if bad:  # hidden or marked inline parts are left out to their end
                    node = enter(tag, True, "hidden", why)
                elif node.tag == tag and node.kind == "hidden":
                    node = enter(tag, True, "hidden")
            elif node.tag == tag and node.kind == "hidden":
                node = leave() if end else enter(tag, True, "hidden")
            continue
        block, link, inner = block + 1, 0, "" if end or tag in HOLDERS else tag
        out.append(Part("", 0, node, block, f"/{tag}" if end else tag))
        while node.tag in INLINE:
            node = leave()
        if end:
            if opened[tag] > (tag == root.tag):  # the root stays open
                while node.tag != tag:
                    node = leave()
                node = leave()
        elif tag in HOLDERS or (tag not in VOID and m["attr"].strip(" /") and _dropped(tag, m["attr"], node)[0]):
            if tag not in HOLDERS:  # a block such as <p class="notice"> ends with the next tag of its kind
                while node.tag == tag:
                    node = leave()
            if not (tag in ("html", "body") and node.tag == tag) and not m["attr"].endswith("/"):
                bad, kind = _dropped(tag, m["attr"], node)
                node = enter(tag, bad or node.dropped, kind if bad else (node.kind if node.dropped or tag in ("div", "section") else kind), kind if bad else "")
        elif tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dt", "dd"):
            while node.tag == tag and node.dropped:  # an unclosed dropped block of the same kind
                node = leave()
    text(page[at:])
    for n in reversed(nodes[1:]):
        n.parent.last = max(n.parent.last, n.last)
    if any(n.marked for n in nodes):
        _spare(nodes, out)
    return out


def _spare(nodes: list[Node], parts: list[Part]) -> None:
    """Marked elements that hold nearly all of the words are kept after all."""
    words = [0] * len(nodes)
    for x in parts:
        if x.words and x.key != "a" and not x.node.firm:
            words[x.node.number] += x.words
    for n in reversed(nodes[1:]):
        words[n.parent.number] += words[n.number]
    if not any(n.marked and words[n.number] and words[n.number] >= WHOLE * words[0] for n in nodes):
        return
    for n in nodes[1:]:
        if n.marked and words[n.number] >= WHOLE * words[0]:
            n.marked = False
        n.dropped = n.firm or n.marked or n.parent.dropped
        if not n.firm and not n.marked:
            n.kind = n.parent.kind if n.parent.dropped or n.tag in INLINE or n.tag in ("div", "section") else n.tag
    for x in parts:
        if x.words and x.key != "a":
            x.key = x.node.kind


def _holds(outer: Node, x: Node) -> bool:
    return outer.number <= x.number <= outer.last


def _sections(parts: list[Part], section: Node) -> set[int]:
    """Numbers of the elements with parts in sections that have the same parent as this one."""
    known = {section.parent.number if section.parent else -1: False}
    for x in parts:
        path, node = [], x.node
        while node.number not in known:
            path.append(node.number)
            if node.parent is None or node.parent is section.parent:
                known[node.number] = node.tag == "section" and node.parent is section.parent
                break
            node = node.parent
        known.update(dict.fromkeys(path, known[node.number]))
    return {k for k, v in known.items() if v}


def _score(x: Part, w: Weights) -> float:
    if x.node.dropped:  # what is left out parts nothing
        return 0.0
    if not x.words:
        return w.tags.get(x.key, w.tag) if x.key else 0.0
    each = w.words.get(x.key)
    if each is None:
        each = w.link_word if x.key == "a" else w.words.get(x.inner, w.word)
    return x.words * each


def best_run(parts: list[Part], w: Weights) -> tuple[int, int]:
    """First and last part of the run of the greatest sum; (0, -1) if no part scores positive. Ties: the first run."""
    best, run, start, out = 0.0, 0.0, 0, (0, -1)
    for i, x in enumerate(parts):
        if run <= 0:
            run, start = 0.0, i
        run += _score(x, w)
        if run > best:
            best, out = run, (start, i)
    return out


def _end(parts: list[Part], i: int, step: int, top: Node, w: Weights) -> int:
    """The last part from i on, in a direction, that comes with a run which only the page holds: what lies right in `top`, up to the
    first words that score negative."""
    last = i
    i += step
    while 0 <= i < len(parts) and (parts[i].node is top or parts[i].node.dropped) and not (parts[i].words and _score(parts[i], w) < 0):
        last, i = i, i + step
    return last


def extract(page: str | None, w: Weights, scan: Callable[[list[Part], Weights], tuple[int, int]] = best_run) -> str:
    """The article's blocks, each with single blanks, joined by empty lines; empty if there is none.

    scan: finds the run. Where learned weights leave no run, as on pages unlike all those that were labelled, the defaults are tried.
    """
    if not page:
        return ""
    parts = parse(page)
    first, last = scan(parts, w)
    if last < first and (w.words or w.tags):
        w = Weights()
        first, last = scan(parts, w)
    run = [x for x in parts[first : last + 1] if x.words and not x.node.dropped]
    if not run:
        return ""
    first_node, last_node = min((x.node for x in run), key=lambda n: n.number), max((x.node for x in run), key=lambda n: n.number)
    top: Node | None = first_node
    while top is not None and not _holds(top, last_node):
        top = top.parent
    while top is not None and top.parent is not None and top.tag in ("ul", "ol", "dl", "table", "tbody", "thead", "tr", "blockquote", "figure", "header"):
        top = top.parent
    assert top is not None  # the root holds everything
    top = top.article or top.main or top
    if top.tag in ("html", "body"):
        while not any(x.words and not x.node.dropped for x in parts[first : first + 1]):
            first += 1
        while not any(x.words and not x.node.dropped for x in parts[last : last + 1]):
            last -= 1
        first = _end(parts, first, -1, top, w) if parts[first].node is top else next(i for i, x in enumerate(parts) if x.block == parts[first].block and x.node is parts[first].node)
        last = _end(parts, last, 1, top, w) if parts[last].node is top else max(i for i, x in enumerate(parts) if x.block == parts[last].block and x.node is parts[last].node)
        chosen = parts[first : last + 1]
    else:
        beside = _sections(parts, top) if top.tag == "section" else frozenset()
        chosen = [x for x in parts if _holds(top, x.node) or x.node.number in beside]
    lines: dict[int, list[str]] = {}
    for x in chosen:
        if x.text and not x.node.dropped:
            lines.setdefault(x.block, []).append(x.text)
    blocks = (" ".join("".join(x).split()) for x in lines.values())
    return "\n\n".join(x for x in blocks if x)


# ---------------------------------------------------------------- weights


def _labelled(parts: list[Part]) -> list[bool] | None:
    """For each part whether it lies in the page's one article; None if the page doesn't mark just one."""
    # what lies inside a dropped element is dropped too, so an article that counts has an outermost one that does
    tops = {x.node.article for x in parts if x.node.article and not x.node.article.dropped}
    if len(tops) != 1:
        return None
    (article,) = tops
    return [x.node.article is article and not x.node.dropped for x in parts]


def learn(pages: DataFrame, p: HtmlText = HtmlText(), id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Log odds of words by context and of tags, counted on at most p.sample pages that mark one article.

    Word weights are bounded to least..most on their side; end and start tags inside articles outweigh no words: tags
    are never positive. Without labelled pages the defaults of Weights hold.
    """
    keyed = pages.filter(F.col(html_col).isNotNull() & F.col(html_col).contains("<article")).select(F.xxhash64(F.col(id_col)).alias("key"), F.col(html_col).cast("string").alias("html"))
    bound = keyed.select("key").orderBy("key").limit(p.sample).agg(F.max("key")).first()[0]
    if bound is None:
        return Weights()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                parts = parse(page or "")
                inside = _labelled(parts)
                for x, label in zip(parts, inside or [], strict=inside is not None):
                    total["word" if x.words else "tag", x.key, label] += x.words or 1
                    if x.words and x.key != "a":
                        total["word", x.inner, label] += x.words
        rows = [(k, key, label, n) for (k, key, label), n in total.items() if key]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["kind", "key", "inside", "n"])

    counted = keyed.filter(F.col("key") <= bound).select("html").mapInArrow(count, "kind string, key string, inside boolean, n long")
    rows = counted.groupBy("kind", "key", "inside").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "kind", "key", "inside").limit(2 * p.contexts).collect()
    counts: dict[tuple[str, str], list[float]] = {}
    for r in rows:
        counts.setdefault((r.kind, r.key), [0.5, 0.5])[bool(r.inside)] += r.n
    words, tags = {}, {}
    for (kind, key), (out, into) in counts.items():
        odds = math.log(into / out)
        if kind == "word":
            words[key] = math.copysign(min(p.most, max(p.least, abs(odds))), odds)
        else:
            tags[key] = -min(p.most, max(p.least, -odds))
    return Weights(words, tags)


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; a null page counts as empty and has the text "" of 0 characters.

    No shuffle; rows don't depend on one another.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, starts = utf8(batch.column(2))
            for i, j in slices(starts):
                part = batch.slice(i, j - i)
                texts = [extract(x, weights) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with weights from pages that mark their article."""
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, learn(pages)).withColumnRenamed("id", "page_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op9_main_text": op9_main_text}

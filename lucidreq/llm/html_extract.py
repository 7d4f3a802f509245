"""Main text of HTML pages by tag-path ratios.

A page is read as text blocks, each under its root-to-leaf tag path. For every
path the text length, the punctuation and the share of link text are summed over
its nodes; the two ratios (text per node, punctuation per node) are smoothed over
neighbouring paths in page order and fused by their product. Paths near the
strongest one are content, and so are the paths that live in the same container
(headings, lists, quotes of the article). Paths through boilerplate containers
(navigation, footers, forms, asides, and containers whose classes name such
things) have a ratio of 0, and so do paths that are mostly links, unless they lie
in the article element itself; the header of an article is part of it. A class
name is read word by word: it names boilerplate by its last word or if all its
words do, and names that may also say what a text is about ("search", "related")
leave the decision to the element's own ratios. Articles that are comments,
adverts or teasers are none. Outside article and main each bare container is
judged for itself, since menus and lines of rights share their path with text. Elements
that a browser doesn't show as text (scripts, fallbacks of media and noscript,
option lists) have none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import table, text_batches

#: HTML's elements by role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow msup msub msubsup mfrac msqrt mroot mtext mstyle mspace semantics svg text tspan g".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp select object canvas audio video".split())
BOILERPLATE = frozenset("nav footer aside form header menu dialog button fieldset head".split())
#: Elements that hold the article's own text: what their class says about them drops nothing.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figure figcaption caption article main code em strong b i span a mark small sup sub q cite math svg text".split())
#: An open element of the set is closed by the start of the key's element.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
KEEPS_OPEN = frozenset("ul ol dl table div section article main aside nav footer header body html td th blockquote form".split())
#: Words that name boilerplate in class, id and role, as the last word of a name or beside words of containers.
_NAMES = frozenset(
    "banner nav navbar navigation menu footer header masthead breadcrumb breadcrumbs crumbs consent gdpr notice alert warning byline replies respond newsletter subscribe subscription signup login popup modal overlay pager pagination widget toolbar sidebar promo promos promotion promoted recommend recommended recommendations complementary contentinfo hidden colophon skip".split()
)
#: Those that also name what a text is about: such an element is judged by its own ratios.
_TOPICS = frozenset("share sharing social related search tag tags".split())
#: Those that mean readers' comments, adverts and notices of a site wherever they lead or end a name.
_COMMENTS = frozenset("comment comments commentlist commentform disqus".split())
_ADVERTS = frozenset("advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsors sponsored".split())
#: Those that mean them beside words of containers only ("ad-hoc" and "cookie-recipe" do not).
_SHORT = frozenset("ad ads cookie cookies".split())
#: Words of containers, which say nothing about what is in them.
_CONTAINERS = frozenset(
    "box bar bars list lists section area wrap wrapper container block blocks link links item items top bottom left right main site page global primary secondary button buttons btn icon icons inner outer content post posts entry article articles body text unit slot zone frame panel group row col column legal copyright meta logo fixed sticky mobile desktop info title thread reply user reader author js side small large form policy law bread module region holder placeholder wp sub level children even odd".split()
)
#: Names of an article element that only leads to another page.
_TEASERS = frozenset("teaser teasers preview promo related recommended".split())
#: Elements without words of their own to judge by: a class on them says how they look.
UNJUDGED = frozenset("html body main tr td th code em strong b i span a mark small sup sub q cite math svg text".split())
#: A topic's element is text from this many characters outside links, if they hold a sentence and few are links.
TOPIC_TEXT, TOPIC_LINKS = 60, 0.2
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop|itemtype)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: A comment, a declaration, a tag; or a tag in which a quote is left open, which ends at the next bracket.
_TAG = re.compile(r"""<!--|<[!?]|</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?([a-zA-Z][^\s/>]*)([^>]*)>""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: What a line about the rights in a page begins with or says.
_RIGHTS = re.compile(r"^(?:©|\(c\)|copyright\b)|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", re.I)
_PUNCT = re.compile(r"[.,;:!?。，、；：！？؟،]")

#: A path is content from this share of the strongest path's fused ratio.
THRESHOLD = 0.25
#: A path of which more text than this is in links is no content.
LINK_SHARE = 0.6


BAD, TOPIC, HEADER = "!", "?", "h"


def _named(name: str, text_element: bool) -> str:
    """What one name of a class, an id or a role says: BAD, TOPIC, HEADER (a header, which an article may have too) or nothing."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in ("has", "with", "no", "without"):
        return ""
    filler = all(w in _CONTAINERS or w in _NAMES or w in _TOPICS or w in _COMMENTS or w in _ADVERTS or w in _SHORT or w.isdigit() or len(w) == 1 for w in words)
    strong = [w for w in words if w in _COMMENTS or w in _ADVERTS or w in _SHORT]
    if filler and strong:
        return BAD
    if text_element:  # paragraphs and lists are the article's own unless they say that they are comments, adverts or notices
        return BAD if filler and ("consent" in words or "gdpr" in words) else ""
    if {words[0], words[-1]} & (_COMMENTS | _ADVERTS):
        return BAD
    if words[-1] in _NAMES or (filler and any(w in _NAMES for w in words)):
        return HEADER if [w for w in words if w in _NAMES] == ["header"] else BAD
    return TOPIC if filler and any(w in _TOPICS for w in words) else ""


def _verdict(tag: str, attrs: str) -> str:
    """What an element's tag and attributes say."""
    if tag in BOILERPLATE:
        return HEADER if tag == "header" else BAD
    out = ""
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return BAD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return BAD
        if name == "itemprop" and value.lower() == "comment" or name == "itemtype" and re.search(r"/(?:Comment|WPAdBlock|WPFooter|WPHeader|WPSideBar)$", value):
            return BAD
        if name in ("class", "id", "role") and tag not in UNJUDGED:
            tokens = value.split()
            if tag == "article" and any(t.lower() in _TEASERS for t in tokens):
                return BAD
            for token in tokens:
                said = _named(token, tag in TEXT)
                if said == BAD:
                    return BAD
                out = out if out == HEADER else said or out
    return out


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters in links) of each block in page order.

    A path lists the open block elements; one that names boilerplate has a "!"
    before it, and each article has its number, so that articles are told apart.
    Inline elements don't end a block, a line break is white space.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []  # element, its step in the path
    buffer: list[str] = []
    links = depth = nodes = 0
    lower = page.lower()

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append((tuple(x[1] for x in stack), text, links))
            buffer.clear()
        links = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            if m is None and (cut := _unclosed(text)) >= 0:
                text = text[:cut]
            text = entities.unescape(text)
            buffer.append(text)
            if depth:
                links += len("".join(text.split()))
        if m is None:
            break
        at = m.end()
        tag, attrs = m.group(1) or m.group(3), m.group(2) or m.group(4) or ""
        if tag is None:  # a comment or declaration
            end = page.find("-->" if m.group() == "<!--" else ">", at)
            at = n if end < 0 else end + (3 if m.group() == "<!--" else 1)
            continue
        tag, close = tag.lower(), page[m.start() + 1] == "/"
        if tag in RAW and not close:
            if not attrs.endswith("/"):
                end = lower.find(f"</{tag}", at)
                stop = page.find(">", end) if end >= 0 else -1
                at = n if stop < 0 else stop + 1
            buffer.append(" ")
            continue
        said = "" if close else _verdict(tag, attrs)
        if tag in INLINE and said != BAD:
            if tag == "br":
                buffer.append(" ")
            elif tag == "a":
                depth = max(0, depth + (-1 if close else 1))
            if close:
                if any(x[0] == tag for x in stack[-1:]):  # an inline element that was marked
                    flush()
                    stack.pop()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        depth = 0
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag not in INLINE and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in KEEPS_OPEN:
                    break
        if tag in ("body", "html") and any(x[0] == tag for x in stack):
            continue
        if tag == "body":
            stack = [x for x in stack if x[0] == "html"]
        if not attrs.endswith("/"):
            own = any(x[0] in ("article", "main") for x in stack)
            step = f"!{tag}" if said == BAD or (said == HEADER and not own) else tag
            if said == TOPIC or step == "article":
                nodes += 1
                step = f"{'?' if said == TOPIC else ''}{tag}#{nodes}"
            stack.append((tag, step))
    flush()
    return _topics(out)


def _topics(found: list[tuple[tuple[str, ...], str, int]]) -> list[tuple[tuple[str, ...], str, int]]:
    """Elements named after a topic are text if their own ratios say so, and boilerplate otherwise."""
    sums: dict[str, list] = {}
    for path, text, linked in found:
        if not any(x[0] == "!" for x in path):
            for step in path:
                if step[0] == "?":
                    s = sums.setdefault(step, [0, 0, False])
                    s[0], s[1] = s[0] + len(text), s[1] + linked
                    s[2] = s[2] or (len(text) - linked >= TOPIC_TEXT and bool(_PUNCT.search(text)))
    as_text = {step for step, (n, linked, sentence) in sums.items() if sentence and linked <= TOPIC_LINKS * n}

    def told(step: str) -> str:
        if step[0] != "?":
            return step
        tag = step[1:].split("#")[0]
        return (step[1:] if tag == "article" else tag) if step in as_text else f"!{tag}"

    return [(tuple(told(x) for x in path), text, linked) for path, text, linked in found]


def _element(step: str) -> str:
    return step.split("#")[0]


def _unclosed(text: str) -> int:
    """Where a tag begins that the page's end cuts off, or -1."""
    m = re.search(r"</?[a-zA-Z][^>]*\Z|<!--", text)
    return m.start() if m else -1


#: Elements of running text: a link that fills one is still a part of it, while one that fills a bare container is a menu.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())


def content_blocks(found: list[tuple[tuple[str, ...], str, int]]) -> list[bool]:
    """For each block whether it is content."""
    inner = [bool(path) and path[-1] in RUNNING for path, _, _ in found]
    shown = [not any(x[0] == "!" for x in path) for path, _, _ in found]
    named = [any(_element(x) in ("article", "main") for x in path) for path, _, _ in found]
    # Bare containers are judged one by one: menus share their tag path with paragraphs.
    alone = [(named[i] or inner[i] or linked <= LINK_SHARE * len(text)) and (named[i] or not _RIGHTS.search(text) or len(text) > 200) for i, (_, text, linked) in enumerate(found)]
    order: dict[tuple[str, ...], list[float]] = {}
    for i, (path, text, linked) in enumerate(found):
        if shown[i] and alone[i]:
            s = order.setdefault(path, [0, 0, 0, 0])
            s[0] += 1
            s[1] += len(text)
            s[2] += len(_PUNCT.findall(text))
            s[3] += linked
    paths = list(order)
    fused = _fused(paths, order, LINK_SHARE)
    if not any(fused.values()):  # nothing but links: those in running text or in an article are its text
        kept = {path for i, (path, _, _) in enumerate(found) if inner[i] or named[i]}
        paths = [p for p in paths if p in kept]
        fused = _fused(paths, order, 1.0)
    best = max(fused.values(), default=0.0)
    if not best:
        return [False] * len(found)
    top = max(paths, key=lambda p: fused[p])
    # The strongest path's container: its outermost main or article element, or else its parent.
    depth = next((i + 1 for i, x in enumerate(top) if _element(x) in ("article", "main")), 0)
    articles = [i + 1 for i, x in enumerate(top) if _element(x) == "article"]
    if articles:
        depth = articles[0]
    by_name = bool(depth)
    if not depth:
        depth = len(top) - 1 if top and top[-1] not in ("div", "section", "body") else len(top)
    homes = {top[:depth]}
    if by_name:  # articles beside it that are as strong are parts of the same text
        homes |= {p[:depth] for p in paths if fused[p] >= THRESHOLD * best and len(p) >= depth and _element(p[depth - 1]) == _element(top[depth - 1])}
    strong = {p for p in paths if fused[p] >= THRESHOLD * best}
    if by_name:
        kept = {p for p in paths if p[:depth] in homes}
    else:
        kept = {p for p in paths if fused[p] and (p[:depth] in homes or p in strong)}
    return [shown[i] and alone[i] and path in kept for i, (path, _, _) in enumerate(found)]


def _fused(paths: list[tuple[str, ...]], order: dict[tuple[str, ...], list[float]], links: float) -> dict[tuple[str, ...], float]:
    """The product of both smoothed ratios of each path; 0 where more than a share is in links."""
    usable = [order[p][3] <= links * order[p][1] for p in paths]
    text_ratio = [order[p][1] / order[p][0] if ok else 0.0 for p, ok in zip(paths, usable)]
    punct_ratio = [order[p][2] / order[p][0] if ok else 0.0 for p, ok in zip(paths, usable)]
    smooth = lambda r, i: (sum(r[max(0, i - 1) : i + 2]) + 2 * r[i]) / (len(r[max(0, i - 1) : i + 2]) + 2)
    return {p: (smooth(text_ratio, i) * (0.5 + smooth(punct_ratio, i)) * order[p][1] ** 0.5 if text_ratio[i] else 0.0) for i, p in enumerate(paths)}


def main_text(page: str | None) -> str:
    """The page's article: its blocks joined by one newline, empty if there are none."""
    found = blocks(page or "")
    return "\n".join(text for (_, text, _), keep in zip(found, content_blocks(found)) if keep)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """The rows of ``pages`` with text and n_chars; the html column is read, not returned.

    Null and empty pages have the empty text. Every row stays, repeated rows
    too; columns named text or n_chars are replaced. No shuffle.
    """
    text_batches(pages.sparkSession)
    added = ["text", "n_chars"]
    own = [f"`{c}`" for c in pages.columns if c not in (column, *added)]
    kept = pages.select(F.struct(*own).alias("row") if own else F.struct(F.lit(0).alias("none")).alias("row"), F.col(f"`{column}`").cast("string").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(1).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["row", *added])

    schema = StructType([kept.schema["row"], StructField("text", StringType()), StructField("n_chars", LongType())])
    out = kept.mapInArrow(run, schema)
    return out.select(*(["row.*"] if own else []), *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))

"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Nothing inside them is shown as text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym area b base basefont bdi bdo big cite code col data del dfn em embed font i img input ins kbd link mark meta param q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr label "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mphantom menclose semantics".split()
)
#: Elements that never hold an article's text.
ASIDE = frozenset("head nav footer aside form button select option menu dialog object canvas audio video datalist fieldset input".split())
#: Words in class, id or role that name what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox banner sponsor sponsored sponsors promo promoted promotion sidebar sidebars nav navbar navigation navi menu menus "
    "breadcrumb breadcrumbs footer foot comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations widget widgets pagination pager toolbar search masthead copyright legal disclaimer skip complementary contentinfo dialog form".split()
)
#: In an article's paragraphs, headings and lists only these; other marks are common words for what an article has.
STRONG_MARKS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsored".split())
#: Lists and tables of an article go by these; other marks only where they are mostly links.
COMMENT_MARKS = frozenset("comment comments commentlist disqus respond reply replies".split())
LISTS = frozenset("ul ol table dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: These too, where they don't stand in an article.
OUTER_MARKS = frozenset("header topbar top head".split())
CONTAINERS = frozenset("html body main article section div td table tbody tr center font blockquote".split())
#: Generic boxes: of these, those whose paths aren't content go, where no article or main tells what the article is.
BOXES = frozenset("div section article main header center span details".split())
#: What an article shows in short pieces; a box with such text outside of links stays.
PIECES = frozenset("h1 h2 h3 h4 h5 h6 li dd dt td th pre code blockquote figcaption".split())
#: A start tag of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Share of a page's selected text that articles and main must hold to be all that is taken.
DOMINANT = 0.6
#: Boxes of one kind beside the article with less than this share of its content text are not of it.
LESSER = 0.25
#: A list or box with so large a share of its text in at least three links is a menu.
LINKED = 0.6
#: A path is content if its score passes this multiple of the scores' deviation, or half the best.
DEVIATIONS = 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
MARKUP = re.compile(r"(?:^|[\s\"'])(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
CLASS = re.compile(r"(?:^|[\s\"'])class\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORDS = re.compile(r"[a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?、。，！？…¿¡]")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int  # number of its tag path: that of the parent, the tag and its class
    out: bool  # not the article's, by name or mark
    inside: bool  # in an article or main element
    links: int = 0
    linked: bool = False  # in a link
    weak: int = 0  # the outermost element around it, or itself, that stands in an article and goes by a common word only
    listed: bool = False  # a list or table of an article with such a word


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=list)
    #: (element, decoded text, whether a block ends before it)
    texts: list[tuple[int, str, bool]] = field(default_factory=list)


STAYS, WEAK, LISTED, OUT = range(4)


def named_out(tag: str, attributes: str, inside: bool) -> int:
    """What an element's name or marks say: it is the article's, or not; or WEAK, a box of an article with a word that
    texts have too, or LISTED, a list or table with one."""
    if tag in ASIDE or (tag == "header" and not inside):
        return OUT
    if len(attributes) < 4:
        return STAYS
    says = STAYS
    for name, value in MARKUP.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return OUT
        if name in ("class", "id", "role") and tag not in ("html", "body", "main"):
            found = set(WORDS.findall(value))
            if found & STRONG_MARKS or (not inside and (found & MARKS or (tag != "article" and found & OUTER_MARKS))) or (tag in LISTS and found & COMMENT_MARKS):
                return OUT
            if found & MARKS:
                says = max(says, WEAK if tag in BOXES else LISTED if tag in LISTS else STAYS)
    return says


def parse(source: str) -> Page:
    """Elements with their tag paths and the text nodes in page order. Missing and crossed end tags are tolerated."""
    page = Page([Element("", -1, 0, False, False)])
    stack, at, block = [0], 0, False
    paths: dict[tuple[int, str, str], int] = {}
    standing: Counter[str] = Counter()  # open elements by tag

    def text(to: int) -> None:
        nonlocal block
        if to > at:
            raw = source[at:to]
            if not raw.isspace():
                page.texts.append((stack[-1], html.unescape(raw) if "&" in raw else raw, block))
                block = False
            elif page.texts and not block:
                k, before, started = page.texts[-1]
                page.texts[-1] = (k, before + " ", started)

    def end_from(k: int) -> None:
        standing.subtract(page.elements[e].tag for e in stack[k:])
        del stack[k:]

    def close(tags: frozenset[str] | set[str], until: frozenset[str]) -> None:
        if not any(standing[tag] for tag in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = page.elements[stack[k]].tag
            if tag in tags:
                end_from(k)
                return
            if tag in until:
                return

    pattern = TOKEN.search
    while m := pattern(source, at):
        text(m.start())
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block = True
        if m[1]:
            for k in range(len(stack) - 1 if standing[tag] else 0, 0, -1):
                if page.elements[stack[k]].tag == tag:
                    end_from(k)
                    break
                if tag in INLINE and page.elements[stack[k]].tag not in INLINE:
                    break  # a stray end tag of a phrase doesn't end a block
            continue
        if tag in CLOSES_P:
            close({"p"}, CONTAINERS)
        if tag in ENDS:
            close(ENDS[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        if tag in VOID:
            continue
        parent = page.elements[stack[-1]]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            at = end.start() if end else len(source)
            stop = source.find(">", at)
            at = len(source) if not end or stop < 0 else stop + 1
            continue
        inside = parent.inside or tag in ("article", "main")
        kind = CLASS.search(m[3])
        path = paths.setdefault((parent.path, tag, " ".join(sorted(kind[1].strip("\"'").lower().split())) if kind else ""), len(paths) + 1)
        says = named_out(tag, m[3], parent.inside)
        weak = parent.weak or (len(page.elements) if says == WEAK else 0)
        page.elements.append(Element(tag, stack[-1], path, parent.out or says == OUT, inside, int(tag == "a"), parent.linked or tag == "a", weak, says == LISTED))
        stack.append(len(page.elements) - 1)
        standing[tag] += 1
    text(len(source))
    return page


def path_scores(nodes: list[tuple[int, str]]) -> dict[int, float]:
    """Score of each tag path of text nodes (path, text) in page order.

    A path's ratio is its text length by its number of nodes, fused with its punctuation by the same number. Each
    node's ratio is smoothed with its neighbours' in page order, and a path scores the mean of its nodes.
    """
    sums: dict[int, list[float]] = {}
    for path, text in nodes:
        s = sums.setdefault(path, [0.0, 0.0, 0.0])
        s[0] += len(text)
        s[1] += 1 + len(PUNCTUATION.findall(text))
        s[2] += 1
    ratio = {p: (a / n) * (b / n) for p, (a, b, n) in sums.items()}
    own = [ratio[p] for p, _ in nodes]
    out: dict[int, list[float]] = {}
    for i, (path, _) in enumerate(nodes):
        left, right = own[i - 1] if i else own[i], own[i + 1] if i + 1 < len(own) else own[i]
        out.setdefault(path, []).append(0.25 * left + 0.5 * own[i] + 0.25 * right)
    return {p: sum(v) / len(v) for p, v in out.items()}


def content_paths(scores: dict[int, float], nodes: list[tuple[int, str]]) -> set[int]:
    """Paths whose score passes the threshold, from the deviation of the nodes' scores; the best path always does."""
    own = [scores[p] for p, _ in nodes]
    mean = sum(own) / len(own)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in own) / len(own))
    limit = min(max(DEVIATIONS * deviation, 0.1 * mean), 0.5 * max(own))
    return {p for p, s in scores.items() if s >= limit}


def main_text(source: str | None) -> str:
    """The article's text: blocks in page order joined by one space, white space inside as one space; empty if none."""
    if not source:
        return ""
    page = parse(source)
    elements = page.elements
    kept = without_weak(elements, [(k, t, b) for k, t, b in page.texts if not elements[k].out])
    if not kept:
        return ""
    nodes = [(elements[k].path, t) for k, t, _ in kept]
    chosen = content_paths(path_scores(nodes), nodes)
    n = len(elements)
    length, linked, selected, links, piece = [0] * n, [0] * n, [0] * n, [e.links for e in elements], [False] * n
    for k, t, _ in kept:
        length[k] += len(t)
        linked[k] += len(t) * elements[k].linked
        selected[k] += len(t) * (elements[k].path in chosen)
    titled = [e.tag == "h1" and length[k] > 0 for k, e in enumerate(elements)]
    children: dict[int, list[int]] = {}
    for k in range(n - 1, 0, -1):  # an element comes after the one it is in
        e = elements[k]
        piece[k] = piece[k] or (e.tag in PIECES and length[k] > linked[k])
        if length[k]:
            children.setdefault(e.parent, []).append(k)
        for sums in (length, linked, selected, links):
            sums[e.parent] += sums[k]
        titled[e.parent] = titled[e.parent] or titled[k]
        piece[e.parent] = piece[e.parent] or piece[k]
    kinds = ("ul", "ol", "div", "section"), ("ul", "ol", "div", "table", "section", "p", "dl")  # in an article a paragraph or table may be all links
    menu = [((e.tag in kinds[not e.inside] and links[k] >= 3) or (e.listed and links[k] > 0)) and linked[k] > LINKED * length[k] for k, e in enumerate(elements)]
    tops = {k for k, e in enumerate(elements) if e.tag in ("article", "main") and selected[k] and not elements[e.parent].inside}
    gone: set[int] = set()
    if not tops or sum(selected[k] for k in tops) < DOMINANT * selected[0]:
        top, gone = container(elements, children, selected, titled, piece)
        tops = {top}
    # the containers' text, without what the paths' scores, marks or a share of links exclude
    shown = [False] * n
    for k, e in enumerate(elements):
        shown[k] = k in tops or (e.parent >= 0 and shown[e.parent] and not menu[k] and k not in gone)
    return " ".join("".join(("\n" if starts else "") + t for k, t, starts in kept if shown[k]).split())


def without_weak(elements: list[Element], texts: list[tuple[int, str, bool]]) -> list[tuple[int, str, bool]]:
    """Texts without those in boxes of an article that go by a common word. Where nothing but headings would be left of an
    article or main, its boxes stay: the word names what the article is about."""
    if not any(elements[k].weak for k, _, _ in texts):
        return texts
    article = [0] * len(elements)
    for k, e in enumerate(elements):
        if k:
            article[k] = article[e.parent] or (k if e.tag in ("article", "main") else 0)
    heading = [False] * len(elements)
    for k, e in enumerate(elements):
        heading[k] = e.tag in HEADINGS or (k > 0 and heading[e.parent])
    written = {article[k] for k, t, _ in texts if not elements[k].weak and not heading[k] and not t.isspace()}
    return [x for x in texts if not elements[x[0]].weak or article[x[0]] not in written]


def container(elements: list[Element], children: dict[int, list[int]], selected: list[int], titled: list[bool], piece: list[bool]) -> tuple[int, set[int]]:
    """The innermost element around the text on content paths, and the boxes in it that aren't the article's.

    From the page down: boxes of one path are of one kind if all or none of them hold elements with text. Kinds with little content text beside the others go. Where one
    box is left with all of it, and no title beside it, the search goes on in that box. Where it ends, boxes without
    content text go too, but for those with a heading or the short pieces that articles have.
    """
    at = 0
    gone: set[int] = set()
    while elements[at].tag not in ("article", "main"):
        own = children.get(at, [])
        kinds: dict[int, list[int]] = {}
        for k in own:
            kinds.setdefault(2 * elements[k].path + (k in children) if elements[k].tag in BOXES else -1, []).append(k)
        mass = {kind: sum(selected[k] for k in ks) for kind, ks in kinds.items()}
        mass[-1] = selected[at] - sum(v for kind, v in mass.items() if kind >= 0)  # with the element's own text
        most = max(mass.values())
        lesser = {k for kind, ks in kinds.items() if kind >= 0 for k in ks if not titled[k] and (mass[kind] < LESSER * most or not selected[k])}
        bare = {k for k in lesser if selected[k] or not piece[k]}
        left = [k for k in own if k not in lesser and selected[k]]
        one = len(left) == 1 and selected[left[0]] == selected[at] - sum(selected[k] for k in lesser)
        if not one or elements[left[0]].tag not in CONTAINERS | BOXES or any(titled[k] for k in own if k != left[0]):
            return at, gone | bare
        at = left[0]
    return at, gone


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (html, more) with text and n_chars (code points). Null or empty html: the empty text.

    Each page stands alone: no shuffle. Columns named text or n_chars, whatever the case, are replaced, html is dropped, others stay.
    """
    plain = pages.select(*(c for c in pages.columns if c.lower() not in ("text", "n_chars", "html")), "html")
    names = [*plain.columns[:-1], "text", "n_chars"]

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    return plain.mapInArrow(pull, f"{schema}text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``: page_id, url, text, n_chars."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.select("page_id", "url", F.col("html"))).select("page_id", "url", "text", "n_chars")

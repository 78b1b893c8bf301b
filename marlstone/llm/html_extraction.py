"""Main text of web pages by tag-path ratios.

A page is read as blocks: runs of text between block-level tags. Blocks are
grouped by their root-to-leaf tag path (block elements with their classes and
ids; inline elements do not open paths). Each path has two ratios, text length
and punctuation for each of its blocks; both are smoothed over neighbouring paths
in page order, fused by their product, and reduced by the path's share of link
text and by names on it that speak of something else (menus, adverts, comments).
Names are evidence like the others: they lower a score and decide nothing. Paths
above a share of the page's weighted mean are content.

Blocks of other paths are headings, captions, short paragraphs and lists, or what
surrounds an article. A block is taken with the largest element around it that
holds no content. Where content stands beside that element, in the same parent,
the element belongs to the article unless it bears such a name, or is mostly links
and does not stand between content, or a heading, and content;
where content only stands deeper, it belongs to it only as a heading that content
follows. Elements that are no article text by themselves (nav, footer, form, ...)
and what is not shown never take part. There is no rule for article or main.

Unclosed and misnested tags follow the usual rules: a paragraph ends where a
block starts, list items and table cells end where the next one starts. A page that
ends inside a tag ends before it; scripts and the like end at their end tags only, and
other elements that are skipped end with their parent, or at the next tag if nothing
closes them. The scan is linear in the page, whatever is left open.

Defined results: a null or empty page gives empty text, and so does one without
text; pages, attribute values and character references of any length are read
whole, references to no character give U+FFFD; repeated rows each keep a row, and
no row depends on another; an empty table gives no rows; page_id and url pass as
they are and other columns are not read, whatever their names. Nothing is
shuffled.
"""

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
from pyspark.sql import types as T

from marlstone.llm.common import load

#: Elements whose content is never text of the page.
RAW = "script style noscript template svg math iframe object embed applet audio video canvas map title select textarea button option datalist".split()
#: Those whose content is text up to their end tag, so that an end tag of something else ends nothing, and those that may close themselves.
TEXT_ONLY = "script style title textarea iframe noscript".split()
FOREIGN = "svg math".split()
#: Elements that are not part of an article.
ASIDE = "nav footer aside form menu dialog search fieldset".split()
BLOCKS = (
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset legend details summary address hr center menu dialog search hgroup"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
ROLES = "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split()
#: Words of classes and ids that speak of something else than an article.
NAMES = (
    "ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar header comment comments reply replies disqus respond discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login paywall pagination pager toolbar"
).split()
#: Words that say nothing by themselves; a class of names and of these is a name, one with any other word is not.
PLAIN = "area bar block body bottom box button buttons card cell col column container content group icons inner item items left link links list main area outer panel post posts right row section slot stories thread top unit widget wrap wrapper x".split()
#: What a path with such a name keeps of its score.
NAMED = 0.1
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}, "p": {"p"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_RAW_SET, _ASIDE_SET, _BLOCK_SET, _VOID_SET, _ROLE_SET, _NAME_SET, _PLAIN_SET = map(frozenset, (RAW, ASIDE, BLOCKS, VOID, ROLES, NAMES, PLAIN))
#: Attributes: quoted values hold anything but their quote, unquoted ones end at white space; a quote inside one is part of it.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARKS = frozenset(".,;:!?…。，、；：！？")
_ZEROS, _HUGE = re.compile(r"(&#[xX]?)0{7,}"), re.compile(r"&#(?:[1-9][0-9]{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?")
_ends: dict[str, re.Pattern] = {}

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are not shown where they are open inside a page.
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Elements that text of an article stands in; others are containers.
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption details summary address hgroup center".split())

SMOOTH = (0.25, 0.5, 0.25)
THRESHOLD = 0.35
#: Share of link text from which an element beside content is no part of it.
MOST_LINKED = 0.5


@dataclass
class Node:
    """An open or closed block element."""

    tag: str
    path: int  # equal for equal tag paths
    parent: int
    aside: bool
    named: bool


@dataclass
class Block:
    node: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return _SPACE.sub(" ", decoded("".join(self.parts))).strip()


def decoded(text: str) -> str:
    """Character references decoded; html.unescape() refuses numbers of thousands of digits."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"\g<1>0", text))
    return html.unescape(text)


def _attributes(said: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(said):
        out.setdefault(name.lower(), next(filter(None, values), ""))  # the first of two counts
    return out


def _aside(tag: str, attrs: dict[str, str], parent: str) -> bool:
    """True if the element itself is no article text, or is not shown."""
    if tag in _ASIDE_SET or tag == "header" and parent in ("", "html", "body"):
        return True
    return attrs.get("role", "").lower() in _ROLE_SET or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_UNSHOWN.search(attrs.get("style", "")))


def _named(attrs: dict[str, str]) -> bool:
    """True if a class or the id speaks of something else."""
    for token in (*attrs.get("class", "").split(), *attrs.get("id", "").split()):
        own = set(_WORDS.findall(_CAMEL.sub(" ", token).lower()))
        if own & _NAME_SET and own <= _NAME_SET | _PLAIN_SET:
            return True
    return False


def parse(page: str) -> tuple[list[Node], list[Block]]:
    nodes, blocks = [Node("", 0, -1, False, False)], []
    stack = [0]
    numbers: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    inline: list[str] = []  # open links; other inline elements need no record
    now: Block | None = None

    def say(text: str) -> None:
        nonlocal now
        if now is None:
            if not text.strip():
                return
            now = Block(stack[-1])
            blocks.append(now)
        now.parts.append(text)
        if inline:
            now.linked += len(text)

    def close(upto: int) -> None:
        nonlocal now
        opened.subtract(nodes[k].tag for k in stack[upto:])
        del stack[upto:]
        now = None

    ends: dict[str, re.Match | None] = {}

    def end_of(tag: str, at: int) -> int:
        """Where the content of an element that is skipped ends. A search that found something farther on, or nothing, is not made again."""
        if tag not in ends or ends[tag] is not None and ends[tag].start() < at:
            if tag not in _ends:
                _ends[tag] = re.compile(rf"</{tag}\b[^>]*>", re.I)
            ends[tag] = _ends[tag].search(page, at)
        end = ends[tag]
        if tag in TEXT_ONLY:
            return end.end() if end else len(page)
        if end is None:  # never closed: only the text that follows is its own
            k = page.find("<", at)
            return k if k >= 0 else len(page)
        up = nodes[stack[-1]].tag
        if up:  # it ends with its parent, too
            if f"/{up}" not in _ends:
                _ends[f"/{up}"] = re.compile(rf"<(/?){up}\b", re.I)
            open_ones = 0
            for m in _ends[f"/{up}"].finditer(page, at, end.start()):
                open_ones += -1 if m[1] else 1
                if open_ones < 0:
                    return m.start()
        return end.end()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        if page[at - 1] != ">":  # the page ends inside a tag
            break
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                inline.clear()
            elif tag in _BLOCK_SET:
                if not opened[tag]:
                    now = now if tag != "p" else None
                    continue
                k = len(stack) - 1
                while nodes[stack[k]].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in _RAW_SET:
            if tag not in _VOID_SET and not (tag in FOREIGN and m[3].endswith("/")):
                at = end_of(tag, at)
            continue
        if tag in ("br", "wbr"):
            if now is not None and tag == "br":
                now.parts.append("\n")
            continue
        if tag == "hr":
            now = None
        if tag == "a":
            inline[:] = ["a"]
            continue
        if tag not in _BLOCK_SET or tag in _VOID_SET:
            continue
        # a paragraph ends where a block starts; items end where the next one starts
        for k in range(len(stack) - 1 if opened["p"] else 0, 0, -1):
            if nodes[stack[k]].tag == "p":
                close(k)
                break
            if nodes[stack[k]].tag in ("article", "section", "div", "td", "th", "li", "body"):
                break
        if tag in _CLOSES and any(opened[x] for x in _CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                own = nodes[stack[k]].tag
                if own in _STOPS.get(tag, ()):
                    break
                if own in _CLOSES[tag]:
                    close(k)
                    break
        attrs = _attributes(m[3]) if m[3] else {}
        up = nodes[stack[-1]]
        label = tag + "".join(f".{x}" for x in attrs.get("class", "").split()) + (f"#{attrs['id']}" if attrs.get("id") else "")
        path = numbers.setdefault((up.path, label), len(numbers) + 1)
        nodes.append(Node(tag, path, stack[-1], up.aside or _aside(tag, attrs, up.tag), up.named or _named(attrs)))
        stack.append(len(nodes) - 1)
        opened[tag] += 1
        now = None
    return nodes, blocks


def content_paths(blocks: list[tuple[int, str, int, bool]]) -> set[int]:
    """Paths above the threshold, of (path, text, characters in links, named) of each block."""
    paths: dict[int, list[float]] = {}
    for path, text, linked, named in blocks:
        p = paths.setdefault(path, [0, 0, 0, 0, named])
        p[0] += len(text)
        p[1] += sum(c in _MARKS for c in text)
        p[2] += 1
        p[3] += min(linked, len(text))
    order = list(paths)
    ratio = [[paths[p][k] / paths[p][2] for p in order] for k in (0, 1)]
    pad = [[r[0], *r, r[-1]] for r in ratio] if order else [[], []]
    smooth = [[sum(w * r[i + k] for k, w in enumerate(SMOOTH)) for i in range(len(order))] for r in pad]
    fused = {p: math.sqrt(smooth[0][i] * (1 + smooth[1][i])) * (1 - paths[p][3] / max(paths[p][0], 1)) ** 2 * (NAMED if paths[p][4] else 1) for i, p in enumerate(order)}
    # the mean is that of the paths without such names, where there are any
    plain = [p for p in order if not paths[p][4]] or order
    whole = sum(paths[p][0] for p in plain)
    mean = sum(fused[p] * paths[p][0] for p in plain) / whole if whole else 0
    return {p for p in order if fused[p] >= THRESHOLD * mean}


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, blocks = parse(page)
    own = [(b.node, b.text(), b.linked) for b in blocks if not nodes[b.node].aside]
    own = [x for x in own if x[1]]
    chosen = content_paths([(nodes[k].path, t, linked, nodes[k].named) for k, t, linked in own])
    is_content = [nodes[k].path in chosen for k, *_ in own]
    n = len(nodes)
    holds, beside, length, links, only_headings = [False] * n, [False] * n, [0] * n, [0] * n, [True] * n
    first, last = [len(own)] * n, [-1] * n
    for at, ((k, t, linked), good) in enumerate(zip(own, is_content, strict=True)):
        holds[k] |= good
        length[k] += len(t)
        links[k] += min(linked, len(t))
        headed, up = nodes[k].tag in _HEADINGS, k
        only_headings[k] &= headed
        first[k], last[k] = min(first[k], at), max(last[k], at)
        if good:  # content stands in k, so whatever k's parent holds stands beside it; deeper text leaves its line to its block
            beside[k] = True
            while nodes[up].tag in _FLOW:
                up = nodes[up].parent
                beside[up] = True
    for k in range(n - 1, 0, -1):  # parents come before their children
        up = nodes[k].parent
        holds[up] |= holds[k]
        length[up] += length[k]
        links[up] += links[k]
        only_headings[up] &= only_headings[k]
        first[up], last[up] = min(first[up], first[k]), max(last[up], last[k])
    # the next block after each that is no heading, and the nearest element around it and a block before it
    out, next_content = [], [False] * (len(own) + 1)
    for at in range(len(own) - 1, -1, -1):
        headed = nodes[own[at][0]].tag in _HEADINGS
        next_content[at] = is_content[at] or headed and next_content[at + 1]
    for at, (k, t, _) in enumerate(own):
        good = is_content[at]
        if not good:
            top = k
            while top and not holds[nodes[top].parent]:
                top = nodes[top].parent
            around = nodes[top].parent if top else 0
            if holds[k]:  # bare text of an element that holds content
                good = beside[k]
            elif beside[around]:
                # links between a heading or content and content are a list of the article's
                before = first[top] - 1
                between = before >= first[around] and (is_content[before] or nodes[own[before][0]].tag in _HEADINGS) and last[top] < last[around] and next_content[last[top] + 1]
                good = (between or links[top] <= MOST_LINKED * length[top]) and not nodes[top].named
            else:
                good = only_headings[top] and not nodes[top].named and next_content[last[top] + 1]
        if good:
            out.append(t)
    return "\n\n".join(out)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars of each row of pages."""
    own = pages.select(*[F.col(c) for c in keep], F.col(html_col).alias("html"))
    names = [*keep, "text", "n_chars"]
    schema = own.drop("html").schema.add("text", T.StringType()).add("n_chars", T.LongType())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    return own.mapInArrow(of, schema)


def op1_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))

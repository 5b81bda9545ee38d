"""Main text of HTML pages by two-pass block rules."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stopwords import STOPWORDS

_START = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|[!?]|(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*))")
#: The rest of a tag. A quote counts after an equals sign only, and only if it is closed.
_STRICT = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SKIPPED = frozenset("script style title textarea noscript template svg math iframe object select button head canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption legend".split()
)
#: Elements that hold no article text by their tags.
BAD_TAGS = frozenset("nav footer aside menu dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar "
    "share sharing social related recommended newsletter subscribe subscription signup login modal popup overlay dialog widget pager pagination "
    "copyright disclaimer skip".split()
)
#: Names of what readers write.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
BAD_IN_PAGE = frozenset(["header"])
_SPLIT_NAME = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """A run of text between block boundaries."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    bad: bool = False  # below an element whose tag or role is not the article's
    main: bool = False
    heading: bool = False
    mark: int = -1  # the innermost element below which names speak against it
    text: str = ""
    label: str = ""
    density: float = 0.0


@dataclass
class Mark:
    """An element with a telling name: what it is in, and how strong the evidence is."""

    outer: int
    strong: bool
    comments: bool
    around_main: bool = False


def _named(value: str, in_main: bool) -> tuple[bool, bool, bool]:
    """``(telling, strong, comments)`` of a class or id.

    Outside the article any telling word is strong evidence, inside it only a class
    made of such words altogether.
    """
    telling = strong = comments = False
    for one in value.split():
        words = [x.lower() for x in _SPLIT_NAME.split(one) if x]
        bad = [w in BAD_NAMES or w in COMMENTS or (not in_main and w in BAD_IN_PAGE) for w in words]
        telling = telling or any(bad)
        strong = strong or (any(bad) and (not in_main or all(bad)))
        comments = comments or any(w in COMMENTS for w in words)
    return telling, strong or comments, comments


def _evidence(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool, tuple[bool, bool, bool]]:
    """``(bad, main, names)`` of an element by its tag and its class, id, role and style."""
    bad = tag in BAD_TAGS or (tag == "header" and not in_main)
    main = tag in ("article", "main")
    names = (tag == "form", tag == "form", False)  # a form may be the whole page's
    if attrs and tag not in ("html", "body"):
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                names = tuple(x or y for x, y in zip(names, _named(value, in_main)))
            elif name == "role":
                bad, main = bad or value.lower() in BAD_ROLES, main or value.lower() in ("main", "article")
            elif name == "itemprop":
                main = main or value.lower() == "articlebody"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                bad = True
            elif name == "style":
                bad = bad or "display:none" in value.replace(" ", "").lower()
    return bad, main, (False, False, False) if main else names


def blocks_of(html: str) -> tuple[list[Block], list[Mark]]:
    """The blocks of a page, in order, and its elements with telling names.

    Unclosed and stray tags are tolerated. Takes time in proportion to the page.
    """
    out: list[Block] = []
    marks: list[Mark] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, below bad, below main, innermost mark
    open_tags: Counter = Counter()
    now = Block()
    at, links = 0, 0

    def add(raw: str) -> None:
        if raw:
            text = unescape(raw)
            now.parts.append(text)
            if links:
                now.linked += len(text.strip())

    def end() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                out.append(now)
        _, bad, main, mark = stack[-1] if stack else ("", False, False, -1)
        now = Block(bad=bad, main=main, mark=mark, heading=bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"))

    def pop() -> tuple:
        nonlocal links
        top = stack.pop()
        open_tags[top[0]] -= 1
        links -= top[0] == "a"
        return top

    size, pos, last, strict = len(html), 0, html.rfind(">"), True
    ends: dict[str, int] = {}  # of tags whose content is skipped: where no further end tag is
    while (m := _START.search(html, pos)) and (m.start() < last or not m["tag"]):
        add(html[at : m.start()])
        if m["comment"] or m["cdata"]:
            stop = "-->" if m["comment"] else "]]>"
            found = html.find(stop, m.end())
            at = pos = found + 3 if found >= 0 else size
            continue
        if not m["tag"]:
            found = html.find(">", m.end())
            at = pos = found + 1 if found >= 0 else size
            continue
        whole = _STRICT.match(html, m.end()) if strict else None
        if whole is None:  # from here to its end the page closes no tag outside quotes
            strict = False
        stop = whole.end() if whole else html.find(">", m.end()) + 1
        attrs, at, pos = html[m.end() : stop - 1], stop, stop
        tag = m["tag"].lower()
        if m["close"]:
            if open_tags[tag] > 0:
                odd, top = now.bad or now.mark >= 0, None
                while top is None or top[0] != tag:
                    top = pop()
                below = stack[-1] if stack else ("", False, False, -1)
                if odd and tag not in BLOCKS and (top[1], top[3]) != (below[1], below[3]):
                    end()
            if tag in BLOCKS:
                end()
            elif tag in ("td", "th"):
                now.parts.append(" ")
            continue
        if tag in SKIPPED:
            if not attrs.rstrip().endswith("/"):
                if tag == "head":  # a head may lack its end tag
                    close = re.compile(r"</head\s*>|(?=<body[\s>])|(?=<(?:article|main|p|div)[\s>])", re.I).search(html, pos)
                else:
                    close = None if pos >= ends.get(tag, size + 1) else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
                    if not close:
                        ends[tag] = pos
                at = pos = close.end() if close else size
            if tag not in ("svg", "math"):
                now.parts.append(" ")
            continue
        if tag == "br" or tag in ("td", "th"):
            now.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                end()
            continue
        if tag in BLOCKS:
            while stack and (stack[-1][0] == "p" or (stack[-1][0] not in BLOCKS and stack[-1][0] not in ("td", "th") and open_tags["p"] > 0)):
                pop()
            for group in (("li",), ("dd", "dt"), ("tr",)):
                if tag in group and stack and stack[-1][0] in group:
                    pop()
        _, bad, main, mark = stack[-1] if stack else ("", False, False, -1)
        own_bad, own_main, (telling, strong, comments) = _evidence(tag, attrs, main)
        if own_main:
            outer = mark
            while outer >= 0 and not marks[outer].around_main:
                marks[outer].around_main = True
                outer = marks[outer].outer
        if telling:
            marks.append(Mark(mark, strong, comments))
            mark = len(marks) - 1
        stack.append((tag, bad or own_bad, main or own_main, mark))
        open_tags[tag] += 1
        links += tag == "a"
        if tag in BLOCKS or own_bad or telling:
            end()
    add(html[at : m.start() if m else size])  # a tag that the page's end cuts off is no text
    end()
    return out, marks


def _against(blocks: list[Block], marks: list[Mark], dense: list[bool]) -> list[int]:
    """What names say of each mark's blocks: 2 against them, 1 that nothing speaks for them, 0 nothing.

    An element that holds the article, or half of the page's dense text, is judged
    like any other whatever its names; one of readers' comments only if there is no
    dense text but in it.
    """
    held = [0] * len(marks)
    total = 0
    for b, d in zip(blocks, dense):
        if d and not b.bad:
            total += len(b.text)
            if b.mark >= 0:
                held[b.mark] += len(b.text)
    for k in range(len(marks) - 1, -1, -1):  # inner ones come later
        if marks[k].outer >= 0:
            held[marks[k].outer] += held[k]
    says = []
    for k, m in enumerate(marks):
        bulk = held[k] >= total if m.comments else 2 * held[k] >= total
        own = 0 if m.around_main or (total and bulk) else 2 if m.strong else 1
        says.append(max(own, says[m.outer] if m.outer >= 0 else 0))
    return says


def classify(blocks: list[Block], marks: list[Mark], short: int = 70, low: float = 0.20, high: float = 0.32, links: float = 0.4) -> list[Block]:
    """Labels each block ``good`` or ``bad``.

    First pass: blocks that are mostly links are bad. Length and stop-word density
    make other ones good, bad, or near good between; short ones stay open. Evidence
    shifts the thresholds: in the article element no density is too low, outside it
    none is enough if the article holds text, nor in what by its tag, role or names is
    a menu, notice, form, comment or the like (names: see :func:`_against`).

    Second pass: an open block takes the label of its nearest decided neighbours in
    its region, the article or the rest: good if they agree on it, and near good ones
    and those in the article if either is; at an end of the region the missing
    neighbour agrees, unless the block holds links.
    """
    for b in blocks:
        words = _WORD.findall(b.text.lower())
        b.density = sum(w in STOPWORDS for w in words) / len(words) if words else 0.0
    linked = [b.linked / max(1, len(b.text)) for b in blocks]
    dense = [len(b.text) >= short and b.density >= low and x <= links for b, x in zip(blocks, linked)]
    says = _against(blocks, marks, dense)
    against = [2 if b.bad else says[b.mark] if b.mark >= 0 else 0 for b in blocks]
    article = any(b.main and a < 2 for b, a in zip(blocks, against))
    region = [b.main for b in blocks]
    for b, x, a in zip(blocks, linked, against):
        inside = b.main and not a
        shift = -1.0 if inside else 1.0 if a == 2 or (article and not b.main) else 0.0
        if x > links and not ((b.heading or b.density >= low) and shift <= 0 and (b.heading or b.main)):
            b.label = "bad"
        elif shift > 0:
            b.label = "out"
        elif len(b.text) < short or (b.heading and not inside):
            b.label = "near" if inside else "short"
        elif b.density >= high + shift or (b.density >= low + shift and len(b.text) > 3 * short):
            b.label = "good"
        else:
            b.label = "near" if b.density >= low / 2 else "bad"
    decided = ("good", "bad")

    def nearest(order: range) -> list[str | None]:
        seen: dict[bool, str] = {}
        out: list[str | None] = [None] * len(blocks)
        for i in order:
            out[i] = seen.get(region[i])
            if blocks[i].label in decided:
                seen[region[i]] = blocks[i].label
        return out

    left, right = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    labels = []
    for i, b in enumerate(blocks):
        label = b.label
        if label in ("short", "near"):
            near = [x for x in (left[i], right[i]) if x]
            if b.heading and right[i] == "good":
                label = "good"
            elif not near:
                label = "good"  # nothing in its region says otherwise
            else:
                near += ["bad"] * (b.linked > 0 and len(near) < 2 and not b.main)  # links at an end of the page
                label = "good" if ("good" in near if label == "near" else set(near) == {"good"}) else "bad"
        labels.append("bad" if label == "out" else label)
    for b, label in zip(blocks, labels):
        b.label = label
    return blocks


def main_text(html: str | None) -> str:
    """Good blocks joined by two line feeds."""
    return "\n\n".join(b.text for b in classify(*blocks_of(html or "")) if b.label == "good")


def extract_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, url, text, n_chars`` of every row of ``pages(id, url, html)``.

    The whole html is read. Null or empty html, and pages without article text,
    give an empty text. Ids and urls may be null or repeat; other columns are left
    out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    [id_col, "url", "text", "n_chars"],
                )

    return pages.select(F.col(id_col).cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, f"{id_col} long, url string, text string, n_chars long"
    )

"""Main-text extraction by line-block distribution.

A page becomes lines: the text between two block-level tags, character
references decoded and white space made single.  A line's weight is its text
length outside links.  Lines in menus, headers, footers, sidebars, notices,
adverts, forms and comments take no part.  Weights are summed over sliding
windows of BLOCK lines; text starts where the sum surges and ends where it dives
to nothing.

* The block that holds the heaviest stretch is the article: all of it is kept
  from its first line with weight to its last.  Stretches elsewhere are kept by
  their share of the heaviest.
* Where a page marks articles, the tag is a hint that the windows confirm: where
  no window in a marked element surges but one beside them does (teasers in
  ``article``, the text in a plain block), the rule above holds for the rest.  Else every marked
  element that has text outside links is kept, articles whole; in a ``main``
  element, what stands beside its articles is kept too, but for runs of BLOCK lines
  or more that are links for the most part.
* Class and id names exclude an element when all their parts say so
  (``cookie-notice``, not ``social-science``).  Names that an article may use
  itself (``alert``, ``related``) exclude nothing inside a marked article but
  what is links for the most part.  A form that
  encloses most of the page's text, or an element with such a name that encloses
  nearly all of it, is no more than a wrapper.

The page is scanned once, from left to right, whatever its markup.

Defined cases: null or empty html gives the empty text; an unfinished tag or
comment at the end is dropped; an attribute's quote that never closes ends with
its tag; unclosed elements end with their parent; end tags of nothing are
ignored; repeated rows are rows of their own; empty table: empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veltrial.llm.common import table

#: Lines of a window, and the weight of a window that is a surge.
BLOCK, SURGE = 3, 80
#: Least share of the heaviest stretch that a stretch outside its block must weigh (pages without a marked article).
STRETCH = 0.2
#: Share of the page's text above which an element with an excluding class is its wrapper.
WRAPPER = 0.95

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: A tag without attributes, or with none but plain quoted ones: no other tag can lie in it.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s+[a-zA-Z-]+=(?:"[^"<>]*"|'[^'<>]*'))*\s*/?)>""")
_STOP = re.compile(r"[>=]")
_VALUE = re.compile(r"[^\s>]*")
_SPACES = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\bhidden\b""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element and attribute names.
BLOCKS = set("address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu meta nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul video audio canvas svg".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title".split())
_CLOSE = {name: re.compile("</" + name, re.I | re.A) for name in RAW}
EXCLUDED = set("nav header footer aside button select option dialog menu iframe object svg canvas audio video fieldset legend input label head search".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
MARKED = {"article", "main"}
#: Elements that group others; the block that holds a paragraph, list or table is one of these.
GROUPS = set("html body div section article main center form td".split())
#: Parts of class names of what isn't text; of what may be; and what may stand beside them.
NAMES = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login share sharing comment comments commentlist disqus respond pagination pager".split())
WEAK_NAMES = set("banner header overlay social related recommended recommendations widget toolbar copyright disclaimer alert toc reply replies".split())
BESIDE = set("box block bar bars container wrapper wrap section list area inner outer top bottom left right main site page global primary secondary mobile desktop posts post articles stories links link items item button buttons form icons icon unit slot frame group row panel user reader the".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A paragraph, cell or list item ends where another of its kind begins, or a block around it.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, is an end tag, attributes) of all markup; comments,
    declarations and raw elements have no name.  What never ends ends the page."""
    at, size = 0, len(page)
    never = {'"': False, "'": False}  # quotes that don't occur any more
    while True:
        a = page.find("<", at)
        if a < 0 or a + 1 >= size:
            return
        m = _PLAIN.match(page, a)
        if m:
            slash, name, attributes = m.groups()
            name = name.lower()
            if name not in RAW:
                at = m.end()
                yield a, at, name, slash == "/", attributes
                continue
        c = page[a + 1]
        if c == "!" or c == "?":
            if page.startswith("<!--", a):
                e = page.find("-->", a + 2)
                e = size if e < 0 else e + 3
            else:
                e = page.find(">", a)
                e = size if e < 0 else e + 1
            yield a, e, "", False, ""
            at = e
            continue
        end = c == "/"
        m = _NAME.match(page, a + 1 + end)
        if not m:
            if end:  # no element's: up to its end
                e = page.find(">", a)
                e = size if e < 0 else e + 1
                yield a, e, "", False, ""
                at = e
            else:
                at = a + 1
            continue
        p = m.end()
        while True:
            stop = _STOP.search(page, p)
            if not stop:
                e = size
                break
            if stop[0] == ">":
                e = stop.end()
                break
            p = _SPACES.match(page, stop.end()).end()
            quote = page[p : p + 1]
            if quote in never and not never[quote]:
                close = page.find(quote, p + 1)
                if close < 0:
                    never[quote] = True
                else:
                    p = close + 1
                    continue
            p = _VALUE.match(page, p).end()
        name = m[0].lower()
        if e == size and page[-1] != ">":
            yield a, size, "", False, ""
            return
        if name in RAW and not end:
            p = e
            while True:  # the element's own end tag
                close = _CLOSE[name].search(page, p)
                if not close or close.end() >= size:
                    e = size
                    break
                p = close.end()
                if page[p] in " \t\n\r\f/>":
                    e = page.find(">", p)
                    e = size if e < 0 else e + 1
                    break
            yield a, e, "", False, ""
        else:
            yield a, e, name, end, page[m.end() : e - 1]
        at = e


class Node:
    """An open or closed block, numbered as it opens; ``last`` is the number of the last block inside."""

    __slots__ = ("name", "parent", "depth", "groups", "number", "last")

    def __init__(self, name: str, parent: Node | None, number: int):
        self.name, self.parent, self.number, self.last = name, parent, number, number
        self.depth = parent.depth + 1 if parent else 0
        self.groups = (parent.groups if parent else 0) + (name in GROUPS)


class Line:
    __slots__ = ("text", "weight", "mark", "article", "hard", "soft", "form", "node")

    def __init__(self, text: str, weight: int, mark: int, article: bool, hard: bool, soft: int, form: int, node: Node):
        self.text, self.weight, self.mark, self.article, self.hard, self.soft, self.form, self.node = text, weight, mark, article, hard, soft, form, node


def _by_name(value: str) -> int:
    """2: a class or id name says that an element isn't text, 1: that it may not be, 0: neither."""
    best = 0
    for name in value.split():
        parts = [t.lower() for t in _TOKEN.findall(name)]
        if any(p in NAMES or p in WEAK_NAMES for p in parts) and all(p in NAMES or p in WEAK_NAMES or p in BESIDE for p in parts):
            best = max(best, 2 if any(p in NAMES for p in parts) else 1)
    return best


def _soft(name: str, attributes: str) -> int:
    """The same by an element's class, id, role and style."""
    if not attributes or name in ("main", "html", "body"):
        return 0
    best = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key = (m[1] or "").lower()
        value = m[2] or m[3] or m[4] or ""
        if not m[1]:
            if m[0].lower() == "hidden":
                return 2
        elif key in ("class", "id"):
            best = max(best, _by_name(value))
        elif key == "role":
            if value.strip().lower() in ROLES:
                best = max(best, 1 if value.strip().lower() in ("alert", "form") else 2)
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        elif key == "aria-hidden" and value.strip().lower() == "true":
            return 2
    return best


def lines_of(page: str) -> tuple[list[Line], list[tuple[int, int]]]:
    """Lines, and (strength, enclosing one) of the elements whose attributes exclude them."""
    out: list[Line] = []
    stack: list[tuple[str, int, int, Node | None]] = []  # name, excluded by name, number of its soft element or -1, block
    opened: Counter[str] = Counter()
    node = Node("", None, 0)
    softs: list[tuple[int, int]] = []
    text: list[str] = []
    number = links = hard = weight = marks = mark = forms = 0
    soft = -1

    def end_line() -> None:
        nonlocal weight
        if text:
            line = " ".join(html_lib.unescape("".join(text)).split())
            if line:
                out.append(Line(line, weight, mark, opened["article"] > 0, hard > 0, soft, forms if opened["form"] else 0, node))
            text.clear()
        weight = 0

    def pop() -> None:
        nonlocal links, hard, soft, node, mark
        name, h, s, block = stack.pop()
        opened[name] -= 1
        hard -= h
        links -= name == "a"
        if s >= 0:
            soft = softs[s][1]
        if block:
            block.last = number
            node = block.parent
        if name in MARKED and not opened["article"] and not opened["main"]:
            mark = 0

    at = 0
    for start, end, name, closing, attributes in tags(page):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if not links:
                weight += len(piece.strip())
        at = end
        if not name:
            continue
        if name in BLOCKS:
            end_line()
        if closing:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID or (attributes.rstrip().endswith("/") and name not in BLOCKS):
            continue
        closes = CLOSES.get(name)
        if closes and stack and stack[-1][0] in closes:
            pop()
        elif name in BLOCKS and stack and stack[-1][0] == "p" and name != "p":
            pop()
        h = int(name in EXCLUDED)
        if name in HEADINGS and mark and hard == 1 and opened["header"]:
            h = -1  # an article's own heading, inside the article's header
        s, strength = -1, _soft(name, attributes)
        if strength:
            softs.append((strength, soft))
            s = soft = len(softs) - 1
        block = None
        if name in BLOCKS:
            number += 1
            block = node = Node(name, node, number)
        if name in MARKED and not mark:
            marks += 1
            mark = marks
        if name == "form" and not opened["form"]:
            forms += 1
        stack.append((name, h, s, block))
        opened[name] += 1
        hard += h
        links += name == "a"
    if at < len(page):
        text.append(page[at:])
        if not links:
            weight += len(page[at:].strip())
    end_line()
    while stack:
        pop()
    return out, softs


def taking_part(lines: list[Line], softs: list[tuple[int, int]]) -> list[Line]:
    """Lines that aren't excluded by name, form or attribute."""
    lines = [x for x in lines if not x.hard]
    total = sum(x.weight for x in lines)
    form: Counter[int] = Counter()
    own, links, marked = [0] * len(softs), [0] * len(softs), [True] * len(softs)
    for x in lines:
        if x.form:
            form[x.form] += x.weight
        if x.soft >= 0:
            own[x.soft] += x.weight
            links[x.soft] += len(x.text) - x.weight
            marked[x.soft] = marked[x.soft] and x.mark > 0
    for k in range(len(softs) - 1, -1, -1):  # an element comes after the one around it
        up = softs[k][1]
        if up >= 0:
            own[up] += own[k]
            links[up] += links[k]
            marked[up] = marked[up] and marked[k]
    gone = [False] * len(softs)
    for k, (strength, up) in enumerate(softs):
        wrapper = own[k] > WRAPPER * total
        article = strength == 1 and marked[k] and links[k] <= own[k]
        gone[k] = (up >= 0 and gone[up]) or not (wrapper or article)
    return [x for x in lines if not (x.form and 2 * form[x.form] <= total) and not (x.soft >= 0 and gone[x.soft])]


def article_lines(lines: list[Line], weights: list[int], a: int, b: int) -> list[int]:
    """The lines of the block that holds lines a..b, from its first line with weight to its last."""
    nodes = [x.node for x, w in zip(lines[a:b], weights[a:b], strict=True) if w]
    block = nodes[0].parent or nodes[0] if len(nodes) == 1 else nodes[0]
    least, most = min(n.number for n in nodes), max(n.number for n in nodes)
    while block.parent and not (block.number <= least and most <= block.last):
        block = block.parent
    while block.parent and block.name not in GROUPS:
        block = block.parent
    inside = [i for i, x in enumerate(lines) if block.number <= x.node.number <= block.last or not block.parent]
    if block.name in ("", "html", "body"):  # the page itself: what stands in it directly
        inside = [i for i in inside if lines[i].node.depth <= block.depth + 1 or lines[i].node.groups == block.groups]
    return _trimmed(inside, weights)


def _trimmed(inside: list[int], weights: list[int]) -> list[int]:
    heavy = [i for i in inside if weights[i]]
    return [i for i in inside if heavy and heavy[0] <= i <= heavy[-1]]


def stretches(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """Ranges of lines between a surge of the window sums and the next dive."""
    n = len(weights)
    sums = [sum(weights[i : i + BLOCK]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if sums[i] >= surge and weights[i]:
            j = i
            while j < n and sums[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def _marked_lines(lines: list[Line]) -> list[int] | None:
    """Of pages that mark articles; None where the windows find the text elsewhere."""
    light = [2 * x.weight < len(x.text) for x in lines]
    weights = [0 if a else x.weight for a, x in zip(light, lines, strict=True)]
    blocks: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        blocks.setdefault(x.mark, []).append(i)
    surges = lambda own: bool(stretches([weights[i] for i in own], SURGE))
    beside = blocks.pop(0, [])
    if surges(beside) and not any(map(surges, blocks.values())):
        return None
    kept: list[tuple[bool, list[int]]] = []
    for own in blocks.values():
        size = [len(lines[i].text) for i in own]
        k = 0
        while k < len(own):  # runs of links outside articles have no weight
            j = k
            while j < len(own) and light[own[j]] and not lines[own[j]].article:
                j += 1
            if j - k >= BLOCK:
                size[k:j] = [0] * (j - k)
            k = max(j, k + 1)
        if not any(size):
            size = [len(lines[i].text) for i in own]
        chosen = [own[i] for i in _trimmed(list(range(len(own))), size)]
        if any(lines[i].article for i in own):  # a menu between a heading and its article goes too
            chosen = [i for i, w in zip(own, size, strict=True) if w]
        kept.append((any(weights[i] for i in own), chosen))
    text = any(t for t, _ in kept)
    return sorted(i for t, own in kept if t or not text for i in own)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines, softs = lines_of(page)
    rest = taking_part(lines, softs)
    marked = _marked_lines(rest) if any(x.mark for x in rest) else None
    if marked is not None:
        return " ".join(rest[i].text for i in marked)
    rest = [x for x in rest if not x.mark]
    weights = [x.weight if 2 * x.weight >= len(x.text) else 0 for x in rest]
    kept = stretches(weights, SURGE) or stretches(weights, max([1, *(sum(weights[i : i + BLOCK]) for i in range(len(weights)))]))
    if not kept:
        return ""
    size = [sum(weights[a:b]) for a, b in kept]
    chosen = {i for (a, b), s in zip(kept, size, strict=True) if s >= STRETCH * max(size) for i in range(a, b)}
    chosen.update(article_lines(rest, weights, *kept[size.index(max(size))]))
    return " ".join(rest[i].text for i in sorted(chosen))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))

"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into a flat list of text blocks. A block's features are its
number of words and its link density, the same two of its neighbours, and three marks of where it
stands: within a part that pages use for other things than their text (menus, footers, asides,
forms, or a class or id that says so), within an article or main part, and in a page that has one.
What holds the page's text is no such part: a form around an article or most of the words, or an
element that has such a class or id and all articles.
The tree is grown, when it is first needed in a process, from the labelled blocks in TABLE.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of HTML elements. Those that aren't blocks stand within a line of text.
UNSHOWN = frozenset("head template select".split())
UNPARSED = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body main article section nav aside header footer address hgroup search h1 h2 h3 h4 h5 h6 p div blockquote pre hr center figure figcaption details summary dialog ul ol li dl dt dd menu dir"
    " table caption thead tbody tfoot tr td th form fieldset legend button select option optgroup textarea noscript template iframe title".split()
)
OTHER = frozenset("nav aside footer form menu dialog button fieldset".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Class names and ids that mark other parts of a page, as words between ``-`` and ``_``.
OTHER_NAMES = re.compile(
    r"(?:^|[_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|comment\w*|respond|replies|disqus\w*|side-?bar\w*|menu\w*|nav|navbar|navigation|breadcrumb\w*"
    r"|footer|foot|masthead|topbar|cookie\w*|consent\w*|notice\w*|alert\w*|popup\w*|modal\w*|overlay\w*|newsletter\w*|subscri\w*|sign-?up|login|share|sharing|social\w*"
    r"|related\w*|recommend\w*|widget\w*|pagination|pager|search\w*|toolbar|skip\w*|legal|copyright|disclaimer|gdpr|paywall)(?=$|[_-])"
    r"|^(?:(?:site|main|top|global|page|blog|web)[_-])?header(?=$|[_-])|^(?:(?:contact|feedback|e-?mail|order|checkout|registration)[_-])?form$"
)
#: Such names say how a page is laid out or what state it is in.
LAYOUT_NAMES = re.compile(r"(?:^|[_-])(?:has|no|not|non|with|without|hide|hides|show|shows|layout|template|open|opened|closed|enabled|disabled|active|inactive|allowed|free|less)(?=$|[_-])")
#: An id is often made from a heading, so it marks another part only if all its words are such names
#: or say where a part stands; within an article only what holds comments is known by its id.
PLACES = frozenset("site main top bottom left right upper lower page global primary secondary inner outer box bar block list container wrapper wrap area links section div region module".split())
COMMENTS = re.compile(r"comments?|comments?[_-](?:list|area|section|wrapper|container)|commentlist|respond|replies|disqus_thread")
#: Elements whose text is a page's own, whatever they are called.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a page's text, whatever their classes say.
WHOLE = frozenset("html body main article".split())
_OPENING = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")

#: Pages of labelled blocks: (words, words in links, in another part, in an article, is main text).
TABLE: list[list[tuple[int, int, int, int, int]]] = [
    # an article between menus, adverts and a footer; short and long paragraphs
    [(6, 6, 1, 0, 0), (12, 0, 1, 0, 0), (8, 0, 0, 1, 1), (60, 2, 0, 1, 1), (1, 0, 0, 1, 1), (110, 0, 0, 1, 1), (3, 0, 0, 1, 1), (14, 1, 1, 0, 0)],
    [(4, 4, 1, 0, 0), (9, 0, 0, 1, 1), (1, 0, 0, 1, 1), (2, 0, 0, 1, 1), (40, 0, 0, 1, 1), (25, 3, 1, 1, 0), (12, 12, 1, 1, 0), (10, 0, 1, 0, 0)],
    [(2, 2, 1, 0, 0), (30, 0, 1, 0, 0), (5, 0, 0, 1, 1), (300, 9, 0, 1, 1), (7, 7, 0, 1, 1), (80, 0, 1, 0, 0), (45, 0, 1, 0, 0), (6, 2, 1, 0, 0)],
    [(1, 0, 0, 1, 1), (1, 1, 0, 1, 1), (500, 0, 0, 1, 1), (20, 0, 0, 0, 0), (15, 15, 0, 0, 0), (4, 0, 0, 0, 0)],
    [(35, 0, 0, 0, 0), (6, 0, 0, 1, 1), (50, 1, 0, 1, 1), (50, 0, 1, 1, 0), (70, 0, 0, 0, 0)],
    [(400, 0, 0, 1, 1), (2, 0, 0, 1, 1), (900, 0, 0, 1, 1), (1, 0, 0, 1, 1), (1200, 0, 0, 1, 1), (30, 0, 1, 0, 0)],
    [(4, 4, 1, 0, 0), (3, 0, 0, 1, 1), (450, 0, 0, 1, 1), (5, 5, 0, 1, 1), (10, 0, 0, 1, 1), (400, 0, 0, 1, 1), (600, 10, 0, 1, 1), (20, 1, 0, 1, 1), (8, 0, 1, 0, 0)],
    [(50, 0, 1, 0, 0), (500, 0, 0, 1, 1), (500, 0, 0, 1, 1), (10, 0, 1, 0, 0)],
    [(300, 0, 1, 1, 0), (30, 0, 0, 1, 1), (300, 0, 1, 0, 0), (700, 0, 0, 1, 1), (15, 0, 0, 1, 1), (2, 2, 0, 1, 1), (800, 0, 0, 1, 1), (600, 0, 1, 1, 0)],
    [(20, 0, 0, 0, 0), (400, 0, 0, 1, 1), (25, 0, 0, 1, 1), (30, 0, 0, 0, 0), (200, 0, 0, 0, 0), (350, 0, 0, 0, 0)],
    [(8, 0, 0, 1, 1), (8, 0, 0, 1, 1), (8, 0, 0, 1, 1), (9, 9, 0, 1, 1), (12, 0, 0, 1, 1), (6, 0, 1, 0, 0), (6, 0, 0, 0, 0)],
    # pages that end within their text
    [(5, 5, 1, 0, 0), (30, 0, 0, 1, 1), (4, 0, 0, 1, 1)],
    [(12, 0, 0, 1, 1)],
    [(7, 0, 1, 0, 0), (1, 0, 0, 1, 1), (260, 0, 0, 1, 1)],
    [(8, 0, 0, 1, 1), (120, 0, 0, 1, 1), (90, 0, 0, 1, 1)],
    [(6, 6, 1, 0, 0), (60, 0, 0, 1, 1), (25, 0, 0, 1, 1)],
    [(6, 6, 1, 0, 0), (35, 0, 0, 1, 1), (9, 0, 0, 1, 1)],
    [(4, 4, 1, 0, 0), (11, 0, 0, 1, 1), (16, 0, 0, 1, 1), (7, 0, 0, 1, 1)],
    [(15, 0, 1, 0, 0), (500, 0, 0, 1, 1), (700, 0, 0, 1, 1)],
    [(40, 0, 0, 0, 1)],
    [(4, 0, 0, 0, 1), (60, 0, 0, 0, 1), (45, 0, 0, 0, 1)],
    [(2, 2, 0, 0, 0), (20, 0, 0, 0, 1), (30, 0, 0, 0, 1), (90, 0, 0, 0, 1)],
    [(3, 3, 0, 0, 0), (70, 0, 0, 0, 1), (5, 0, 0, 0, 1)],
    # pages without an article: length and links of a block and its neighbours decide
    [(3, 3, 0, 0, 0), (2, 2, 0, 0, 0), (4, 4, 0, 0, 0), (7, 0, 0, 0, 1), (65, 1, 0, 0, 1), (80, 3, 0, 0, 1), (5, 0, 0, 0, 1), (40, 0, 0, 0, 1), (9, 8, 0, 0, 0), (3, 3, 0, 0, 0)],
    [(1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (120, 0, 0, 0, 1), (12, 0, 0, 0, 1), (95, 5, 0, 0, 1), (2, 2, 0, 0, 0), (6, 5, 0, 0, 0)],
    [(6, 6, 1, 0, 0), (25, 0, 0, 0, 1), (30, 0, 0, 0, 1), (8, 0, 1, 0, 0), (20, 20, 0, 0, 0), (25, 22, 0, 0, 0)],
    [(5, 0, 0, 0, 1), (45, 2, 0, 0, 1), (18, 0, 0, 0, 1), (22, 0, 1, 0, 0), (10, 9, 0, 0, 0), (4, 4, 0, 0, 0), (2, 2, 0, 0, 0)],
    [(2, 2, 0, 0, 0), (3, 1, 0, 0, 0), (2, 1, 0, 0, 0), (200, 10, 0, 0, 1), (150, 2, 0, 0, 1), (3, 0, 1, 0, 0), (60, 50, 0, 0, 0)],
    [(9, 0, 0, 0, 1), (14, 0, 0, 0, 1), (16, 1, 0, 0, 1), (3, 3, 0, 0, 0)],
    [(2, 2, 0, 0, 0), (400, 0, 0, 0, 1), (3, 0, 0, 0, 1), (500, 4, 0, 0, 1), (20, 0, 0, 0, 1), (600, 0, 0, 0, 1), (4, 0, 0, 0, 1), (4, 4, 0, 0, 0)],
    [(90, 0, 1, 0, 0), (300, 0, 0, 0, 1), (2, 0, 0, 0, 1), (250, 0, 0, 0, 1), (200, 0, 1, 0, 0), (5, 0, 1, 0, 0), (30, 29, 0, 0, 0)],
    # lists of links within an article that carry no mark, among text that does hold links
    [(6, 6, 1, 0, 0), (7, 0, 0, 1, 1), (2, 2, 0, 1, 0), (3, 3, 0, 1, 0), (2, 2, 0, 1, 0), (80, 2, 0, 1, 1), (120, 30, 0, 1, 1), (4, 4, 0, 1, 0), (5, 5, 0, 1, 0), (3, 3, 0, 1, 0), (10, 0, 1, 0, 0)],
    [(9, 0, 0, 1, 1), (60, 1, 0, 1, 1), (5, 5, 0, 1, 1), (70, 0, 0, 1, 1), (1, 0, 0, 1, 1), (90, 40, 0, 1, 1), (3, 3, 0, 1, 0), (4, 4, 0, 1, 0), (6, 6, 0, 1, 0), (2, 2, 0, 1, 0)],
    [(1, 1, 0, 1, 0), (1, 1, 0, 1, 0), (1, 1, 0, 1, 0), (6, 0, 0, 1, 1), (50, 0, 0, 1, 1), (2, 1, 0, 1, 1), (40, 12, 0, 1, 1), (8, 8, 0, 1, 1), (30, 0, 0, 1, 1)],
    # pages without an article whose text stands between lists of links and short lines
    [(1, 1, 0, 0, 0), (2, 2, 0, 0, 0), (1, 1, 0, 0, 0), (6, 0, 0, 0, 1), (40, 3, 0, 0, 1), (3, 0, 0, 0, 1), (55, 0, 0, 0, 1), (4, 4, 0, 0, 0), (7, 7, 0, 0, 0), (5, 5, 0, 0, 0)],
    [(4, 4, 0, 0, 0), (3, 3, 0, 0, 0), (28, 10, 0, 0, 1), (33, 2, 0, 0, 1), (21, 4, 0, 0, 1), (6, 6, 0, 0, 0), (9, 9, 0, 0, 0), (3, 2, 0, 0, 0)],
    # pages within a form, or with classes that tell their layout
    [(2, 2, 1, 0, 0), (4, 0, 0, 1, 1), (30, 0, 0, 1, 1), (45, 0, 0, 1, 1), (6, 0, 1, 0, 0)],
    [(2, 2, 1, 0, 0), (4, 0, 0, 0, 1), (45, 0, 0, 0, 1), (60, 0, 0, 0, 1), (3, 0, 1, 0, 0)],
]


#: What a block stands within.
OUTSIDE, MAIN, ARTICLE = range(3)


class Block:
    __slots__ = ("words", "linked", "other", "inside", "text")

    def __init__(self, text: str, linked: int, other: bool, inside: bool):
        self.text, self.linked, self.other, self.inside = text, linked, other, inside
        self.words = text.count(" ") + 1


def table_features(blocks: list[tuple[int, int, bool, bool]]) -> np.ndarray:
    """(words, linked words, other, inside) of a page's blocks to the tree's features."""
    own = np.array([(w, k / max(w, 1)) for w, k, _, _ in blocks], float)
    pad = np.zeros((1, 2))
    marks = np.array([(o, i) for _, _, o, i in blocks], float)
    has = np.full((len(blocks), 1), float(marks[:, 1].any()))
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad]), marks, has])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A decision tree by Gini impurity: a share of label 1, or (feature, cut, lower, upper)."""
    share = y.mean()
    if depth == 0 or share in (0, 1) or len(y) < 4:
        return float(share)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, ones, n = x[order, f], np.cumsum(y[order]), np.arange(1, len(y) + 1)
        cut = np.flatnonzero(values[1:] > values[:-1])
        if len(cut):
            a, m = ones[cut], n[cut]
            b, r = ones[-1] - a, len(y) - m
            impurity = a * (m - a) / m + b * (r - b) / r
            k = int(np.argmin(impurity))
            if best is None or impurity[k] < best[0] - 1e-12:
                best = (impurity[k], f, (values[cut[k]] + values[cut[k] + 1]) / 2)
    if best is None:
        return float(share)
    _, f, at = best
    low = x[:, f] <= at
    return f, at, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def tree():
    x = np.vstack([table_features([b[:4] for b in page]) for page in TABLE])
    return grow(x, np.array([b[4] for page in TABLE for b in page]))


def classify(x: np.ndarray, node=None) -> np.ndarray:
    node = tree() if node is None else node
    if isinstance(node, float):
        return np.full(len(x), node >= 0.5)
    f, at, lower, upper = node
    low = x[:, f] <= at
    out = np.empty(len(x), bool)
    if low.any():
        out[low] = classify(x[low], lower)
    if not low.all():
        out[~low] = classify(x[~low], upper)
    return out


class Mark:
    """An element that may be another part of the page: always, if it is no form and isn't known by a
    class or id alone. start and end: of its blocks."""

    __slots__ = ("kind", "parent", "start", "end", "articles", "inside", "held")

    def __init__(self, kind: str, parent: Mark | None, start: int, articles: int, inside: bool):
        self.kind, self.parent, self.start, self.articles, self.inside = kind, parent, start, articles, inside
        self.end = self.held = None

    def close(self, end: int, articles: int) -> None:
        self.end, self.held = end, articles - self.articles

    def stands(self, sums: list[int], articles: int) -> bool:
        if self.kind == "form":
            return not self.held and 2 * (sums[self.end] - sums[self.start]) <= sums[-1]
        return self.kind == "part" or self.inside or not self.held or self.held < articles


def _names_other(names: str) -> bool:
    return any(OTHER_NAMES.search(x) and not LAYOUT_NAMES.search(x) for x in names.split())


def _id_other(value: str, inside: int) -> bool:
    """Whether an id says that its element is another part."""
    if inside == ARTICLE:
        return COMMENTS.fullmatch(value) is not None
    words = [w for w in re.split("[_-]", value) if w and not w.isdigit() and w not in PLACES]
    return bool(words) and all(OTHER_NAMES.fullmatch(w) for w in words)


def _marks_other(name: str, attributes: str, inside: int) -> str:
    """How an element is marked as another part: as a part, a form, by a name, or not at all."""
    if name != "form" and name in OTHER or name == "header" and not inside:
        return "part"
    kind = "form" if name == "form" else ""
    if not attributes or name in ("html", "head", "body"):
        return kind
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in OTHER_ROLES and not (name == "form" and value == "form"):
            return "part"
        if name in WHOLE or name in HEADINGS:
            continue
        value = html.unescape(value)
        if key == "class" and _names_other(value) or key == "id" and _id_other(value.strip(), inside):
            kind = kind or "name"
    return kind


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """A page's (text, name, attributes): a stretch of text and the tag behind it, whose name begins
    with a slash if it closes and is empty behind the last stretch. Comments and what scripts,
    styles and the like hold are left out.

    Linear in the page: a ``<`` begins a tag only if some ``>`` follows it, and after one tag whose
    quotes are never closed, tags end at their first ``>``, whatever the quotes say.
    """
    at, last, quotes = 0, page.rfind(">"), True
    text: list[str] = []
    while (tag := _OPENING.search(page, at)) is not None and tag.start() < last:
        text.append(page[at : tag.start()])
        at = tag.end()
        if tag[0] == "<!--":
            end = page.find("-->", at - 2)
            at = end + 3 if end >= 0 else len(page)
            continue
        if tag[0] in ("<!", "<?"):
            at = page.find(">", at) + 1
            continue
        name = _NAME.match(page, tag.start() + 1)
        end = _QUOTED.match(page, name.end()) if quotes else None
        quotes = end is not None
        at = end.end() if end else page.find(">", name.end()) + 1
        kind, attributes = name[0].lower(), page[name.end() : at - 1]
        if kind in UNPARSED and not attributes.endswith("/"):
            closing = _closing(kind).search(page, at)
            at = closing and page.find(">", closing.end() - 1) + 1 or len(page)
        yield "".join(text), kind, attributes
        text.clear()
    yield "".join([*text, page[at:]]), "", ""


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page. Broken markup is fine: a closing tag closes what stands open
    within its element, and none closes what isn't open."""
    out: list[Block] = []
    stack: list[tuple[str, Mark | None, int]] = []  # of open blocks: name, mark, inside
    opened: Counter[str] = Counter()
    marks: list[Mark] = []
    of: list[Mark | None] = []  # of the blocks
    parts: list[str] = []
    linked = links = articles = 0
    other, inside = None, OUTSIDE

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, linked, False, inside > OUTSIDE))
                of.append(other)
        linked = 0

    for text, name, attributes in pieces(page):
        if text and not any(opened[x] for x in UNSHOWN):
            parts.append(text)
            if links:
                linked += len(html.unescape(text).split())
        if name == "br" and parts:
            parts.append(" ")
        kind = name.lstrip("/")
        if kind == "a":
            links = name == kind
        if kind not in BLOCKS:
            continue
        flush()
        if name != kind:
            if opened[kind]:
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == kind:
                        break
                before, (other, inside) = other, (stack[-1][1], stack[-1][2]) if stack else (None, OUTSIDE)
                while before is not other and before is not None:
                    before.close(len(out), articles)
                    before = before.parent
                links = 0
        elif kind not in VOID and kind not in UNPARSED and not attributes.endswith("/"):
            if opened["head"] and (kind == "body" or kind in ("article", "main") and stack[-1][0] == "head"):
                stack = [x for x in stack if x[0] != "head"]
                opened["head"] = 0
            within, inside = inside > OUTSIDE, max(inside, ARTICLE if kind == "article" else MAIN if kind == "main" else OUTSIDE)
            if marked := _marks_other(kind, attributes, inside):
                other = Mark(marked, other, len(out), articles, within)
                marks.append(other)
            articles += kind in ("article", "main")
            stack.append((kind, other, inside))
            opened[kind] += 1
    flush()
    sums = [0, *accumulate(b.words for b in out)]
    for mark in marks:
        if mark.end is None:
            mark.close(len(out), articles)
    stand: dict[Mark | None, bool] = {None: False}
    for mark in marks:  # parents come first
        stand[mark] = stand[mark.parent] or mark.stands(sums, articles)
    for block, mark in zip(out, of, strict=True):
        block.other = stand[mark]
    return out


def main_text(page: str | None) -> str:
    """Blocks of main text, joined by two line feeds; of null, empty and textless pages empty."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    good = classify(table_features([(b.words, b.linked, b.other, b.inside) for b in blocks]))
    return "\n\n".join(b.text for b, g in zip(blocks, good, strict=True) if g)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html): the main text
    of the whole html and its number of code points. Null html is empty; null ids and urls stay;
    repeated rows each get their row; other columns are ignored."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")

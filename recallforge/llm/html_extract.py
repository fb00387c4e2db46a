"""Main text of web pages: flat text blocks, shallow features of neighbours, a decision tree.

A page is read tag by tag, in time that grows with its length only, into a flat list of text blocks; scripts, styles and
other content that is not shown give none. Each block is described by its number of words and link density, those of the
blocks before and after it, and by what the page says of the elements around it: whether they are page furniture, hold
an article, or hold an article in something named like furniture. A decision tree, grown on the small labelled table in
html_blocks, says from these which blocks are main text. Marks weigh most where a page has them; without an article
element words and links decide, and a block can be main text or not by its neighbours alone.

Defined cases: null html, no block of main text, or an empty page give empty text; a page that is cut inside a tag,
comment, script or style ends there; other elements may stay open; a null page_id or url is kept; repeated rows are
answered each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import ensure_importable, frugal
from .html_blocks import LABELLED

# What HTML calls these elements.
HIDDEN = frozenset("script style noscript template svg iframe object canvas math head title textarea select video audio".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog button label fieldset".split())
ARTICLE = frozenset("article main".split())
CLOSES_P = frozenset("p li dt dd tr td th option".split())
#: Words in class, id and role that mark page furniture and articles.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer colophon sidebar widget rail related recommended recommendations "
    "comment comments disqus replies respond discussion share sharing social subscribe subscription newsletter signup login search searchform form toc complementary contentinfo dialog copyright".split()
)
ARTICLE_WORDS = frozenset("article post entry story content maincontent main".split())

#: Parts of names that say how an element is laid out, or that it lists several of something.
LAYOUT = frozenset(
    "list lists item items wrap wrapper box container area section block body inner outer links link buttons button bar row col column columns grid panel slot unit holder group set "
    "top bottom left right center content text title heading widget widgets icons icon thread entry entries posts articles stories news media module region zone".split()
)

#: Names that begin so say what a layout goes with, not what the element is.
MODIFIERS = frozenset("with has no is without js".split())

#: A tag from its < on. A value in quotes follows its = at once; any other quote is a character like others. Nothing is
#: tried twice, so a tag that never ends takes one pass.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'=/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PARTS = re.compile(r"[^a-z]+")


def is_furniture_name(parts: list[str], in_article: bool) -> bool:
    """Whether a class, id or role, in parts, names page furniture: what it calls the element is its last part that is more
    than layout. A share-story is a story, an article-sidebar a sidebar; an article's own header is no furniture."""
    at = len(parts) - 1
    while at > 0 and parts[at] in LAYOUT:
        at -= 1
    if at < 0 or parts[at] not in FURNITURE_WORDS:
        return False
    return parts[at] != "header" or not in_article and ARTICLE_WORDS.isdisjoint(parts)


def _role(tag: str, attributes: str, in_article: bool) -> str:
    """'x' for page furniture by its element, 'n' for page furniture by its name, 'a' for article, '-' for none of these."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return "x"
    marks: set[str] = set()
    furniture = False
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in "".join(value.split()):
            return "x"
        for own in value.split() if name in ("class", "id", "role") else ():
            parts = [x for x in _PARTS.split(own) if x]
            if parts and parts[0] not in MODIFIERS:
                marks.update(parts)
                furniture |= is_furniture_name(parts, in_article)
    if furniture and tag not in ("body", "html", "main"):
        return "n"
    return "a" if tag in ARTICLE or not ARTICLE_WORDS.isdisjoint(marks) else "-"


def _end_of(tag: str, html: str, at: int) -> int:
    """Where an element ends whose start tag ends at ``at``, elements of its kind within it counted; -1 if it does not."""
    if tag in RAW:
        end = re.compile(rf"</{re.escape(tag)}(?![\w-])[^>]*+>", re.I).search(html, at)
        return end.end() if end else -1
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?![\w-])[^>]*+>", re.I).finditer(html, at):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if not depth:
            return m.end()
    return -1


Block = tuple[str, int, int, bool, bool, bool]


def blocks(html: str) -> list[Block]:
    """(text, words, linked words, furniture, outer, article) of each block that has text, in page order."""
    out: list[Block] = []
    open_: list[tuple[str, str]] = []
    by_tag: dict[str, int] = {}  # how many of each are open
    parts: list[str] = []
    linked: list[str] = []
    counts = {"x": 0, "n": 0, "a": 0}
    outside: list[int] = []  # for each open article, the names of furniture around it
    in_link = 0
    unclosed: set[str] = set()  # elements that are not closed from here on
    at = 0

    def flush() -> None:
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                in_links = len(unescape(" ".join(linked)).split()) if linked else 0
                around = outside[-1] if outside else 0
                out.append((" ".join(words), len(words), min(in_links, len(words)), counts["x"] > 0 or counts["n"] > around, around > 0, counts["a"] > 0))
            parts.clear()
            linked.clear()

    def push(tag: str, role: str) -> None:
        open_.append((tag, role))
        by_tag[tag] = by_tag.get(tag, 0) + 1
        if role != "-":
            counts[role] += 1
        if role == "a":
            outside.append(counts["n"])

    def pop() -> str:
        tag, role = open_.pop()
        by_tag[tag] -= 1
        if role != "-":
            counts[role] -= 1
        if role == "a":
            outside.pop()
        return tag

    def text(upto: int) -> None:
        if upto > at:
            parts.append(html[at:upto])
            if in_link:
                linked.append(html[at:upto])

    while (lt := html.find("<", at)) >= 0:
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?"):
            text(lt)
            comment = html.startswith("<!--", lt)
            end = html.find("-->" if comment else ">", lt + 2)
            at = len(html) if end < 0 else end + (3 if comment else 1)
            continue
        m = _TAG.match(html, lt) if after.isascii() and (after.isalpha() or after == "/" and html[lt + 2 : lt + 3].isalpha()) else None
        if m is None:
            if after.isascii() and after.isalpha() or after in ("/", ""):
                text(lt)
                at = len(html) if html.find(">", lt) < 0 else lt + 1 if after not in ("/", "") else html.find(">", lt) + 1
                if at == lt + 1:
                    parts.append("<")
                continue
            text(lt + 1)
            at = lt + 1
            continue
        text(lt)
        at = m.end()
        tag = m[2].lower()
        if not m[1]:
            if tag in HIDDEN and not m[3].endswith("/"):
                if tag not in unclosed:
                    end = _end_of(tag, html, at)
                    if end >= 0:
                        at = end
                    else:
                        unclosed.add(tag)
                if tag in unclosed and tag in RAW:
                    at = len(html)
                continue
            if tag in VOID:
                if tag == "br":
                    parts.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in INLINE:
                in_link += tag == "a"
                continue
            flush()
            in_link = 0
            if tag in CLOSES_P and open_ and open_[-1][0] == tag:
                pop()
            push(tag, _role(tag, m[3], counts["a"] > 0))
        elif tag in INLINE:
            if tag == "a" and in_link:
                in_link -= 1
        else:
            flush()
            in_link = 0
            if by_tag.get(tag):
                while pop() != tag:
                    pass
    text(len(html))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row per block, with the columns of LABELLED but the last."""
    words = np.array([b[1] for b in found], float)
    density = np.array([b[2] for b in found], float) / np.maximum(words, 1)
    shift = lambda x, by: np.concatenate([[0.0], x[:-1]] if by > 0 else [x[1:], [0.0]])
    marks = np.array([b[3:] for b in found], float).reshape(-1, 3)
    return np.column_stack([shift(words, 1), shift(density, 1), words, density, shift(words, -1), shift(density, -1), marks])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2):
    """A classification tree by Gini impurity: (feature, cut, below or equal, above), or a leaf's label."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        for i in np.flatnonzero(v[1:] > v[:-1]):
            if least <= n[i] <= len(y) - least:
                a, b = ones[i] / n[i], (ones[-1] - ones[i]) / (len(y) - n[i])
                impurity = n[i] * a * (1 - a) + (len(y) - n[i]) * b * (1 - b)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, (v[i] + v[i + 1]) / 2)
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, decide(low, x), decide(high, x))


def trained_tree(table: str = LABELLED):
    rows = np.array([line.split() for line in table.strip().splitlines()], float)
    return grow(rows[:, :-1], rows[:, -1])


def main_text(html: str | None, tree) -> str:
    found = blocks(html) if html else []
    if not found:
        return ""
    return "\n".join(b[0] for b, keep in zip(found, decide(tree, features(found))) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    ensure_importable(pages.sparkSession)
    tree = trained_tree()

    def extract(batches):
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(frugal(extract), f"page_id {kind}, url string, text string, n_chars long")

"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut at its block-level tags into flat blocks.  Each block has its word count
and link density and those of both neighbours, its kind (heading, paragraph, list
item), the share of its container in the page's text, and what encloses it: an article,
a frame such as a menu or form, or a name whose head word is one such as "cookie" or
"comments".  A decision tree, grown on the labelled pages of ``html_examples``, says
which blocks are main text; nothing else decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_examples

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that browsers read as raw text up to their end tag, or to the page's end.
RAW_TAGS = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: Other elements whose content is not text of the page; without an end tag of their own they hide nothing.
SKIPPED_TAGS = frozenset("noscript template svg math object select button head canvas audio video".split())
#: Foreign content, which any block-level start tag ends.
FOREIGN_TAGS = frozenset("svg math".split())
#: A start tag of these closes an open one of its kind.
SELF_CLOSING = frozenset("p li dt dd tr td th".split())
CONTENT_TAGS = frozenset("article main".split())
FRAME_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTENT_ROLES = frozenset("main article".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Head words of class names and ids of what is not main text (fixed values).
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo promoted recommended related replies respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
CONTENT_WORDS = frozenset("article content entry main post story".split())
#: Words that say how a thing is laid out, not what it is: the head word is looked for before them (fixed values).
LAYOUT_WORDS = frozenset(
    "area articles bar block body bottom box button buttons col column container group inner item items left link links list outer panel posts "
    "right row section slot stories text thread title top unit wrap wrapper".split()
)

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
BLOCK_START = re.compile(r"<(?:" + "|".join(sorted(BLOCK_TAGS)) + r")(?![-\w])", re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Beginnings of class names that say what a page has or lacks, not what the element is.
STATE = re.compile(r"(?:no|not|has|have|with|without|is|hide|show|enable|disable|js)(?=[-_A-Z])")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

CONTENT, FRAME, NAMED, HIDDEN, LABELLED = 1, 2, 4, 8, 16
#: Marks of an element alone: a header or a name of one (frames, unless an article encloses them), what is apart from labelled text, and what wraps a page.
HEAD, HEAD_NAMED, APART, WRAPS = 32, 64, 128, 256
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "in_content", "in_frame", "in_named", "page_has_content", "heading", "list_item", "paragraph", "container_share",
)
#: A frame wraps the page if it has so large a share of the words: with all that is marked as content inside, and where nothing is so marked.
WRAPPER_SHARE, BARE_SHARE = 0.5, 0.9
#: Pages of every mark-up that the tree is grown on, and its bounds.
TRAINING_ROUNDS, DEPTH, LEAF = 16, 30, 6


def head_word(name: str) -> str:
    """What a class name or id calls its element: the last of its words that isn't one of layout."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    while len(words) > 1 and words[-1] in LAYOUT_WORDS:
        words.pop()
    return words[-1] if words else ""


def marks(name: str, attributes: str) -> int:
    """What an element says of itself: tag, role, names, whether it is hidden."""
    own = 0
    if name in CONTENT_TAGS:
        own |= CONTENT
    if name == "header":
        own |= HEAD
    elif name in FRAME_TAGS:
        own |= FRAME
    if name in ("html", "body"):
        own |= WRAPS
    if attributes and attributes.strip("/ \t\r\n"):
        found = {a.lower(): (b or c or d) for a, b, c, d in ATTRIBUTE.findall(attributes)}
        heads = {head_word(w) for key in ("class", "id") for w in found.get(key, "").split() if not STATE.match(w)}
        role = found.get("role", "").lower()
        if role in CONTENT_ROLES:
            own |= CONTENT
        if role in FRAME_ROLES:
            own |= FRAME
        if heads & FRAME_WORDS:
            own |= HEAD_NAMED if heads & FRAME_WORDS <= {"header"} else NAMED
        elif heads & CONTENT_WORDS:
            own |= CONTENT
        style = found.get("style", "").replace(" ", "").lower()
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            own |= HIDDEN
        if "data-main" in found:
            own |= LABELLED
        elif "data-apart" in found:
            own |= APART
    return own


def enclosing_flags(parents: list[int], own: list[int], words: list[int]) -> list[int]:
    """The flags of what encloses each element, itself among it; parents stand before their children.

    ``html`` and ``body`` are no frames whatever they are called, and neither is an element
    that has most of the page's words and all elements inside that are marked as content
    and not as frames, or, on a page without such marks, nearly all words.
    """
    n = len(own)
    within, marked = list(words), [0] * n
    for k in range(n - 1, 0, -1):
        within[parents[k]] += within[k]
        marked[parents[k]] += marked[k] + bool(own[k] & CONTENT and not own[k] & (FRAME | NAMED | HIDDEN))
    flags = [0] * n
    for k in range(n):
        inside, mine = flags[parents[k]] if k else 0, own[k]
        wraps = mine & WRAPS or not inside & CONTENT and marked[k] == marked[0] and within[k] > (WRAPPER_SHARE if marked[0] else BARE_SHARE) * within[0]
        if mine & (HEAD | HEAD_NAMED) and not inside & CONTENT:
            mine |= FRAME if mine & HEAD else NAMED
        if wraps and mine & (FRAME | NAMED) and (mine & WRAPS or not mine & HEAD):
            mine &= ~(FRAME | NAMED)
        flags[k] = (inside | mine & (CONTENT | FRAME | NAMED | HIDDEN | LABELLED)) & ~(LABELLED if mine & APART else 0)
    return flags


@cache
def tags_named(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(name)}(?![-\w])[^>]*>", re.I)


def matching_ends(html: str, name: str) -> dict[int, tuple[int, int]]:
    """Where each start tag of ``name`` that has an end tag of its own ends: {start: (start, end of the end tag)}."""
    open_tags: list[int] = []
    found = {}
    for tag in tags_named(name).finditer(html):
        if tag[1]:
            if open_tags:
                found[open_tags.pop()] = tag.span()
        elif not tag[0].endswith("/>"):
            open_tags.append(tag.start())
    return found


def blocks(page: str | None) -> list[tuple[str, int, int, int, str, int]]:
    """Text, words, words in links, flags, tag and container of every block that has text, in page order."""
    html = page or ""
    found: list[tuple[str, int, int, int, str, int]] = []
    parents, own, words_in = [0], [0], [0]  # by element
    stack: list[tuple[str, int]] = [("", 0)]  # name, number
    is_open: Counter[str] = Counter()
    parts: list[str] = []
    links: list[str] = []
    in_link = link_end = 0
    block_from = block_at = -1  # the first block-level tag from a place on
    ends: dict[str, dict[int, tuple[int, int]]] = {}

    def end_of(name: str, opening: int) -> tuple[int, int] | None:
        if name not in ends:
            ends[name] = matching_ends(html, name)
        return ends[name].get(opening)

    def link_ends(opening: int) -> int:
        """Where the link that starts here has its end tag; 0 if another link starts before."""
        if "a" not in ends:
            ends["a"] = {}
            started = None
            for tag in tags_named("a").finditer(html):
                if tag[1]:
                    if started is not None:
                        ends["a"][started] = tag.span()
                    started = None
                else:
                    started = tag.start()
        return ends["a"].get(opening, (0, 0))[0]

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                name, number = stack[-1]
                container = stack[-2][1] if len(stack) > 1 else number
                n_words = text.count(" ") + 1
                words_in[number] += n_words
                found.append((text, n_words, len(unescape(" ".join(links)).split()), number, name, container))
            parts.clear()
            links.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                links.append(text)

    def push(name: str, mine: int) -> None:
        parents.append(stack[-1][1])
        own.append(mine)
        words_in.append(0)
        stack.append((name, len(own) - 1))
        is_open[name] += 1

    def pop_one() -> str:
        name, _ = stack.pop()
        is_open[name] -= 1
        return name

    def pop(name: str) -> None:
        if is_open[name] > 0:
            while pop_one() != name:
                pass

    def block_before(at: int, stop: int) -> int:
        """Where the first block-level start tag between two places is; ``stop`` if there is none."""
        nonlocal block_from, block_at
        if not block_from <= at <= block_at:
            block = BLOCK_START.search(html, at)
            block_from, block_at = at, block.start() if block else len(html)
        return min(block_at, stop)

    at, end = 0, len(html)
    while at < end:
        opening = html.find("<", at)
        if opening < 0:
            add(html[at:])
            break
        add(html[at:opening])
        if html.startswith("<!--", opening):
            closing = html.find("-->", opening + 4)
            at = end if closing < 0 else closing + 3
            continue
        if html.startswith(("<!", "<?"), opening):
            closing = html.find(">", opening)
            at = end if closing < 0 else closing + 1
            continue
        tag = TAG.match(html, opening) or LOOSE_TAG.match(html, opening)
        if tag is None:
            following = html[opening + 1 : opening + 2]
            if following.isalpha() or following == "/":
                break  # a tag that the page's end cuts off
            add("<")
            at = opening + 1
            continue
        at = tag.end()
        slash, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in RAW_TAGS:
            if not slash:
                closing = re.compile(rf"</{name}(?![-\w])[^>]*>", re.I).search(html, at)
                at = closing.end() if closing else end
            if name not in ("script", "style"):
                add(" ")
        elif name in SKIPPED_TAGS:
            closing = None if slash or attributes.endswith("/") else end_of(name, opening)
            if closing is not None:
                block = block_before(at, closing[0]) if name in FOREIGN_TAGS else closing[0]
                at = block if block < closing[0] else closing[1]
            add(" ")
        elif name == "br":
            add(" ")
        elif name == "a":
            in_link = 0 if slash else 1
            link_end = 0 if slash or "href" not in attributes.lower() else link_ends(opening)
        elif name in BLOCK_TAGS:
            close()
            if opening >= link_end:
                in_link = 0  # only a link that has an end tag goes on in other blocks
            if slash:
                pop(name)
            elif name not in VOID_TAGS:
                if name in SELF_CLOSING and stack[-1][0] == name:
                    pop_one()
                elif stack[-1][0] == "p":
                    pop_one()  # any block ends a paragraph
                push(name, marks(name, attributes))
        elif slash:
            if stack[-1][0] == f"<{name}":
                close()
                pop_one()
        elif attributes and (mine := marks("", attributes)) & (HIDDEN | NAMED | HEAD_NAMED) and not attributes.endswith("/"):
            closing = end_of(name, opening)  # an inline element that is hidden or named as a frame
            if closing is not None and block_before(at, closing[0]) == closing[0]:
                at = closing[1]
            elif closing is not None:
                close()
                push(f"<{name}", mine)
    close()
    flags = enclosing_flags(parents, own, words_in)
    return [(text, n, in_links, flags[number], name, container) for text, n, in_links, number, name, container in found if not flags[number] & HIDDEN]


def features(found: list[tuple[str, int, int, int, str, int]]) -> np.ndarray:
    """A row for each block, as named in ``FEATURES``."""
    n = len(found)
    words = np.array([b[1] for b in found], float)
    density = np.array([min(b[2] / b[1], 1.0) for b in found])
    flags = np.array([b[3] for b in found], np.int64)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    for k, bit in ((6, CONTENT), (7, FRAME), (8, NAMED)):
        out[:, k] = (flags & bit) > 0
    out[:, 9] = bool(((flags & CONTENT) > 0).any())
    out[:, 10] = [b[4] in HEADINGS for b in found]
    out[:, 11] = [b[4] == "li" for b in found]
    out[:, 12] = [b[4] == "p" for b in found]
    _, container = np.unique([b[5] for b in found], return_inverse=True)
    plain = np.where(flags & (FRAME | NAMED), 0.0, words * (1 - density))
    own = np.bincount(container, plain)
    out[:, 13] = own[container] / max(own.max(), 1.0)
    return out


def grow(rows: np.ndarray, labels: np.ndarray, depth: int, leaf: int = LEAF) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, below, above) or (label,).

    A cut leaves ``leaf`` rows or more on either side; smaller parts are split off only
    where no such cut is left.
    """
    n = len(labels)
    if depth == 0 or labels.all() or not labels.any():
        return (bool(labels.mean() >= 0.5),)
    best = None
    for k in range(rows.shape[1]):
        order = np.argsort(rows[:, k], kind="stable")
        values, sums = rows[order, k], np.cumsum(labels[order])
        edges = np.flatnonzero(values[1:] > values[:-1]) + 1  # rows below the cut
        edges = edges[(edges >= leaf) & (edges <= n - leaf)]
        if not len(edges):
            continue
        low, high = sums[edges - 1], sums[-1] - sums[edges - 1]
        impurity = low * (1 - low / edges) + high * (1 - high / (n - edges))
        at = int(np.argmin(impurity))
        if best is None or impurity[at] < best[0] - 1e-9:
            best = (impurity[at], k, float(values[edges[at] - 1] + values[edges[at]]) / 2)
    if best is None:
        return grow(rows, labels, depth, 1) if leaf > 1 else (bool(labels.mean() >= 0.5),)
    _, k, cut = best
    below = rows[:, k] <= cut
    return (k, cut, grow(rows[below], labels[below], depth - 1, leaf), grow(rows[~below], labels[~below], depth - 1, leaf))


def used(tree: tuple) -> set[str]:
    """Names of the features that a tree asks for."""
    return set() if len(tree) == 1 else {FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def classify(tree: tuple, rows: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(rows), tree[0])
    k, cut, below, above = tree
    low = rows[:, k] <= cut
    out = np.empty(len(rows), bool)
    out[low], out[~low] = classify(below, rows[low]), classify(above, rows[~low])
    return out


def labelled_table(pages: Iterable[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages (main text lies in ``data-main`` elements)."""
    pages = [html for html, _ in html_examples.pages(8, TRAINING_ROUNDS)] if pages is None else pages
    cut = [c for c in map(blocks, pages) if c]
    return np.concatenate([features(c) for c in cut]), np.array([bool(b[3] & LABELLED) for c in cut for b in c])


@cache
def default_tree(depth: int = DEPTH) -> tuple:
    return grow(*labelled_table(), depth)


def main_text(page: str | None, tree: tuple | None = None) -> str:
    """Main blocks of a page, joined by one newline."""
    found = blocks(page)
    if not found:
        return ""
    main = classify(tree or default_tree(), features(found))
    return "\n".join(b[0] for b, keep in zip(found, main, strict=True) if keep)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per row of ``pages``.

    A null page counts as empty; a page without main text has an empty text.  Null urls
    stay null; repeated rows come out as often as they came; an empty table gives an
    empty result; other columns are not looked at.
    """
    tree = default_tree()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column(2)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(of, "page_id long, url string, text string, n_chars long")

"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. Each block is described by its word count and link density,
those of the blocks before and after it, and where it stands: the share of the page's running words that its own article or main part
holds, or how much of them articles beside it hold, so that neither a teaser in an article of its own nor a page without articles decides
for the rest; headers inside an article are told from those of the page, and a page's title from other headings. A small decision tree, grown
here from a labelled table of blocks, keeps or drops it. A container is hinted at as boilerplate by a class, id or role all of whose words name such or are of layout
("share-buttons", not "share-story"); articles, main parts and whole pages never are.

Defined results: null and empty pages have the text "" and n_chars 0; broken markup never fails: an unclosed comment, script or style
runs to the end of the page, of other unclosed elements without text only the tag is dropped, an unclosed link ends with its block (a
link around whole blocks goes on through them), a lone "<" is text; time is linear in the page; repeated rows are separate rows; other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by the part they play here.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
HIDDEN_TAGS = frozenset("audio button canvas datalist iframe math noembed noframes noscript object script select style svg template textarea title video".split())
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title".split())
BOILER_TAGS = frozenset("aside dialog footer form head header menu nav".split())
CONTAINERS = BOILER_TAGS | frozenset("article blockquote body details div dl figure fieldset main ol section table tbody td tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination reaction "
    "reactions response responses "
    "popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "tags toolbar widget widgets".split()
)
LAYOUT = frozenset(
    "area articles bar block body bottom box button buttons col column container content count entries entry form group header holder icon icons id "
    "inner item items js label left line link links list main menu message messages module outer panel post posts right row section "
    "site slot small sticky stories text thread title top unit user view wrap wrapper".split()
)

_PIECE = re.compile(r"<!--|<[/!?]?[a-zA-Z](?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+'|[\"'])*+>?|<[!?/][^>]*+>?|[^<]++|<", re.S)
_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)[^<>]*>?")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW_TAGS}
_HIDE = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

#: Words of a block of running text, and factors of the lengths of such blocks in the labelled pages.
RUNNING, STRETCH = 9, (0.5, 2, 3, 5, 8)
#: Articles inside articles count up to this depth; deeper ones belong to the last that counts.
NESTED = 8
FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "article_share", "in_boiler", "hinted", "heading", "title")


class Block:
    __slots__ = ("at", "boiler", "heading", "hinted", "link_words", "parts", "region", "text", "words")

    def __init__(self, at: int, region: tuple[int, ...], boiler: float, hinted: bool, heading: int) -> None:
        self.at, self.region, self.boiler, self.hinted, self.heading = at, region, boiler, hinted, heading
        self.parts, self.link_words, self.words, self.text = [], 0, 0, ""


def _hinted(tag: str) -> bool:
    for m in _ATTR.finditer(tag):
        for value in re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower().split():
            named = [w for w in re.split(r"[_\-]+", value) if w and not any(c.isdigit() for c in w)]
            if not HINTS.isdisjoint(named) and all(w in HINTS or w in LAYOUT for w in named):
                return True
    return bool(_HIDE.search(tag))


class _Hidden:
    """Where elements without text end. One that is not closed before what encloses it is hides nothing but its tag."""

    def __init__(self, page: str) -> None:
        self.page, self.known = page, {}  # by name: how far the page has been looked at, and ends of the elements closed there

    def end(self, name: str, begun: int, pos: int) -> int:
        upto, ends = self.known.get(name, (-1, {}))
        if begun >= upto:
            upto, ends = self.known[name] = self._look(name, begun, pos)
        return ends.get(begun, pos)

    def _look(self, name: str, begun: int, pos: int) -> tuple[int, dict[int, int]]:
        depth, opened, ends = 0, [begun], {}
        for m in _TAG.finditer(self.page, pos):
            tag, closing = m[2].lower(), bool(m[1])
            if tag == name:
                if closing:
                    ends[opened.pop()] = m.end()
                elif not m[0].endswith("/>"):
                    opened.append(m.start())
                if not opened:
                    return m.end(), ends
            elif tag in CONTAINERS:
                depth += -1 if closing else not m[0].endswith("/>")
                if depth < 0:
                    return m.start(), ends
        return len(self.page), ends


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    out: list[Block] = []
    # name, numbers of the articles and main parts, boiler (half: only a header of an article), hinted: each with what encloses it
    stack: list[tuple[str, tuple[int, ...], float, bool]] = []
    opened = dict.fromkeys(CONTAINERS, 0)
    region: tuple[int, ...] = ()
    regions, boiler, hinted = 0, 0.0, False
    heading, hides = "", _Hidden(page)
    link = told = False  # in a link; told: it has had text of its own
    inside = 0  # blocks opened in the link
    now: Block | None = None
    pos, n = 0, len(page)
    while pos < n:
        m = _PIECE.match(page, pos)
        piece, begun, pos = m[0], pos, m.end()
        if piece == "<!--":
            end = page.find("-->", pos)
            pos = n if end < 0 else end + 3
            continue
        name = _NAME.search(piece, 1, 200) if piece[0] == "<" and len(piece) > 1 else None
        if piece[0] == "<" and len(piece) > 1 and (not name or piece[1] in "!?"):
            continue
        if name is None:
            if now is None:
                if piece.isspace():
                    continue
                now = Block(begun, region, boiler, hinted, 7 - int(heading[1]) if heading else 0)
                out.append(now)
            now.parts.append(piece)
            if link:
                now.link_words += len(piece.split())
                told = told or not (inside or piece.isspace())
            continue
        name, closing = name[0].lower(), piece[1] == "/"
        if name in RAW_TAGS:
            if not closing and not piece.endswith("/>"):
                end = _RAW_END[name].search(page, pos)
                pos = end.end() if end else n
            continue
        if name in HIDDEN_TAGS:
            if not closing and not piece.endswith("/>"):
                pos = hides.end(name, begun, pos)
            continue
        if name == "a":
            link, told, inside = not closing, False, 0
            continue
        if name == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if name not in BLOCK_TAGS:
            continue
        if link and name != "hr":
            inside += -1 if closing else 1
            link = inside >= 0 and not told
        now = None
        if name in HEADINGS:
            heading = "" if closing else name
        elif name == "p":
            heading = ""
        if name in CONTAINERS:
            if not closing:
                if not piece.endswith("/>"):
                    own = name not in ("body", "article", "main") and _hinted(piece)
                    inner = region
                    if name in ("article", "main") and len(region) < NESTED:
                        regions += 1
                        inner = (*region, regions)
                    plate = 0.0 if name not in BOILER_TAGS else 0.5 if name == "header" and region else 1.0
                    stack.append((name, inner, max(boiler, plate), hinted or own))
                    opened[name] += 1
            elif opened[name]:
                while (top := stack.pop()[0]) != name:
                    opened[top] -= 1
                opened[name] -= 1
            _, region, boiler, hinted = stack[-1] if stack else ("", (), 0.0, False)
    kept = []
    for b in out:
        parts = html.unescape("".join(b.parts)).split()
        if parts:
            b.words, b.text = len(parts), " ".join(parts)
            b.link_words = min(b.link_words, b.words)
            kept.append(b)
    return kept


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; a missing neighbour counts as one of 0 words and density 0.

    article_share: of the words outside links, menus and the like, the share that the block's innermost article or main part holds; outside
    of these, less the share that they hold together. heading: 6 for h1 to 1 for h6, else 0. title: the first h1, of an article if one has any."""
    w = np.array([0, *(b.words for b in found), 0], np.float64)
    d = np.array([0, *(b.link_words / b.words for b in found), 0], np.float64)
    held: dict[int, int] = {}
    total = inside = 0
    for b in found:
        if b.boiler < 1 and not b.hinted:
            free = b.words - b.link_words
            total += free
            inside += free if b.region else 0
            for r in b.region:
                held[r] = held.get(r, 0) + free
    tops = [b for b in found if b.heading == 6 and b.boiler < 1 and not b.hinted]
    title = next((b for b in tops if b.region), tops[0] if tops else None)
    share = [held.get(b.region[-1], 0) / max(total, 1) if b.region else -inside / max(total, 1) for b in found]
    place = np.array([[x, b.boiler, b.hinted, b.heading, b is title] for b, x in zip(found, share, strict=True)], np.float64).reshape(-1, 5)
    return np.column_stack([w[1:-1], d[1:-1], w[:-2], d[:-2], w[2:], d[2:], place])


_LONG = "The river rises in the northern hills and runs for ninety miles through open farmland before it reaches the old harbour town."
_MID = "Nobody in the village had seen the lights before that evening."
_SHORT = "It rained."
_LINKS = '<a href="/x">Home</a> <a href="/y">News and views</a> <a href="/z">Contact us</a>'

#: The labelled table: pages as pieces of markup, 1 if a piece is a block of the main text, 0 if not, None if it holds no text.
LABELLED = (
    ((None, "<body><nav><ul>"), (0, '<li><a href="/a">Home</a></li>'), (0, '<li><a href="/b">Sport</a></li>'), (None, "</ul></nav>"), (0, f'<div class="ad">{_MID}</div>'), (None, "<article>"), (1, "<h1>A river and its town</h1>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_SHORT}</p>"), (1, f"<p>{_MID} {_LONG}</p>"), (None, "</article>"), (0, "<footer>&copy; example &middot; The river rises in the hills and runs on.</footer>")),
    ((None, "<body><header>"), (0, f"<p>{_MID}</p>"), (None, "</header><main>"), (1, "<h2>Notes</h2>"), (1, f"<p>{_SHORT}</p>"), (1, f"<p>{_SHORT}</p>"), (1, f"<ul><li>{_SHORT}</li>"), (1, "<li>Two loaves of bread</li></ul>"), (0, f"<div>{_LINKS}</div>"), (1, f"<blockquote>{_LONG}</blockquote>"), (None, "</main>"), (0, f"<aside>{_LONG} {_LONG}</aside>"), (0, "<footer>All rights reserved.</footer>")),
    ((None, "<body>"), (0, f"<div>{_LINKS}</div>"), (0, "<div>Welcome</div>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_LONG} {_MID}</p>"), (1, f"<p>{_MID}</p>"), (1, f"<p>{_LONG}</p>"), (0, f"<div>{_LINKS}</div>"), (0, "<div>Terms of use</div>")),
    ((None, "<body><article>"), (1, f"<p>{_MID}</p>"), (None, '<div class="comments">'), (0, f"<p>{_LONG}</p>"), (0, f"<p>{_SHORT}</p>"), (None, "</div>"), (1, f"<p>{_MID}</p>"), (0, f"<aside>{_MID}</aside>"), (1, f'<p>{_LONG} <a href="/q">See the map</a> and {_MID}</p>'), (0, f"<form>{_MID}</form>"), (1, f"<p>{_SHORT}</p>"), (None, "</article>"), (0, f'<div class="cookie-notice">{_LONG}</div>'), (0, f"<footer>{_LONG} {_LONG}</footer>")),
    ((None, "<body><nav><ul>"), (0, '<li><a href="/a">Home</a></li>'), (None, "</ul></nav><article>"), (1, "<h1>Rain</h1>"), (1, f"<p>{_SHORT}</p>"), (0, f"<div>{_LINKS}</div>"), (1, f"<p>{_SHORT}</p>"), (1, f"<p>{_MID}</p>"), (0, f"<div>{_LINKS}</div>"), (1, f"<p>{_MID}</p>"), (None, "</article>")),
    ((None, "<body>"), (0, f"<div>{_LINKS}</div>"), (None, "<main>"), (1, "<h1>Late rain in the hills</h1>"), (1, "<p>No.</p>"), (None, "</main>"), (0, f"<div>{_LINKS}</div>"), (0, "<div>Terms</div>"), (0, "<div>Back to the top of this page</div>")),
    ((None, "<body><article>"), (1, "<h1>Stop</h1>"), (1, "<p>Yes.</p>"), (None, "</article>"), (0, f"<footer>{_MID}</footer>")),
    ((None, '<body><div class="sidebar">'), (0, f"<p>{_LONG}</p>"), (0, f"<p>{_MID}</p>"), (None, "</div>"), (0, "<h3>Latest</h3>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_MID} {_MID}</p>"), (0, f"<form>{_SHORT}</form>"), (0, f"<footer>{_SHORT}</footer>")),
    ((None, "<body><article>"), (1, f"<p>{_LONG}</p>"), (1, "<table><tr><td>Length</td>"), (1, "<td>90 miles</td></tr></table>"), (1, "<pre>a b c</pre>"), (0, '<ul><li><a href="/n">Next story of the day</a></li></ul>'), (None, "</article>"), (0, f"<nav>{_LINKS}</nav>")),
    ((None, "<body>"), (0, f"<div>{_LINKS}</div>"), (1, "<h1>The lights of the village</h1>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_SHORT}</p>"), (1, f"<p>{_LONG} {_MID}</p>"), (1, "<li>Two loaves of bread</li>"), (1, "<li>Salt</li>"), (1, "<li>A pound of butter</li>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_MID}</p>"), (1, f"<p>{_LONG}</p>"), (0, f"<div>{_LINKS}</div>"), (0, "<div>Copyright of the paper</div>"), (0, f"<div>{_LINKS}</div>")),
    ((None, "<body>"), (0, f"<div>{_LINKS}</div>"), (0, "<div>Search this site</div>"), (0, f"<div>{_LINKS}</div>"), (0, "<h3>Most read</h3>"), (0, '<ul><li><a href="/1">Floods in the valley</a></li>'), (0, '<li><a href="/2">A bridge is closed for the winter</a></li></ul>'), (1, "<h1>Bread from the old mill</h1>"), (1, f"<p>{_LONG}</p>"), (1, "<p>No.</p>"), (1, "<p>Nobody knew why.</p>"), (1, f"<p>{_LONG}</p>"), (1, "<h2>What came then</h2>"), (1, f"<p>{_MID} {_LONG}</p>"), (0, f"<div>{_LINKS}</div>"), (0, "<div>Back to the top</div>"), (0, f"<div>{_LINKS}</div>")),
    ((None, "<body><article>"), (1, "<h1>Late rain</h1>"), (1, f"<p>{_LONG}</p>"), (None, "</article>")),
    ((None, "<body><main>"), (1, f"<p>{_SHORT}</p>"), (None, "</main>")),
    ((None, "<body>"), (1, f"<p>{_LONG} {_LONG}</p>")),
    ((None, "<body>"), (1, "<h1>Notes from the hills</h1>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_SHORT}</p>"), (1, f"<p>{_MID}</p>")),
    ((None, "<body>"), (0, f"<div>{_LINKS}</div>"), (1, "<h1>Bread</h1>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_MID}</p>"), (0, f"<div>{_LINKS}</div>")),
    ((None, "<body>"), (0, f"<div>{_LINKS}</div>"), (0, "<div>Log in</div>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_LONG}</p>"), (0, "<div>Terms of use</div>"), (0, f"<div>{_LINKS}</div>")),
    ((None, "<body>"), (0, "<a href='/p'><div>A new way to see the river, now for half its price and with free tickets for all who come early</div></a>"), (1, "<h1>Rain</h1>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_MID}</p>"), (0, f"<a href='/p'><div>{_LONG}</div></a>"), (1, f"<p>{_LONG}</p>"), (0, f"<div>{_LINKS}</div>")),
    ((None, "<body><nav>"), (0, f"<div>{_LINKS}</div>"), (None, '</nav><div id="content">'), (1, "<h1>The lights of the village</h1>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_MID} {_LONG}</p>"), (None, "</div><div><article>"), (0, f"<p>{_MID}</p>"), (None, "</article></div>"), (0, f"<footer>{_MID}</footer>")),
    ((None, "<body>"), (1, "<h1>Rain in the hills</h1>"), (None, "<article>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_MID}</p>"), (1, f"<p>{_LONG} {_LONG}</p>"), (None, "</article><article>"), (0, "<h3>A bridge is closed</h3>"), (0, f"<p>{_SHORT}</p>"), (None, "</article>"), (0, f"<footer>{_SHORT}</footer>")),
    ((None, "<body><header>"), (0, "<h1>The Daily Page</h1>"), (None, "</header><main><article><header>"), (1, "<h1>Bread from the old mill</h1>"), (0, f"<p>{_SHORT}</p>"), (None, "</header>"), (1, f"<p>{_LONG}</p>"), (1, f"<h2>{_SHORT}</h2>"), (1, f"<p>{_MID}</p>"), (None, "</article><article>"), (0, f"<p>{_SHORT}</p>"), (None, "</article></main>"), (0, f"<footer>{_MID}</footer>")),
    ((None, "<body><nav>"), (0, f"<div>{_LINKS}</div>"), (None, "</nav>"), (1, "<h1>Stop</h1>"), (None, "<article>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_MID}</p>"), (None, "</article>"), (0, "<div>Back to the top</div>")),
    ((None, "<body>"), (1, "<h1>Late rain</h1>"), (None, "<article>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_SHORT}</p>"), (None, "</article>"), (0, "<div>Terms</div>"), (0, f"<footer>{_MID}</footer>")),
    ((None, "<body>"), (0, f"<div>{_LINKS}</div>"), (1, f"<h1>{_MID}</h1>"), (None, "<article>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_LONG} {_MID}</p>"), (None, "</article>"), (0, f"<div>{_MID}</div>")),
    ((None, "<body><div>"), (0, "<h1>The Daily Page</h1>"), (None, "</div><article>"), (1, "<h1>Late rain in the hills</h1>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_MID}</p>"), (None, "</article>"), (0, "<h3>Latest</h3>"), (0, f"<footer>{_MID}</footer>")),
    ((None, "<body>"), (0, f"<div>{_LINKS}</div>"), (1, "<h1>The old mill</h1>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_SHORT}</p>"), (1, "<ul><li>two loaves</li>"), (1, "<li>fine salt</li></ul>"), (1, f"<p>{_LONG}</p>"), (1, "<ul><li>one bridge</li>"), (1, "<li>three lights</li></ul>"), (1, f"<p>{_MID}</p>"), (0, f"<div>{_LINKS}</div>"), (0, "<div>Log in</div>")),
    ((None, "<body><div>"), (1, "<h1>A river and its town</h1>"), (1, f"<p>{_SHORT}</p>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_LONG} {_MID}</p>"), (None, "</div><section><article>"), (0, "<h3>Most read</h3>"), (0, f"<p>{_MID}</p>"), (None, "</article><article>"), (0, "<h3>Floods</h3>"), (0, f"<p>{_SHORT}</p>"), (None, "</article></section>"), (0, f"<div>{_LINKS}</div>")),
    ((None, "<body><header>"), (0, "<h1>The Daily Page</h1>"), (0, f"<p>{_SHORT}</p>"), (None, "</header><article>"), (0, f"<header><p>{_MID}</p></header>"), (1, f"<p>{_SHORT}</p>"), (0, f'<div class="share">{_SHORT}</div>'), (1, f"<p>{_LONG}</p>"), (0, f'<section id="comments"><p>{_MID}</p></section>'), (None, "</article>"), (0, f"<div>{_SHORT}</div>"), (0, f"<footer><p>{_LONG}</p></footer>")),
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED."""
    x, y = [], []
    for page in LABELLED:
        ends = np.cumsum([len(p) for _, p in page])
        found = blocks("".join(p for _, p in page))
        x.append(features(found))
        y += [page[int(np.searchsorted(ends, b.at, side="right"))][0] for b in found]
    return np.concatenate(x), np.array(y, np.int64)


def stretched(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table, and its rows as of pages whose running text of RUNNING words or more is longer or shorter by STRETCH: lengths of text are no labels."""
    counts = [FEATURES.index(f) for f in ("words", "words_before", "words_after")]
    out = [x]
    for f in STRETCH:
        other = x.copy()
        other[:, counts] = np.where(other[:, counts] >= RUNNING, np.maximum(np.round(other[:, counts] * f), RUNNING), other[:, counts])
        out.append(other)
    return np.concatenate(out), np.tile(y, len(out))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, low, high) or (label,)."""
    ones = int(y.sum())
    best = None
    if depth and 0 < ones < len(y):
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in ((values[1:] + values[:-1]) / 2).tolist():
                low = x[:, f] <= t
                cost = sum(2 * s * (k / s) * (1 - k / s) for s, k in ((int(low.sum()), int(y[low].sum())), (int((~low).sum()), int(y[~low].sum()))))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, t, low)
    if best is None:
        return (int(2 * ones >= len(y)),)
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache(maxsize=1)
def trained_tree() -> tuple:
    return grow(*stretched(*labelled_table()))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)

    def walk(node: tuple, rows: np.ndarray) -> None:
        if len(node) == 1:
            out[rows] = bool(node[0])
        elif len(rows):
            low = x[rows, node[0]] <= node[1]
            walk(node[2], rows[low])
            walk(node[3], rows[~low])

    walk(tree, np.arange(len(x)))
    return out


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text, how many blocks it has, and how many the page has."""
    found = blocks(page or "")
    keep = classify(trained_tree(), features(found)) if found else []
    kept = [b.text for b, k in zip(found, keep, strict=True) if k]
    return "\n\n".join(kept), len(kept), len(found)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_blocks_seen): one row per page."""
    slim = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_blocks_seen"],
                )

    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks int, n_blocks_seen int")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

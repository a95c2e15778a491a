"""Main text of web pages by tree scoring.

A page becomes a tree with HTML's implied end tags. Every paragraph passes points, for
its length and its commas, to its container and, halved at each step, to all containers
above; a container's points are discounted by the share of its text that is links. The
container with the most points is the article, with its siblings that read like it; an
article or main element counts for a little more, and the one around the best container is
taken whole. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are cut out, told by element and role. Class names and ids are
hints: a name counts by its last part ("post-comments" are comments, "comments-open" and
"no-sidebar" are not), and a layout name never cuts what holds most of a page's points.

Defined results: null and empty pages, and pages without text, give ''. Of containers
with equal points the first in the page is taken; a page without paragraphs gives all that
isn't cut. Unclosed and crossed tags, unknown elements and broken references never fail;
all of a page is read, whatever its length, in time proportional to it.
Rows are independent of one another and only the named columns are read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm.bytewords import lean
from loomline.llm.spool import small_batches

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br-block button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSES_P = BLOCK - frozenset("button canvas iframe noscript object option optgroup select svg template textarea title td th tr tbody thead tfoot caption video audio head html body br-block".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

# What is not the article.
CUT_TAGS = frozenset("script style noscript template iframe svg object embed canvas nav aside footer form button input select textarea label fieldset dialog menu head title audio video map".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CUT_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner
    cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login
    menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager toc toolbar sidebar sidebars aside rail widget widgets
    related recommended recommendations teaser teasers share sharing social follow comment comments commentlist respond reply replies disqus discussion
    footer foot masthead topbar header search searchbox form hidden""".split())  # fmt: skip
#: These are never part of the article, however much text they hold.
CUT_ALWAYS = frozenset("comment comments commentlist reply replies respond disqus discussion ad ads advert adverts advertisement adsense sponsored".split())
#: Parts of a name that say where or what box, not what it holds, and first parts that deny the rest.
PLACES = frozenset("area bar block box btn button column col container content form group holder inner items item left link links list module outer panel posts articles stories primary right secondary section slot top bottom unit wrap wrapper zone".split())
DENIALS = frozenset("no has with without hide show is not".split())
#: These hold the article, whatever their class says of the layout.
KEPT = frozenset("html body main".split())
#: Not containers of their own: their points go to what holds them.
INNER = frozenset("p pre li ul ol dl dt dd blockquote figure figcaption td th tr tbody thead tfoot table h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an article or main element counts for more than another container.
NAMED_WEIGHT = 1.25

_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|--!>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""", re.S)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")  # a tag that the page ends in is no text
_ATTRS = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: How an element is left out.
STAYS, BY_NAME, ALWAYS, AT_ONCE = range(4)


def named(name: str) -> str | None:
    """The cut name that a class or an id comes to, by its last part that isn't a mere place."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    if not parts or parts[0] in DENIALS:
        return None
    while len(parts) > 1 and parts[-1] in PLACES:
        parts.pop()
    return parts[-1] if parts[-1] in CUT_NAMES else None


def _cut(tag: str, attrs: str, in_article: bool) -> int:
    """Whether this element and all in it is no part of an article."""
    if tag in CUT_TAGS or tag == "header" and not in_article:
        return AT_ONCE
    if not attrs or attrs.isspace():
        return STAYS
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRS.finditer(attrs)}
    if tag in KEPT:
        return STAYS
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("role", "").lower() in CUT_ROLES:
        return AT_ONCE
    names = {named(x) for x in f"{found.get('class', '')} {found.get('id', '')}".split()} - {None}
    if names & CUT_ALWAYS:
        return ALWAYS
    if tag == "header" or tag in HEADINGS or tag == "p":
        names -= {"header", "notice", "form"}
    return BY_NAME if names else STAYS


class _Page:
    """The tree: parent, tag and cut of each element, and the blocks of text in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.cut = [-1], ["html"], [STAYS]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters in links)
        self._text: list[tuple[str, bool]] = []
        self._stack, self._open_blocks = [0], [0]  # elements, and depths of the blocks among them
        self._depths: dict[str, list[int]] = {}  # of the open elements of each name
        self._cut_at: int | None = None  # depth of the element that is cut out at once with all in it
        at, last = 0, source.rfind(">")
        ends: dict[str, re.Pattern] = {}
        while at <= last and (m := _TAG.search(source, at)):
            self._say(source[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            name, attrs = name.lower(), m[4] if m[3] else m[7]
            if m[2] or m[5]:
                self._close(name)
            else:
                self._open(name, attrs)
                if name in RAW:
                    end = ends.setdefault(name, re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)).search(source, at)
                    at = end.end() if end else len(source)
                    self._close(name)
        self._say(_UNFINISHED.split(source[at:], maxsplit=1)[0])
        self._end_block()

    def _say(self, text: str) -> None:
        if text and self._cut_at is None:
            self._text.append((text, bool(self._depths.get("a"))))

    def _end_block(self) -> None:
        if not self._text:
            return
        pieces, self._text = self._text, []
        text = " ".join(html.unescape("".join(x for x, _ in pieces)).split())
        if text:
            link = sum(len(" ".join(html.unescape(x).split())) for x, a in pieces if a)
            self.blocks.append((self._stack[self._open_blocks[-1]], text, min(link, len(text))))

    def _deepest(self, names) -> int:
        """Depth of the innermost open element of these names, 0 if there is none."""
        return max((self._depths[x][-1] for x in names if self._depths.get(x)), default=0)

    def _open(self, name: str, attrs: str) -> None:
        if name == "br":
            self._say(" ")
            return
        if name == "hr":
            self._end_block()
        if name in VOID or name in ("html", "body"):
            return
        if name in CLOSES_P and self._deepest(("p",)) > self._deepest(("button", "td", "th")):
            self._close("p")
        if name in IMPLIED:
            ends, fence = IMPLIED[name]
            floor = self._deepest(fence) + 1
            inside = [open_[k] for x in ends if (open_ := self._depths.get(x)) and (k := bisect_left(open_, floor)) < len(open_)]
            if inside:
                self._pop(min(inside))
        if name in BLOCK:
            self._end_block()
        in_article = bool(self._depths.get("article"))
        self.parent.append(self._stack[-1])
        self.tag.append(name)
        depth = len(self._stack)
        self._stack.append(len(self.tag) - 1)
        self._depths.setdefault(name, []).append(depth)
        if name in BLOCK:
            self._open_blocks.append(depth)
        how = _cut(name, attrs, in_article) if self._cut_at is None else STAYS
        self.cut.append(how)
        if how == AT_ONCE:
            self._cut_at = depth

    def _close(self, name: str) -> None:
        open_ = self._depths.get(name)
        # an inline end tag closes nothing beyond its block
        if open_ and (name in BLOCK or name == "a" or open_[-1] > self._open_blocks[-1]):
            self._pop(open_[-1])

    def _pop(self, depth: int) -> None:
        """End the element at this depth and all that are open in it."""
        if self._open_blocks[-1] >= depth:
            self._end_block()
            del self._open_blocks[bisect_left(self._open_blocks, depth) :]
        for i in self._stack[depth:]:
            self._depths[self.tag[i]].pop()
        del self._stack[depth:]
        if self._cut_at is not None and depth <= self._cut_at:
            self._cut_at = None


def points_of(text: str, in_links: int) -> float:
    """What a paragraph is worth."""
    return 0.0 if len(text) < 25 else (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - in_links / len(text))


def left_out(page: _Page) -> list[bool]:
    """Elements that are cut, with all in them: by layout names only if they don't hold most of the page's points."""
    n = len(page.tag)
    inside, always = [0.0] * n, [False] * n
    for i in range(1, n):
        always[i] = always[page.parent[i]] or page.cut[i] == ALWAYS
    for element, text, in_links in page.blocks:
        if not always[element] and page.tag[element] not in HEADINGS:
            inside[element] += points_of(text, in_links)
    for i in range(n - 1, 0, -1):  # parents come before their children
        inside[page.parent[i]] += inside[i]
    out = [False] * n
    for i in range(1, n):
        out[i] = always[i] or out[page.parent[i]] or page.cut[i] == BY_NAME and 2 * inside[i] <= inside[0]
    return out


def main_text(source: str | None) -> str:
    """The blocks of the article, one a line."""
    if not source:
        return ""
    page = _Page(source)
    n, out = len(page.tag), left_out(page)
    blocks = [x for x in page.blocks if not out[x[0]]]
    points, length, link = [0.0] * n, [0] * n, [0] * n
    for element, text, in_links in blocks:
        length[element] += len(text)
        link[element] += in_links
        if page.tag[element] not in HEADINGS:
            points[element] += points_of(text, in_links)
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        points[up] += points[i] * (1.0 if page.tag[i] in INNER else 0.5)
        length[up] += length[i]
        link[up] += link[i]
    worth = [0.0 if page.tag[i] in INNER or not length[i] else points[i] * (1 - link[i] / length[i]) * (NAMED_WEIGHT if page.tag[i] in ("article", "main") else 1) for i in range(n)]
    best = max(range(n), key=lambda i: (worth[i], -i))
    kept = {0}
    if worth[best] > 0:
        up = best
        while up > 0 and page.tag[up] not in ("article", "main"):
            up = page.parent[up]
        best = up or best
        kept = {best}
        titles = [0] * n  # characters in headings
        for element, text, _ in blocks:
            if page.tag[element] in HEADINGS:
                titles[element] += len(text)
        for i in range(n - 1, 0, -1):
            titles[page.parent[i]] += titles[i]
        for i in range(1, n):  # siblings that read like the best container, and titles before it
            if page.parent[i] == page.parent[best] and i != best and length[i] and link[i] < 0.25 * length[i]:
                reads = points[i] if page.tag[i] in INNER else worth[i]
                if reads >= worth[best] / 5 or page.tag[i] == "p" and length[i] > 80 or i < best and titles[i] == length[i]:
                    kept.add(i)
    elif any(t in ("article", "main") for t in page.tag):
        kept = {page.tag.index("article") if "article" in page.tag else page.tag.index("main")}
    inside = [False] * n
    for i in range(n):
        inside[i] = i in kept or i > 0 and inside[page.parent[i]]
    return "\n".join(text for element, text, _ in blocks if inside[element])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    shown = pages.select(pages[id_col], pages[url_col], pages[html_col].cast("string").alias("_html"))
    small_batches(pages.sparkSession)
    return shown.mapInArrow(lean(run), f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")

"""Main text of web pages by tree scoring.

A page becomes a tree. Parts that are never article (menus, footers, forms,
what its class names call an advert, a notice, a comment and so on) are set
aside. Every paragraph then has points for its length and its commas, less its
share of linked characters, and passes them to its ancestors, the nearer the
more. The container of most points, less its own share of links, is kept with
those of its siblings that read like it. Each page is handled by itself in time
linear in its length, with stacks instead of recursion; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

# Elements of the HTML standard, and names by which sites call parts of a page (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li listing main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul xmp".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("br body button caption dd dt head html legend li optgroup option select tbody td textarea tfoot th thead title tr".split())
#: Elements beyond which a start tag ends none, nor an end tag but that of a table's parts.
SCOPE = frozenset("applet body button caption html marquee object table td template th".split())
LISTS = frozenset("dir dl menu ol ul".split())
TABLE = frozenset("caption table tbody td tfoot th thead tr".split())
#: What a start tag ends, if open in the same list or table.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), **dict.fromkeys(("tbody", "tfoot", "thead"), ("tbody", "tfoot", "thead"))}
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Blocks that are paragraphs by themselves; text in any other lies in a container.
PARAGRAPHS = frozenset("address blockquote caption dd dt figcaption legend li option p pre summary td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without text of the page.
NEVER = frozenset("applet audio canvas datalist embed head iframe map noembed noframes noscript object picture script style svg template title video xmp".split())
ASIDE = frozenset("aside button dialog fieldset footer form input label legend menu nav optgroup option search select textarea".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split())
NAMES = re.compile(
    r"ads?|advert\w*|adsense|adslot|adbox|adunit|adsby\w*|banners?|billboard|sponsors?|sponsored|promos?|promoted|promotions?|outbrain|taboola"
    r"|sidebars?|aside|rail|nav\w*|topnav|subnav|menus?|mainmenu|submenu|breadcrumbs?|crumbs?|pagination|pager|toc|toolbar|topbar|footers?|colophon|skip"
    r"|comments?|commentlist|commenting|disqus|livefyre|respond|responses?|repl(?:y|ies)|discussion|feedback"
    r"|cookies?|cookiebar|consent|gdpr|notices?|alerts?|popups?|modal|overlay|lightbox|toast|paywall|disclaimers?|copyright|legal"
    r"|newsletters?|subscribe|subscription|signup|signin|login|register|forms?|search\w*|shar(?:e|ing)|sharebar|social|follow|related|recommended|recommendations?|teasers?|hidden"
)
HEADER = re.compile("header|masthead")
#: First parts of names that say something else about an element.
ABOUT = frozenset("category format has is no post status tag type with without".split())
GOOD = re.compile(r"article\w*|blog|body|content|entry|hentry|main|post|story|text")
POINTS = {"article": 25, "main": 15, "div": 5, "section": 3, "blockquote": 3, "pre": 3, "td": 3, "address": -3, "dd": -3, "dl": -3, "dt": -3, "form": -3, "li": -3, "ol": -3, "ul": -3}
COMMAS = re.compile("[,،﹐︐︑⸁⸲，、]")

#: How much of a paragraph's points its parent, grandparent and so on receive.
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12)
#: Length in characters that makes a paragraph of a block, and that adds a point, up to three of these.
LEAST_CHARS, POINT_CHARS, MOST_POINTS = 25, 100, 3.0
#: Part of the best container's points with which a sibling is kept, and the share of links up to which a block may be text.
SIBLING, LINKED = 0.2, 0.25

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+""")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Page:
    """The tree of a page: parallel lists, parents before children, and text in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names = ["#page"], [0], [""]
        #: Whether an element never holds text, is set aside, or is some header.
        self.never, self.aside, self.header = [False], [False], [False]
        #: Pieces of text, each with its element; a None is the edge of a block.
        self.pieces: list[tuple[int, str | None]] = []
        self._open = [0]
        #: How often each tag is open since the last element that closed tags can't leave, since the last list, the last block, and ever.
        self._since: tuple = tuple((edges, [{}]) for edges in (SCOPE, SCOPE | LISTS, BLOCK, frozenset()))
        self._read(source)

    def _read(self, s: str) -> None:
        pos, n = 0, len(s)
        while pos < n:
            at = s.find("<", pos)
            if at < 0:
                at = n
            if at > pos:
                self._text(s[pos:at])
            if at == n:
                return
            m = _TAG.match(s, at)
            if m:
                end = _REST.match(s, m.end()).end()
                if end >= n:
                    return
                pos, tag = end + 1, m[2].lower()
                if m[1]:
                    self._end(tag)
                    continue
                self._start(tag, s[m.end() : end])
                if tag in RAW:
                    close = _RAW_END[tag].search(s, pos)
                    pos = close.start() if close else n
                elif tag == "plaintext":
                    self._text(s[pos:])
                    return
            elif s.startswith("<!--", at):
                if s.startswith((">", "->"), at + 4):
                    pos = s.index(">", at) + 1
                else:
                    end = s.find("-->", at + 4)
                    pos = end + 3 if end >= 0 else n
            elif s.startswith(("<!", "<?", "</"), at):
                end = s.find(">", at)
                pos = end + 1 if end >= 0 else n
            else:
                self._text("<")
                pos = at + 1

    def _held(self, level: int, tag: str) -> int:
        return self._since[level][1][-1].get(tag, 0)

    def _text(self, raw: str) -> None:
        if self.tag[self._open[-1]] == "head" and not raw.isspace():
            self._pop()
        self.pieces.append((self._open[-1], html.unescape(raw) if "&" in raw else raw))

    def _pop(self) -> None:
        tag = self.tag[self._open.pop()]
        for edges, held in self._since:
            if tag in edges:
                held.pop()
            held[-1][tag] -= 1
        if tag in BLOCK:
            self.pieces.append((self._open[-1], None))

    def _pop_through(self, tags: tuple) -> None:
        while self.tag[self._open[-1]] not in tags:
            self._pop()
        self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self._held(3, tag):
            return
        if tag not in IN_HEAD and self._held(3, "head"):
            self._pop_through(("head",))
        if tag in ENDS_P and self._held(0, "p"):
            self._pop_through(("p",))
        if tag in ENDS and (self._in_table(ENDS[tag]) if tag in TABLE else any(self._held(1, t) for t in ENDS[tag])):
            self._pop_through(ENDS[tag])
        if tag in HEADINGS and self.tag[self._open[-1]] in HEADINGS:
            self._pop()
        up = self._open[-1]
        if tag in BLOCK:
            self.pieces.append((up, None))
        aside, header, names = self._judged(tag, attributes)
        self.tag.append(tag)
        self.parent.append(up)
        self.names.append(names)
        self.aside.append(aside)
        self.header.append(header)
        self.never.append(tag in NEVER or self.never[up])
        if tag in VOID:
            return
        for edges, held in self._since:
            held[-1][tag] = held[-1].get(tag, 0) + 1
            if tag in edges:
                held.append({})
        self._open.append(len(self.tag) - 1)

    def _in_table(self, tags: tuple) -> bool:
        """Whether one of these is open in the innermost table."""
        for node in reversed(self._open):
            if self.tag[node] in tags:
                return True
            if self.tag[node] in ("table", "body"):
                return False
        return False

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in TABLE or tag in SCOPE:
            held = self._held(3, tag)
        else:  # an inline element ends only if no block is open in it
            held = self._held(0 if tag in BLOCK else 2, tag)
        if held:
            self._pop_through((tag,))

    def _judged(self, tag: str, attributes: str) -> tuple[bool, bool, str]:
        """Whether an element is set aside, whether it is some header, and its names."""
        aside, header, names = tag in ASIDE, tag == "header", ""
        if attributes and tag != "a" and not attributes.isspace():
            found: dict[str, str] = {}
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            names, role, style = f"{found.get('class', '')} {found.get('id', '')}", found.get("role", "").lower(), found.get("style", "").replace(" ", "").lower()
            if role == "main" or found.get("itemprop", "") == "articleBody":
                names += " main"
            aside = aside or "hidden" in found or "display:none" in style or "visibility:hidden" in style or role in ROLES
            if tag not in ("html", "body", "main"):
                named, headed = _named(names, tag)
                aside, header = aside or named, header or headed
        return aside, header, names


def _named(names: str, tag: str) -> tuple[bool, bool]:
    """Whether an element's class names or id call it something other than article, and whether they call it a header."""
    aside = header = False
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and (parts[0] not in ABOUT or (parts[0] == "post" and tag != "article")):
            aside = aside or any(NAMES.fullmatch(p) for p in (parts[:1] if tag == "article" else parts))
            header = header or (tag != "article" and any(HEADER.fullmatch(p) for p in parts))
    return aside, header


def main_text(source: str) -> str:
    """The article of a page: blocks in page order, white space and edges of blocks as one space."""
    page = Page(source)
    for aside in (True, False):  # a page that is all form or all comment has its text there
        kept = _kept(page, aside)
        if kept is not None:
            break
    else:
        return ""
    return " ".join("".join(" " if t is None else t for node, t in page.pieces if t is None or kept[node]).split())


def _below(parent: list[int], top: int) -> Iterator[int]:
    """The elements below one, which follow it."""
    below = {top}
    for i in range(top + 1, len(parent)):
        if parent[i] in below:
            below.add(i)
            yield i


def _kept(page: Page, set_aside: bool) -> list[bool] | None:
    """For each element whether its own text is kept; None if no text is left."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    holds, inside = [t in ("h1", "main") for t in tag], [False] * n
    for i in range(n - 1, 0, -1):
        holds[parent[i]] = holds[parent[i]] or holds[i]
    out = page.never[:]
    for i in range(1, n):
        up = parent[i]
        inside[i] = inside[up] or tag[i] in ("article", "main")
        # an article's own header stays, as do wrappers around it whatever their names
        aside = (page.aside[i] and (tag[i] in ASIDE or inside[up] or not holds[i])) or (page.header[i] and not inside[up] and not (tag[i] != "header" and holds[i]))
        out[i] = out[i] or out[up] or (aside and set_aside)

    block, linked = list(range(n)), [False] * n
    for i in range(1, n):
        linked[i] = tag[i] == "a" or linked[parent[i]]
        if tag[i] not in BLOCK:
            block[i] = block[parent[i]]
    chars, links, commas = [0] * n, [0] * n, [0] * n
    for node, text in page.pieces:
        if text is not None and not out[node]:
            k = len(" ".join(text.split()))
            b = block[node]
            chars[b] += k
            links[b] += k if linked[node] else 0
            commas[b] += len(COMMAS.findall(text))
    score = [0.0] * n
    for i in range(n):
        if chars[i] and tag[i] not in HEADINGS:
            points = (chars[i] >= LEAST_CHARS) + commas[i] + min(chars[i] / POINT_CHARS, MOST_POINTS)
            points *= 1 - links[i] / chars[i]
            up = parent[i] if tag[i] in PARAGRAPHS else i
            for share in SHARES:
                score[up] += points * share
                if up == 0:
                    break
                up = parent[up]
    whole, whole_links = chars[:], links[:]
    for i in range(n - 1, 0, -1):
        whole[parent[i]] += whole[i]
        whole_links[parent[i]] += whole_links[i]
    if not whole[0]:
        return None

    def total(i: int) -> float:
        if out[i] or not whole[i] or (score[i] <= 0 and i):
            return 0.0
        good = 25 if any(GOOD.fullmatch(p.lower()) for name in page.names[i].split() for p in _PARTS.findall(name)[-1:]) else 0
        return max(score[i] + (POINTS.get(tag[i], 0) + good) * (score[i] > 0), 0.0) * (1 - whole_links[i] / whole[i])

    totals = [total(i) for i in range(n)]
    best = max(range(n), key=lambda i: (totals[i], -i))
    most = totals[best]
    up = best
    while up and tag[up] not in ("article", "main"):
        up = parent[up]
    if up:  # the whole of what the page itself calls its article
        best = up
    keep = [False] * n
    keep[best] = True
    if best:
        name = page.names[best].split()
        titled = any(tag[i] == "h1" and not out[i] for i in _below(parent, best))
        for i in range(parent[best] + 1, n):
            if parent[i] != parent[best] or i == best or out[i] or not whole[i]:
                continue
            alike = totals[i] >= SIBLING * most or (name and tag[i] == tag[best] and page.names[i].split() == name and totals[i] > 0)
            plain = (tag[i] in HEADINGS and not titled) or (not up and tag[i] in ("p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure"))
            keep[i] = whole_links[i] / whole[i] < LINKED and (alike or plain)
    for i in range(1, n):
        keep[i] = keep[i] or keep[parent[i]]
    return [k and not o for k, o in zip(keep, out, strict=True)]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every whole page; text is its article, empty if there is none, n_chars its code points.

    A null page, an empty one and one of markup alone have an empty text. Null
    ids and urls stay null, repeated rows give repeated rows, an empty table an
    empty one; other columns are ignored whatever they are called. Of equally
    good containers the first in the page is kept. Broken and unclosed markup
    is read as browsers do in the main.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = texts_of(b.column(2))
            for x, y in slices(sources):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array(map(main_text, sources[x:y]), pa.string())], ["page_id", "url", "text"])

    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))

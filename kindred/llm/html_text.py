"""Main text of HTML pages by tree scoring.

A page becomes a flat list of nodes (parents before children) and a list of text blocks. What cannot be
article text is left out first: scripts, menus, headers, footers, asides, forms, hidden parts, and elements whose
role, or a class or id as a whole, names an advert, a notice, reader comments or the like, unless nearly all of the
page's text is in such elements. Then each block passes points for length and commas to its ancestors, less with each level
and through elements whose class or id has such a word in it; a node's points are discounted by its share of
linked text, and raised where its class or id is a good name. The best container, the article element around it, if any,
and those siblings that score well beside it are kept, in page order.

Null and empty pages have no text; repeated rows are read one by one; very long and deeply nested pages are read
whole, in one pass and without recursion; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of HTML elements and the words by which page parts are called.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = frozenset("head script style title noscript template nav footer aside form button select option textarea iframe object svg canvas dialog menu audio video math xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl article section div main body html td th blockquote".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead comment comments disqus respond reply replies discussion feedback cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations widget toolbar pagination pager skip copyright hidden paywall outbrain taboola".split()
)
GOOD_WORDS = frozenset("article content main post entry story body text".split())
ALWAYS_BAD = frozenset("ad ads advert adverts advertisement comment comments disqus sponsored cookie sidebar footer nav navigation menu breadcrumb breadcrumbs newsletter share sharing related".split())
#: Words that leave a bad name what it is: "site-footer", "comments-area".
PART_WORDS = frozenset("site page area list section box container wrapper wrap block item items inner outer left right top bottom primary secondary col column unit slot bar group row zone".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: A quote opens a value right after "=" only; elsewhere, as in href=/o'brien, it is a character like others.
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
#: Commas of Latin, Chinese, Japanese and Arabic script.
_COMMA = re.compile("[,\uff0c\u3001\u060c]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KEPT_ALWAYS = frozenset("html body main article".split())


#: What attributes say of an element, and the share of a block's points that goes through it.
GONE, NAMED, HINTED, PLAIN, LIKED = 3, 2, 1, 0, -1
SHARE = {GONE: 0.0, NAMED: 0.25, HINTED: 0.5, PLAIN: 1.0, LIKED: 1.0}
#: By how much a good name raises a container's points, and the text outside of named elements for which they go: characters, share.
RAISED, ENOUGH = 1.3, (60, 0.1)


def _named(token: str) -> bool:
    """Is the class or id as a whole the name of a part that is no article text: "share", "site-footer", "promotion-story", "post-comments"."""
    words = [w.lower() for w in _WORD.findall(token) if len(w) > 1]
    if not any(w in BAD_WORDS for w in words) or not all(w in BAD_WORDS or w in PART_WORDS or w in GOOD_WORDS for w in words):
        return False
    return not any(w in GOOD_WORDS for w in words) or words[0] in BAD_WORDS or words[-1] in ALWAYS_BAD


def _unwanted(tag: str, attributes: str) -> int:
    """GONE: hidden, or by its role; NAMED: a class or id is a bad name; HINTED: a bad word is in one; LIKED: a good name; PLAIN."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if not found:
        return PLAIN
    if "hidden" in found and found["hidden"].lower() != "until-found" or found.get("aria-hidden", "").lower() == "true":
        return GONE
    if found.get("role", "").lower().strip() in BAD_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return GONE
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in _WORD.findall(names)}
    if tag in ("html", "body", "main"):
        return PLAIN
    if not words & BAD_WORDS:
        return LIKED if words & GOOD_WORDS else PLAIN
    if tag == "article" and not words & {"comment", "comments", "ad", "ads", "advert", "sponsored"}:
        return PLAIN
    return NAMED if any(_named(t) for t in names.split()) else HINTED


class Page:
    """Nodes and text blocks of one page."""

    def __init__(self, html: str):
        self.tag, self.parent, self.drop, self.said = ["#"], [0], [False], [PLAIN]
        self.blocks: list[tuple[int, str]] = []
        self.linked: list[int] = []
        self._stack, self._open, self._run, self._links = [0], Counter(), [], 0
        self._read(html)
        self._flush()

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                node = next(n for n in reversed(self._stack) if self.tag[n] not in INLINE)
                self.blocks.append((node, text))
                self.linked.append(min(self._links, len(text)))
            self._run, self._links = [], 0

    def _pop_to(self, depth: int) -> None:
        for n in self._stack[depth:]:
            self._open[self.tag[n]] -= 1
            if self.tag[n] not in INLINE:
                self._flush()
        del self._stack[depth:]

    def _close(self, tags: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        """Ends the innermost open element of these tags and all in it, unless an element of ``scope`` is in between."""
        if not any(self._open[t] for t in tags):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in tags:
                if tag not in INLINE:
                    self._flush()
                return self._pop_to(depth)
            if tag in scope:
                return None
        return None

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                break
            if lt > at:
                self._text(html[at:lt])
            m = _TAG.match(html, lt)
            if not m:
                self._text("<")
                at = lt + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "p" and not self._open["p"]:
                    self._flush()
                elif tag == "br":
                    self._run.append(" ")
                elif self._open[tag]:
                    self._close({tag}, frozenset() if tag in SCOPE else frozenset(("table", "td", "th", "article", "body")))
                continue
            if tag in RAW:
                self._flush() if tag not in INLINE else None
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if tag == "br":
                self._run.append(" ")
                continue
            if tag in CLOSES_P and self._open["p"]:
                self._close({"p"}, frozenset(("table", "td", "th", "button", "article", "section", "div")))
            if tag in CLOSED_BY_LIKE:
                while any(self._open[t] for t in CLOSED_BY_LIKE[tag]):
                    before = len(self._stack)
                    self._close(CLOSED_BY_LIKE[tag], frozenset(("ul", "ol", "dl", "table", "select")))
                    if len(self._stack) == before:
                        break
            if tag == "a" and self._open["a"]:
                self._close({"a"}, frozenset(("table", "td", "th")))
            if tag not in INLINE:
                self._flush()
            if tag in VOID:
                continue
            self.tag.append(tag)
            self.parent.append(self._stack[-1])
            self.said.append(_unwanted(tag, m[3]))
            self.drop.append(tag in DROPPED or tag == "header" and not (self._open["article"] or self._open["main"]) or self.said[-1] == GONE)
            if m[3].endswith("/") and tag not in INLINE and tag in ("svg", "path", "use"):
                continue
            self._stack.append(len(self.tag) - 1)
            self._open[tag] += 1

    def _text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        if self._open["a"]:
            self._links += len(text)
        self._run.append(text)


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line; empty if there is none."""
    if not html:
        return ""
    page = Page(html)
    n = len(page.tag)
    gone, said = page.drop, page.said
    for i in range(1, n):
        gone[i] = gone[i] or gone[page.parent[i]]
    if NAMED in said:
        held, inside, outside = [0] * n, [False] * n, 0
        for i in range(1, n):
            inside[i] = inside[page.parent[i]] or said[i] == NAMED
        for node, text in page.blocks:
            held[node] += 0 if gone[node] else len(text)
            outside += 0 if gone[node] or inside[node] else len(text)
        for i in range(n - 1, 0, -1):
            held[page.parent[i]] += held[i]
        enough = outside >= max(ENOUGH[0], ENOUGH[1] * held[0])
        for i in range(1, n):
            gone[i] = gone[i] or gone[page.parent[i]] or said[i] == NAMED and (enough or 2 * held[i] <= held[0])
    blocks = [(node, text, linked) for (node, text), linked in zip(page.blocks, page.linked, strict=True) if not gone[node]]
    # of a header inside the article only the headings are its text
    in_header = [t == "header" for t in page.tag]
    for i in range(1, n):
        in_header[i] = in_header[i] or in_header[page.parent[i]]
    blocks = [b for b in blocks if not in_header[b[0]] or page.tag[b[0]] in ("h1", "h2", "h3", "h4", "h5", "h6")]
    if not blocks:
        return ""
    points, length, links, many = [0.0] * n, [0] * n, [0] * n, [0] * n
    for node, text, linked in blocks:
        length[node] += len(text)
        links[node] += linked
        many[node] += linked > 0
        own = 1 + min(len(text) / 100, 3) + len(_COMMA.findall(text))
        up, share = node if page.tag[node] in ("div", "article", "section", "main", "td", "body") else page.parent[node], 1.0
        if up != node:
            own *= SHARE[said[node]]
        for level in range(5):
            own *= SHARE[said[up]]
            points[up] += own * share
            if not up:
                break
            up, share = page.parent[up], (0.5, 0.33, 0.2, 0.1, 0.1)[level]
    for i in range(n - 1, 0, -1):
        for counts in (length, links, many):
            counts[page.parent[i]] += counts[i]
    density = [links[i] / length[i] if length[i] else 0.0 for i in range(n)]
    score = [points[i] * (1 - density[i]) * (RAISED if said[i] == LIKED else 1) for i in range(n)]
    best = max(range(n), key=lambda i: (score[i], -i))
    # the score finds the article; the element (or main) around its best container holds the rest of it
    up = best
    while up and page.tag[up] not in ("article", "main"):
        up = page.parent[up]
    if up:
        best = up
    chosen = {best}
    if best and page.tag[best] not in ("body", "html", "main"):
        for i in range(1, n):
            if page.parent[i] == page.parent[best] and i != best and not gone[i]:
                words = page.tag[i] == page.tag[best] or page.tag[i] in ("p", "pre", "blockquote", "h1", "h2", "h3", "section", "div", "table", "ul", "ol")
                if words and (score[i] >= max(2.5, 0.25 * score[best]) and density[i] < 0.5 or page.tag[i] in ("p", "pre", "blockquote") and length[i] > 80 and density[i] < 0.25):
                    chosen.add(i)
    # outside of an article element, what is nearly all links is a menu
    kept, own = [False] * n, [False] * n
    for i in range(n):
        own[i] = page.tag[i] in ("article", "main") or i > 0 and own[page.parent[i]]
        lists = not own[i] and page.tag[i] in ("ul", "ol", "div", "section", "table") and many[i] >= 3 and density[i] > 0.6
        kept[i] = (i in chosen or i > 0 and kept[page.parent[i]]) and not lists
    return "\n\n".join(text for node, text, _ in blocks if kept[node])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row per row of ``pages``; null html is empty, null ids and urls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

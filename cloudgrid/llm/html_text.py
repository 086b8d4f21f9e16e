"""Main text of HTML pages by composite text density.

A page becomes a DOM tree in one pass (void elements, implied end tags, raw-text elements, broken markup).  What is shown to nobody as text
(scripts, styles, controls, hidden elements) is left out with all it holds, and so are blocks that no density can tell from an article, as they
are plain text too: footers, page headers, side bars, forms, notices, adverts, reader comments.  They are told by element, role or a class or id that names
nothing else, and only where they hold no article, main or h1 element; a form that holds most of the page's running text is none either.

Every other node has a density: its characters per tag, adjusted by its share of link characters and link tags.  A node's density sum adds up
its children's; the node of the largest sum is the core of the text.  The least density on the path from it to the body is the threshold.  Of what
stands beside that path (menus, lists of links, teasers and further parts of the text) these belong to the text, if less than half of them is links:

* within an article element, what reaches an eighth of the threshold, and running text (paragraphs, headings) at any density;
* elsewhere, what reaches the threshold and holds a ``LEAST`` of the core's characters, and first and second headings before the core;
* of a path node's own words, runs between blocks with the inline elements in them: of ``WORDS`` or more words or a sentence of ``SENTENCE``, and within an article element any.

From all that is chosen, blocks that are half links or more and stay below the threshold are left out, but for headings.

Text: character references decoded, white space (also between inline parts) one space within a block, blocks in page order joined by one
space.  Defined cases: null or empty html, or a page of nothing but boilerplate, gives an empty text; ties go to the earlier node; nesting
may be of any depth; pages of one id, or without one, are answered each.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_arrow, unused, with_fields

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
#: longer decimal references are no character, and more digits than Python reads
_LONG_REFERENCE = re.compile(r"&#0*[0-9]{8,};?")
_ATTR = re.compile(r"""\b(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VALUES = re.compile(r"""(?<!aria-hidden)\s*=\s*(?:"[^"]*"|'[^']*')""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: never text that is read
UNSEEN = frozenset("head script style noscript template iframe svg canvas object embed button label select option textarea input dialog title audio video map applet".split())
#: text, but by its element, role or name not the article's
ASIDE = frozenset("header footer aside form".split())
ASIDE_ROLES = frozenset("banner contentinfo complementary search dialog alert alertdialog toolbar form".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner comment comments commentlist disqus consent cookie cookies copyright cta disclaimer footer form gdpr header login masthead modal newsletter notice notices popup promo promoted promotion replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: parts of names that say where or how, not what
NEUTRAL = frozenset("area bar block bottom box container footer global group header inner item items left list main message outer page panel post reader right section site text top user wrap wrapper".split())
KEPT = frozenset(("html", "body", "article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The share of the core's characters that a block beside the path needs outside article elements, and the words of a path node's own text.
LEAST, WORDS = 0.1, 8
#: Fewer words do, where they end as a sentence does.
SENTENCE = 5
#: The share of the threshold that nodes within an article element must reach.
ARTICLE = 1 / 8
#: Elements of running text: within an article they need not reach it, as a short sentence never would.
PROSE = HEADINGS | frozenset("p pre blockquote".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_P_CLOSERS = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
_WALLS = frozenset(("table", "td", "th", "body", "html", "article", "section", "div", "blockquote"))


def _named(value: str) -> bool:
    """Whether a class or id names boilerplate: one of its words does, whole or beside parts that say nothing else."""
    for word in value.split():
        parts = [x for x in re.split(r"[_\-]+", word) if x]
        if not ASIDE_NAMES.isdisjoint(parts) and all(x in ASIDE_NAMES or x in NEUTRAL or x.isdigit() for x in parts):
            return True
    return False


def _kind(tag: str, attrs: str) -> int:
    """0: text, 1: beside the article if it holds none, 2: not seen."""
    if tag in UNSEEN:
        return 2
    kind = int(tag in ASIDE)
    if not attrs or tag in KEPT:
        return kind
    attrs = " ".join(attrs.split())
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = (a or b or c).lower(), name.lower()
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return 2
        elif value in ASIDE_ROLES if name == "role" else tag not in HEADINGS and _named(value):
            kind = 1
    return 2 if _HIDDEN.search(_VALUES.sub("", attrs)) else kind


def _decoded(text: str) -> str:
    """Character references decoded."""
    if "&#" in text and _LONG_REFERENCE.search(text):
        text = _LONG_REFERENCE.sub(lambda m: m[0] if len(m[0].lstrip("&#0")) < 9 else "\ufffd", text)
        text = re.sub(r"&#0+(?=[0-9])", "&#", text)
    return _html.unescape(text)


def tokens(source: str):
    """(text before, name, whether it closes, attributes) of each tag, comment or declaration (name None), and of what is left.

    One pass from left to right: a tag ends at its first ``>`` outside quotes, or if its quotes don't close, at its first ``>``; a ``<``
    that begins none of these, or a tag that never ends, is text.  Where a search within quotes ran to the end of the page is
    remembered, so later ones don't go the same way again, and the time is in proportion to the page, however broken it is.
    """
    at = seek = 0
    lost: set[int] = set()

    def end_of(begin: int, first: int) -> int:
        here, passed = begin, []
        while (m := _STOP.search(source, here)) is not None:
            if m[0] == ">":
                return m.start()
            here = source.find(m[0], m.end()) + 1
            if not here or here in lost:
                break
            passed.append(here)
        lost.update(passed)
        return first

    while (lt := source.find("<", seek)) >= 0:
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            stop, name, closing, attrs = (len(source) if end < 0 else end + 3), None, "", ""
        elif source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            stop, name, closing, attrs = (len(source) if end < 0 else end + 1), None, "", ""
        elif (m := _NAME.match(source, lt + 1)) is None:
            seek = lt + 1
            continue
        else:
            first = source.find(">", m.end())
            if first < 0:  # no tag ends any more, but comments may
                rest = re.compile(r"<[!?]").search(source, lt + 1)
                if rest is None:
                    break
                seek = rest.start()
                continue
            end = end_of(m.end(), first)
            stop, closing, name, attrs = end + 1, m[1], m[2].lower(), source[m.end() : end]
        yield source[at:lt], name, closing, attrs
        if name in RAW and not closing:
            out = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, stop)
            end = source.find(">", out.end()) if out else -1
            stop = len(source) if end < 0 else end + 1
        at = seek = stop
    yield source[at:], None, "", ""


class Open:
    """The elements that are open: what is asked for is found by its name, without a walk down the stack."""

    def __init__(self):
        self.stack: list[tuple[int, str, bool]] = []  # (node, tag, kept)
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.push(0, "#root", True)

    def push(self, node: int, tag: str, kept: bool):
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((node, tag, kept))

    def cut(self, k: int):
        """Closes the k-th element and all within it."""
        while len(self.stack) > k:
            tag = self.stack.pop()[1]
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of these names, -1 without any."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


class Page:
    """The kept nodes of a page in document order, and what stands in them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.aside, self.events = ["#root"], [-1], [False], []
        open_ = Open()
        for text, tag, closing, attrs in tokens(source):
            node, _, inside = open_.stack[-1]
            if text and inside:
                self.events.append((node, _decoded(text)))
            if not tag:
                continue
            if closing:
                self._close(open_, tag)
                continue
            self._imply(open_, tag)
            kind = _kind(tag, attrs)
            node, _, inside = open_.stack[-1]
            kept = inside and kind < 2
            if kept:
                self.tag.append(tag)
                self.parent.append(node)
                self.aside.append(kind == 1)
                node = len(self.tag) - 1
                self.events.append((node, None))
            if tag not in RAW and (tag not in VOID and not attrs.endswith("/") or tag in ("p", "div", "span", "a", "b", "i")):
                open_.push(node, tag, kept)
        self._leave_out_asides()

    def _leave_out_asides(self):
        """Marks what lies in boilerplate; an element that holds an article, main or h1 element is none, nor is a form that most of the page's running text stands in."""
        n = len(self.tag)
        holds = [t in ("article", "main", "h1") for t in self.tag]
        prose, link = [0] * n, [False] * n
        for i in range(1, n):
            link[i] = self.tag[i] == "a" or link[self.parent[i]]
        words = [0] * n  # of running text: paragraphs of WORDS or more
        for i, t in self.events:
            if isinstance(t, str) and not link[i]:
                words[i] += len(t.split())
        for i in range(n - 1, 0, -1):
            if self.tag[i] in INLINE:
                words[self.parent[i]] += words[i]
            elif self.tag[i] in PROSE and words[i] >= WORDS:
                prose[i] += words[i]
            prose[self.parent[i]] += prose[i]
            holds[self.parent[i]] |= holds[i]
        for i in range(1, n):
            article = holds[i] or self.tag[i] == "form" and 2 * prose[i] > prose[0]
            self.aside[i] = self.aside[self.parent[i]] or self.aside[i] and not article
        self.events = [(i, t) for i, t in self.events if not (self.aside[i] and isinstance(t, str))]

    def _close(self, open_: Open, tag: str):
        k = open_.last((tag,))
        if k < 1 or tag in INLINE and open_.blocks[-1] > k:
            return
        node, _, kept = open_.stack[k]
        if kept:
            self.events.append((self.parent[node], node))
        open_.cut(k)

    def _imply(self, open_: Open, tag: str):
        if tag in _P_CLOSERS and open_.stack[open_.blocks[-1]][1] == "p":
            open_.cut(open_.blocks[-1])
        if tag in _CLOSES:
            ends = _CLOSES[tag]
            stops = _STOPS.get(tag, ("table",)) + (tuple(_WALLS - {"div", "section"}) if tag in ("li", "dt", "dd") else ())
            while (k := open_.last(ends)) >= 1 and k >= open_.last(stops):
                open_.cut(k)
                if tag not in ("tr", "tbody", "tfoot", "thead"):
                    break

    def measure(self):
        """(density, density sum, link characters, characters) of all nodes."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        inside = [False] * n
        for i in range(1, n):
            inside[i] = self.tag[i] == "a" or inside[self.parent[i]]
        for node, text in self.events:
            if isinstance(text, str):
                c = len("".join(text.split()))
                chars[node] += c
                if inside[node]:
                    links[node] += c
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        share = links[0] / max(chars[0], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            c, lc, t, lt = chars[i], links[i], max(tags[i], 1), max(link_tags[i], 1)
            if c:
                base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
                ratio = max(c / max(lc, 1) * t / lt, 1.0)
                density[i] = c / t * math.log(ratio) / max(math.log(base), 1e-6)
            total[self.parent[i]] += density[i]
        return density, total, links, chars

    def _runs(self, on: set[int], core: int, inside: list[bool], article: list[bool]) -> set[int]:
        """The events that are path nodes' own words: runs of text and inline elements between blocks, that aren't links by half, of WORDS words or within an article element."""
        host = [-1] * len(self.tag)
        for i in range(len(host)):
            if i in on:
                host[i] = i if i != core else -1
            elif i and self.tag[i] in INLINE:
                host[i] = host[self.parent[i]]
        chosen: set[int] = set()
        run, of = [], -1

        def end():
            texts = [(self.events[e][1], inside[self.events[e][0]]) for e in run]
            size, linked = sum(len("".join(t.split())) for t, _ in texts), sum(len("".join(t.split())) for t, a in texts if a)
            words = "".join(t for t, _ in texts).split()
            sentence = len(words) >= SENTENCE and words[-1][-1] in ".!?\u2026\u3002"
            if 2 * linked < size and (article[of] or len(words) >= WORDS or sentence):
                chosen.update(run)
            run.clear()

        for e, (node, text) in enumerate(self.events):
            if isinstance(text, str):
                if run and host[node] != of:
                    end()
                if host[node] >= 0:
                    of = host[node]
                    run.append(e)
            elif run and self.tag[node if text is None else text] not in INLINE | {"br"}:
                end()
        if run:
            end()
        return chosen

    def content(self) -> tuple[list[bool], set[int]]:
        """(which nodes make up the article, which events of path nodes' own words do)."""
        density, total, links, chars = self.measure()
        n = len(self.tag)
        if n == 1 or not chars[0]:
            return [chars[0] > 0] * n, set()
        core = max(range(n), key=lambda i: (total[i], -i))
        if not total[core]:
            return [True] * n, set()
        path = [core]
        while path[-1]:
            path.append(self.parent[path[-1]])
        body = next((k for k, i in enumerate(path) if self.tag[i] == "body"), len(path) - 1)
        path = path[: body + 1]
        least = min((density[i] for i in path if i), default=0.0)
        on, out = set(path), {core}
        article, inside = [False] * n, [False] * n
        for i in range(1, n):
            article[i] = article[self.parent[i]] or self.tag[i] == "article"
            inside[i] = inside[self.parent[i]] or self.tag[i] == "a"
            if i in on or self.parent[i] not in on or self.parent[i] == core or links[i] * 2 >= chars[i]:
                continue
            if article[i]:
                chosen = density[i] >= least * ARTICLE or self.tag[i] in PROSE
            elif self.tag[i] in INLINE:
                chosen = False  # goes with its run
            else:
                chosen = density[i] >= least and chars[i] >= LEAST * chars[core] or self.tag[i] in ("h1", "h2") and i < core
            if chosen:
                out.add(i)
        return self._pruned(out, on, [density[i] < least and links[i] * 2 >= chars[i] > 0 for i in range(n)]), self._runs(on, core, inside, article)

    def _pruned(self, roots: set[int], on: set[int], low: list[bool]) -> list[bool]:
        """Which nodes are kept: the roots with all they hold, but for blocks of links below the threshold; headings stay."""
        keep = [False] * len(self.tag)
        for i in range(len(keep)):
            inside = i in roots or (i > 0 and keep[self.parent[i]])
            keep[i] = inside and (i in on or not low[i] or self.tag[i] in INLINE or self.tag[i] in HEADINGS)
        return keep

    def text(self) -> str:
        keep, own = self.content()
        parts = []
        for e, (node, text) in enumerate(self.events):
            if text is None or isinstance(text, int):
                i = node if text is None else text
                if self.tag[i] not in INLINE:
                    parts.append(" ")
            elif keep[node] or e in own:
                parts.append(text)
        return " ".join("".join(parts).split())


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All rows and columns of pages with ``_text`` (with more underscores, where pages has that name), the last column."""
    name = unused(pages.columns, "_text")[0]

    def step(batch):
        found = [main_text(x) for x in batch.column(html_col).to_pylist()]
        return pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | {name: pa.array(found, pa.string())})

    return map_arrow(pages, step, with_fields(pages, (name, "string")), html_col)

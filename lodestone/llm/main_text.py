"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped in one linear pass: each block of a page becomes a line
with its text length and the part of it that is link text. Lines of menus,
forms, adverts and the like weigh nothing. The weights of sliding windows of
lines are summed; the text begins where this sum surges over a share of the
page's peak and lasts until it dives below it for good, and the lines between
these points are kept. Where markup names the article, lines outside weigh
nothing and the two points move out to the article's edges; else they are
sought in the innermost block that holds most of the weight, and headings
just before the surge belong to it.

Parts count as no article by element (``nav``, ``aside``, ``footer`` ...), by
role, or by a word of class or id (fixed values below), unless they hold the
article itself.

Defined results: a null or empty page, and one without any text of its own,
give an empty text; repeated rows come back each; a null page_id or url is
passed through; an empty table gives an empty result; other columns are
ignored. Open elements may nest to any depth, tags that never end and quotes
that never close are read once, so work is linear in the page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship, small_batches, tidy

WINDOW = 3
#: Share of the peak at which the window sum surges and dives.
SURGE = 0.2
#: Share of a page's weight that a block must hold to be looked into.
HOLDS = 0.75
#: Longer lines count as this many characters in the window sums.
LONG = 300

# Elements by what they do to the text around and inside them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th", "br"))
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style title textarea noscript iframe xmp noembed noframes template".split()}
CLOSED_BY = {
    "p": BLOCKS - {"option", "optgroup", "legend", "caption", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
#: What an element that closes by itself is not sought beyond.
WALLS = (BLOCKS | {"td", "th", "select"}) - {"p", "li", "dt", "dd", "option", "optgroup", "tr", "tbody", "thead", "tfoot", "address"}
CONTROLS = frozenset("button select datalist label output progress meter svg math canvas audio video object map applet".split())

# Parts that are no article, by element, role, and word of class or id.
NO_ARTICLE = frozenset(("nav", "aside", "footer", "header", "form", "menu", "dialog", "search")) | CONTROLS
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist form status tooltip".split())
NO_ARTICLE_WORDS = frozenset(
    "menu menus submenu nav navi navbar navigation breadcrumb breadcrumbs topnav subnav pagination pager paginator skip skiplink sitemap toolbar topbar "
    "header masthead branding footer colophon copyright sidebar sidebars aside rail widget widgets "
    "ad ads adv advert adverts advertisement advertisements advertising advertorial adsense adbox adslot adunit banner banners sponsor sponsors sponsored promo promos promotion promoted "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay toast paywall "
    "form login signin signup register newsletter subscribe subscription searchbox searchform share sharing social related recommended recommendations "
    "comment comments commentlist commentary disqus respond reply replies guestbook".split()
)
SPOILING_WORDS = frozenset("ad ads advert advertisement sponsored promo promoted related recommended teaser card comment comments reply replies".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies guestbook".split())
#: Words that make a header or footer word name a part of the article, and words that negate the next one.
OWN_WORDS = frozenset("article post entry content story section page title chapter".split())
NEGATING = frozenset(("no", "has", "with", "without", "hide", "hidden", "not", "is", "layout"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
IMPRINT = re.compile(r"(?:©|\(c\)|copyright\b)|.*\ball rights reserved\b", re.I)
COMMENT_HEADING = re.compile(r"(?:\d+ )?(?:reader |user |leave a |post a |\d+ )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?|commenti)(?: \(?\d+\)?)?:?", re.I)

OPEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


class Lines:
    """A page's lines, and the elements that they stand in (in document order)."""

    def __init__(self, html: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = [""]
        self.no_article: list[bool] = [False]
        self.by_word: list[bool] = [False]
        self.comments: list[bool] = [False]
        self.is_main: list[bool] = [False]
        self.text: list[str] = []
        self.linked: list[int] = []
        self.node: list[int] = []
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._open: dict[str, int] = defaultdict(int)
        self._scopes: list[dict[str, int]] = [defaultdict(int)]
        self._pieces: list[str] = []
        self._in_link = False
        self._link_chars = self._kept_out = 0
        self._read(html)
        self._end_line()
        #: The last element inside each one: elements are numbered in document order.
        self.last = list(range(len(self.parent)))
        for k in range(len(self.parent) - 1, 0, -1):
            self.last[self.parent[k]] = max(self.last[self.parent[k]], self.last[k])

    def below(self, k: int, top: int) -> bool:
        """Whether element ``k`` is ``top`` or stands in it."""
        return top <= k <= self.last[top]

    def _read(self, html: str) -> None:
        at, n, last, strict = 0, len(html), html.rfind(">"), True
        while at < n:
            lt = html.find("<", at)
            if lt < 0 or lt > last:
                lt = n
            if lt > at:
                self._say(html[at:lt])
            if lt == n:
                return
            after = html[lt + 1 : lt + 2]
            if after in "!?":
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 2)
                    at = end + 3 if end >= 0 else n
                else:
                    at = html.find(">", lt) + 1
                continue
            m = OPEN.match(html, lt) if strict else LOOSE.match(html, lt)
            if m is None and strict and (after == "/" or after.isalpha()):
                m = LOOSE.match(html, lt)
                strict = m is None  # a quote that never closes: tags end at the next > from here on
            if m is None:
                if after == "/":  # an end tag without a name is no text
                    at = html.find(">", lt) + 1
                else:
                    self._say("<")
                    at = lt + 1
                continue
            at = m.end()
            name = m[2].lower()
            if m[1]:
                self._close(name)
            elif name in RAW and not self._in_svg():
                end = RAW[name].search(html, at)
                at = n if end is None else html.find(">", end.end()) + 1 or n
                if name not in ("title", "script", "style", "template", "noscript"):
                    self._say(" ")
            elif name == "plaintext":
                return self._say(html[at:])
            else:
                self._start(name, m[3])

    def _in_svg(self) -> bool:
        return bool(self._open["svg"] or self._open["math"])

    def _say(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._pieces.append(text)
        if self._in_link:
            self._link_chars += len(text)

    def _end_line(self) -> None:
        text = " ".join("".join(self._pieces).split())
        if text:
            self.text.append(text)
            self.linked.append(min(self._link_chars, len(text)))
            self.node.append(self._stack[-1][1])
        self._pieces, self._link_chars = [], 0

    def _start(self, name: str, source: str) -> None:
        if name in CELLS:
            self._pieces.append(" ")
        for inner, closers in CLOSED_BY.items():
            if name in closers and self._scopes[-1][inner]:
                self._pop(self._top(inner))
        if name == "a":
            self._in_link = "href" in source.lower()
        if name in VOID:
            if name == "hr":
                self._end_line()
            return
        marked, is_main, comments = self._marks(name, source)
        if not (name in BLOCKS or name in CELLS or name in NO_ARTICLE or marked or self._kept_out):
            return
        if name in BLOCKS or name in NO_ARTICLE or marked:  # an inline part that isn't article text ends the line too, so that a line has one place
            self._end_line()
        no = marked or name in NO_ARTICLE
        self._stack.append((name, len(self.parent)))
        self.parent.append(self._stack[-2][1])
        self.tag.append(name)
        self.no_article.append(no)
        self.by_word.append(marked)
        self.comments.append(comments)
        self.is_main.append(is_main)
        self._open[name] += 1
        if name in WALLS:
            self._scopes.append(defaultdict(int))
        self._scopes[-1][name] += 1
        self._kept_out += no

    def _marks(self, name: str, source: str) -> tuple[bool, bool, bool]:
        """What the attributes say: no article, the article, readers' comments."""
        if not source or name in ("html", "body"):
            return False, False, False
        found = attributes(source)
        role = set(found.get("role", "").lower().split())
        is_main = bool({"main", "article"} & role) or found.get("itemprop", "").lower() == "articlebody"
        style = re.sub(r"\s", "", found.get("style", "")).lower()
        if self._open["pre"]:
            return False, is_main, False
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or NO_ARTICLE_ROLES & role:
            return True, is_main, False
        known = SPOILING_WORDS if is_main or name in ("article", "main") else NO_ARTICLE_WORDS
        for value in (*found.get("class", "").split(), found.get("id", "")):
            words = [w.lower() for w in WORDS.findall(value)]
            for before, w in zip(["", *words], words):
                if w in known and before not in NEGATING and not (w in ("header", "masthead") and OWN_WORDS & set(words)):
                    return True, is_main, w in COMMENT_WORDS
        return False, is_main, False

    def _top(self, name: str) -> int:
        """Place of the innermost open element of that name; it and all above are closed next."""
        k = len(self._stack) - 1
        while self._stack[k][0] != name:
            k -= 1
        return k

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._end_line()
        elif name in CELLS:
            self._pieces.append(" ")
        if name == "a":
            self._in_link = False
        if self._open[name]:
            self._pop(self._top(name))

    def _pop(self, k: int) -> None:
        """Closes the elements from place ``k`` of the stack on."""
        if any(tag in BLOCKS or self.no_article[node] for tag, node in self._stack[k:]):
            self._end_line()
        while len(self._stack) > k:
            tag, node = self._stack.pop()
            self._open[tag] -= 1
            self._scopes[-1][tag] -= 1
            if tag in WALLS:
                self._scopes.pop()
            self._kept_out -= self.no_article[node]


class Article:
    """The lines of a page that are its main text, by number (``kept``)."""

    def __init__(self, html: str):
        self.lines = lines = Lines(html)
        self.weights = [len(t) - a for t, a in zip(lines.text, lines.linked)]
        self.named = [k for k in range(1, len(lines.parent)) if lines.tag[k] in ("article", "main") or lines.is_main[k]]
        self.inside = self._visible()
        article = self._article()
        kept = [k for k, node in enumerate(lines.node) if self.inside[node]]
        if article is None:
            self.kept = self._before_comments(self._between(self._without_link_lists(kept)))
        else:
            self.kept = self._before_comments([k for k in kept if lines.below(lines.node[k], article)])

    def _summed(self, values: list[int], kept: list[int]) -> list[int]:
        """For each element the sum of its lines' values."""
        total = [0] * len(self.lines.parent)
        for k in kept:
            total[self.lines.node[k]] += values[k]
        for k in range(len(total) - 1, 0, -1):
            total[self.lines.parent[k]] += total[k]
        return total

    def _visible(self) -> list[bool]:
        """For each element: it may hold article text. Marked parts that hold the article do all the same."""
        lines, n = self.lines, len(self.lines.parent)
        said = [False] * n  # by readers, in comments
        for k in range(1, n):
            said[k] = said[lines.parent[k]] or lines.comments[k]
        mass = self._summed(self.weights, [k for k, node in enumerate(lines.node) if not said[node]])
        holds, has_h1 = [False] * n, [False] * n
        for k in self.named:
            holds[k] = not lines.by_word[k]
        for k in range(n - 1, 0, -1):
            has_h1[k] |= lines.tag[k] == "h1"
            has_h1[lines.parent[k]] |= has_h1[k]
            holds[lines.parent[k]] |= holds[k] and not lines.comments[k]
        in_named, inside = [False] * n, [True] * n
        for k in range(1, n):
            up, tag = lines.parent[k], lines.tag[k]
            in_named[k] = in_named[up] or (holds[k] and (tag in ("article", "main") or lines.is_main[k]))
            out = lines.no_article[k]
            if out and tag not in CONTROLS and not lines.comments[k]:
                own_header = tag == "header" and not lines.by_word[k] and in_named[up]
                whole_form = tag == "form" and has_h1[k] and not lines.by_word[k]
                whole_page = lines.by_word[k] and has_h1[k] and 2 * mass[k] > mass[0]
                out = not (holds[k] or own_header or whole_form or whole_page)
            inside[k] = inside[up] and not out
        return inside

    def _article(self) -> int | None:
        """The named article with the most text: an ``article`` before a ``main``, an outer one before those inside."""
        lines = self.lines
        mass = self._summed(self.weights, [k for k, node in enumerate(lines.node) if self.inside[node]])
        found = [k for k in self.named if self.inside[k] and mass[k]]
        articles = [k for k in found if lines.tag[k] != "main"]
        if not found:
            return None
        best = max(articles or found, key=lambda k: (mass[k], -k))
        nested = []  # the outermost articles inside
        for k in articles:
            if k > best and lines.below(k, best) and lines.tag[k] == "article" and not (nested and lines.below(k, nested[-1])):
                nested.append(k)
        if nested and max(mass[k] for k in nested) >= HOLDS * mass[best]:
            return max(nested, key=lambda k: (mass[k], -k))
        # an article in an article is a reader's comment or a hint at another page
        for k in nested:
            self.inside[k : lines.last[k] + 1] = [False] * (lines.last[k] + 1 - k)
        around = [k for k in found if lines.tag[k] == "main" and lines.below(best, k)]
        if around and 2 * mass[best] < mass[around[-1]]:
            return around[-1]  # one text in several articles
        return best

    def _without_link_lists(self, kept: list[int]) -> list[int]:
        """Lines without runs of two and more that are links for the most part."""
        lines = self.lines
        linky = [2 * lines.linked[k] > len(lines.text[k]) for k in kept]
        near = [a or b for a, b in zip([False, *linky], [*linky[1:], False])]
        return [k for k, a, b in zip(kept, linky, near) if not (a and b)]

    def _between(self, kept: list[int]) -> list[int]:
        """Lines between surge and dive, in the innermost block with most of the weight."""
        lines, top = self.lines, 0
        mass, count = self._summed(self.weights, kept), self._summed([1] * len(lines.text), kept)
        for k in range(1, len(mass)):
            if lines.parent[k] == top and mass[k] >= HOLDS * mass[0] and count[k] > 1:
                top = k
        before = [k for k in kept if lines.node[k] < top]
        kept = [k for k in kept if lines.below(lines.node[k], top)]
        w = [min(self.weights[k], LONG) for k in kept]
        if not any(w):
            return []
        sums = [sum(w[k : k + WINDOW]) for k in range(len(w))]
        bar = SURGE * max(sums)
        over = [k for k, s in enumerate(sums) if s >= bar]
        surge, dive = over[0], min(over[-1] + WINDOW, len(w)) - 1
        # windows reach over short lines of something else: begin and end with long lines and headings, and what stands beside them
        firm = [k for k in range(surge, dive + 1) if w[k] * WINDOW >= bar]
        place = lambda k: (lines.parent[lines.node[kept[k]]], lines.tag[lines.node[kept[k]]])
        heads = lambda k: lines.tag[lines.node[kept[k]]] in HEADING
        first, last = firm[0], firm[-1]
        while first and (place(first - 1) == place(firm[0]) or heads(first - 1)) and not heads(first):
            first -= 1
        while first and heads(first) and heads(first - 1):
            first -= 1
        title = []
        while not first and before and lines.tag[lines.node[before[-1]]] in HEADING:
            title.insert(0, before.pop())
        while last + 1 < len(w) and place(last + 1) == place(firm[-1]) and not IMPRINT.match(lines.text[kept[last + 1]]):
            last += 1
        return title + kept[first : last + 1]

    def _before_comments(self, kept: list[int]) -> list[int]:
        """Lines without those that follow a heading that says "comments" in the same block."""
        lines, out, over = self.lines, [], None
        for k in kept:
            node = lines.node[k]
            if over is not None and lines.below(node, over):
                continue
            over = None
            if lines.tag[node] in HEADING - {"h1"} and COMMENT_HEADING.fullmatch(lines.text[k]):
                over = lines.parent[node]
            else:
                out.append(k)
        return out

    def text(self) -> str:
        return "\n".join(self.lines.text[k] for k in self.kept)


def main_text(html: str | None) -> str:
    return Article(html).text() if html else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 250):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    whole = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kind = lambda c: whole.schema[c].dataType.simpleString()
    return whole.mapInArrow(tidy(run), f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long")

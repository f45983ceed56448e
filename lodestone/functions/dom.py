"""HTML to a tree, and elements of it by selectors.

Tree construction follows what browsers do with broken markup as far as it
moves text or elements: head, body and table rows that are left out, elements
that close by themselves, formatting that is opened again in the next block,
misnested formatting, and text that a table can't hold. Nothing is ever
sought beyond ``MAX_DEPTH`` open elements: deeper ones become siblings, so
work is linear in the page. At most ``MAX_FORMATS`` formatting elements are
opened again. Text is never lost to these bounds.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

MAX_DEPTH = 256
MAX_FORMATS = 8

# Elements by what they do to the tree.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style title textarea iframe xmp noembed noframes template".split()}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
SPECIAL = CLOSES_P | VOID | RAW.keys() | frozenset("applet body button caption colgroup frameset head html marquee noscript object select tbody td tfoot th thead tr".split())
SCOPE = frozenset("applet caption html table td th marquee object".split())
FRAME = frozenset(("html", "head", "body"))
WALLS = SCOPE - {"html", "table"}
IN_HEAD = frozenset("base basefont bgsound link meta title script style template noframes noscript".split())
TABLE_ROWS = {"caption": ("table",), "colgroup": ("table",), "col": ("table", "colgroup"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}
TABLE_PARTS = frozenset(("table", "tbody", "thead", "tfoot", "tr"))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


class Node:
    """An element: its tag, attributes, and children (elements and texts, in order)."""

    __slots__ = ("tag", "source", "parent", "children", "open")

    def __init__(self, tag: str, source: str = ""):
        self.tag, self.source, self.parent, self.open = tag, source, None, False
        self.children: list[Node | str] = []

    @property
    def attributes(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(self.source):
            found.setdefault(name.lower(), unescape(a or b or c))
        return found

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def leave(self) -> None:
        """Out of the parent; an open element is its last child."""
        siblings = self.parent.children
        if siblings[-1] is self:
            siblings.pop()
        else:
            siblings.remove(self)

    def walk(self) -> Iterator[Node | str | None]:
        """This element and what is in it, in document order; None where an element ends."""
        yield self
        rows = [iter(self.children)]
        while rows:
            for child in rows[-1]:
                yield child
                if isinstance(child, Node):
                    rows.append(iter(child.children))
                    break
            else:
                rows.pop()
                yield None

    def elements(self) -> Iterator[Node]:
        """All elements, in document order."""
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def outline(self) -> str:
        """The tree as text, for tests: ``tag(children)`` with quoted texts."""
        out: list[str] = []
        open_tags: list[Node] = []
        for x in self.walk():
            if x is None:
                open_tags.pop()
                out.append(")")
            elif isinstance(x, str):
                out.append(repr(x))
            else:
                open_tags.append(x)
                out.append(f"{x.tag}(")
        return re.sub(r"\(\)", "", " ".join(out).replace("( )", "").replace("( ", "(").replace(" )", ")"))


class Builder:
    """Builds one tree, token by token. Head and body are there from the start."""

    def __init__(self) -> None:
        self.root, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.root.append(self.head)
        self.root.append(self.body)
        self.stack: list[Node] = []
        self.count: dict[str, int] = defaultdict(int)
        self.too_deep: dict[str, int] = defaultdict(int)
        self.formats: list[Node | None] = []  # None: a wall that formatting doesn't cross
        self.in_head = True
        self._push(self.root)
        self._push(self.head)

    # the stack of open elements

    def _push(self, node: Node) -> None:
        node.open = True
        self.stack.append(node)
        self.count[node.tag] += 1

    def _pop(self) -> Node:
        node = self.stack.pop()
        node.open = False
        self.count[node.tag] -= 1
        if node.tag in WALLS and None in self.formats:
            while self.formats.pop() is not None:
                pass
        return node

    def _pop_to(self, node: Node) -> None:
        while self._pop() is not node:
            pass

    def _in_scope(self, tag: str, more: tuple[str, ...] = ()) -> Node | None:
        """The innermost open element of that tag that no wall hides."""
        if self.count[tag]:
            for node in reversed(self.stack):
                if node.tag == tag:
                    return node
                if node.tag in SCOPE or node.tag in more:
                    return None
        return None

    def _to_body(self) -> None:
        if self.in_head:
            self.in_head = False
            while self.stack[-1] is not self.root:
                self._pop()
            self._push(self.body)

    def _add(self, child: Node | str, table_part: bool = False) -> None:
        """Into the innermost open element; what a table can't hold goes before it."""
        top = self.stack[-1]
        if top.tag in TABLE_PARTS and not table_part:
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is not None:
                into = table.parent
                if not isinstance(child, str):
                    child.parent = into
                into.children.insert(len(into.children) - 1 if into.children[-1] is table else into.children.index(table), child)
                return
        if isinstance(child, str):
            top.children.append(child)
        else:
            top.append(child)

    # formatting elements that are open, or to be opened again

    def _reopen(self) -> None:
        formats = self.formats
        if not formats or formats[-1] is None or formats[-1].open:
            return
        k = len(formats) - 1
        while k and formats[k - 1] is not None and not formats[k - 1].open:
            k -= 1
        for i in range(k, len(formats)):
            if len(self.stack) >= MAX_DEPTH:
                del formats[i:]
                return
            again = Node(formats[i].tag, formats[i].source)
            self._add(again)
            self._push(again)
            formats[i] = again

    def _remember(self, node: Node) -> None:
        mine = []
        for f in reversed(self.formats):
            if f is None:
                break
            mine.append(f)
        alike = [f for f in mine if f.tag == node.tag and f.source == node.source]
        if len(alike) >= 3:
            self.formats.remove(alike[-1])
        elif len(mine) >= MAX_FORMATS:
            self.formats.remove(mine[-1])
        self.formats.append(node)

    def _close_format(self, tag: str) -> None:
        """The end of a formatting element, which may be misnested with blocks."""
        stack, formats = self.stack, self.formats
        if stack[-1].tag == tag and not any(f is stack[-1] for f in formats):
            self._pop()
            return
        for _ in range(8):
            found = None
            for f in reversed(formats):
                if f is None or f.tag == tag:
                    found = f
                    break
            if found is None:
                return self._close_other(tag)
            if not found.open:
                formats.remove(found)
                return None
            if self._in_scope(tag) is None:
                return None
            at = len(stack) - 1
            while stack[at] is not found:
                at -= 1
            block = next((n for n in stack[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                self._pop_to(found)
                formats.remove(found)
                return None
            mark, last, k = formats.index(found), block, stack.index(block, at)
            for turn in range(1, len(stack)):
                k -= 1
                node = stack[k]
                if node is found:
                    break
                known = any(f is node for f in formats)
                if known and turn > 3:
                    gone = formats.index(node)
                    formats.pop(gone)
                    mark -= gone < mark
                    known = False
                if not known:
                    node.open = False
                    self.count[node.tag] -= 1
                    stack.pop(k)
                    continue
                again = Node(node.tag, node.source)
                again.open, node.open = True, False
                formats[formats.index(node)] = again
                stack[k] = again
                if last is block:
                    mark = formats.index(again) + 1
                last.leave()
                again.append(last)
                last = again
            last.leave()
            stack[at - 1].append(last)
            again = Node(found.tag, found.source)
            again.children, block.children = block.children, []
            for c in again.children:
                if isinstance(c, Node):
                    c.parent = again
            block.append(again)
            formats.insert(mark, again)
            gone = formats.index(found)
            formats.pop(gone)
            stack.pop(at)
            found.open, again.open = False, True
            stack.insert(stack.index(block) + 1, again)
        return None

    # tokens

    def text(self, data: str) -> None:
        if self.in_head:
            if not data.strip():
                return
            self._to_body()
        formats = self.formats
        if formats and formats[-1] is not None and not formats[-1].open and not data.isspace():
            self._reopen()
        top = self.stack[-1]
        if top.tag in TABLE_PARTS and not data.isspace():
            self._add(data)
        else:
            top.children.append(data)

    def raw(self, tag: str, source: str, data: str) -> None:
        """An element whose content is text alone."""
        if tag not in IN_HEAD:
            self._to_body()
        node = Node(tag, source)
        if data:
            node.children.append(data)
        self._add(node, tag in ("script", "style", "template"))

    def start(self, tag: str, source: str) -> None:
        if tag in FRAME:
            if tag == "body":
                self._to_body()
            node = {"html": self.root, "head": self.head, "body": self.body}[tag]
            node.source = node.source + " " + source if source else node.source
            return
        if self.in_head and tag not in IN_HEAD:
            self._to_body()
        if tag in FORMATTING and tag != "a" and tag != "nobr":
            formats = self.formats
            if formats and formats[-1] is not None and not formats[-1].open:
                self._reopen()
            node = Node(tag, source)
            self._add(node)
            if len(self.stack) < MAX_DEPTH:
                self._push(node)
                self._remember(node)
            else:
                self.too_deep[tag] += 1
            return
        part = tag in TABLE_ROWS
        if part:
            if not self.count["table"]:
                return
            self._into_table(TABLE_ROWS[tag])
        elif tag in CLOSES_P and self.count["p"]:
            p = self._in_scope("p", ("button",))
            if p is not None:
                self._pop_to(p)
        if tag in FORMATTING:
            for f in reversed(self.formats):  # neither holds another of its kind
                if f is None:
                    break
                if f.tag == tag:
                    self._close_format(tag)
                    if f in self.formats:
                        self.formats.remove(f)
                    break
            self._reopen()
        elif tag in ("li", "dd", "dt"):
            self._close_item(tag)
        elif tag in HEADINGS:
            if self.stack[-1].tag in HEADINGS:
                self._pop()
        elif tag == "option" or tag == "optgroup":
            if self.stack[-1].tag == "option":
                self._pop()
        elif tag == "button":
            b = self._in_scope("button")
            if b is not None:
                self._pop_to(b)
        if not part and tag not in SPECIAL and tag not in FORMATTING and self.formats:
            self._reopen()
        node = Node(tag, source)
        self._add(node, part)
        if tag in VOID:
            return
        if len(self.stack) >= MAX_DEPTH:
            self.too_deep[tag] += 1
            return
        self._push(node)
        if tag in FORMATTING:
            self._remember(node)
        elif tag in WALLS:
            self.formats.append(None)

    def _into_table(self, parents: tuple[str, ...]) -> None:
        """Closes what is open inside the table part that holds the next one; rows and bodies that are left out are made."""
        while self.stack[-1].tag not in parents and self.stack[-1].tag != "table":
            self._pop()
        if "tr" in parents and self.stack[-1].tag == "table":
            self._open_part("tbody")
        if "tr" in parents and self.stack[-1].tag in ("tbody", "thead", "tfoot"):
            self._open_part("tr")
        elif "tbody" in parents and self.stack[-1].tag == "table":
            self._open_part("tbody")

    def _open_part(self, tag: str) -> None:
        node = Node(tag)
        self.stack[-1].append(node)
        self._push(node)

    def _close_item(self, tag: str) -> None:
        same = ("li",) if tag == "li" else ("dd", "dt")
        if not any(self.count[t] for t in same):
            return
        for node in reversed(self.stack):
            if node.tag in same:
                return self._pop_to(node)
            if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                return None

    def end(self, tag: str) -> None:
        if tag in FRAME or (self.in_head and tag not in ("p", "br")):
            if tag == "head":
                self._to_body()
            elif self.in_head and self.stack[-1].tag == tag and self.stack[-1] is not self.head:
                self._pop()
            return
        if self.too_deep[tag]:
            self.too_deep[tag] -= 1
        elif tag in FORMATTING:
            self._close_format(tag)
        elif tag == "p":
            self._to_body()
            p = self._in_scope("p", ("button",))
            if p is None:
                self._add(Node("p"))
            else:
                self._pop_to(p)
        elif tag == "br":
            self.start("br", "")
        elif tag in HEADINGS:
            for node in reversed(self.stack):
                if node.tag in HEADINGS:
                    self._pop_to(node)
                    break
                if node.tag in SCOPE:
                    break
        elif tag in TABLE_ROWS or tag == "table":
            if self.count["table"] and self.count[tag]:
                for node in reversed(self.stack):
                    if node.tag == tag:
                        self._pop_to(node)
                        break
                    if node.tag == "table":
                        break
        elif tag in SPECIAL:
            node = self._in_scope(tag)
            if node is not None and node not in (self.root, self.body, self.head):
                self._pop_to(node)
        else:
            self._close_other(tag)

    def _close_other(self, tag: str) -> None:
        if self.count[tag]:
            for node in reversed(self.stack):
                if node.tag == tag:
                    return self._pop_to(node)
                if node.tag in SPECIAL:
                    return None


def parse(html: str) -> Node:
    """The html element of a page; any text is a page."""
    b = Builder()
    start, end, text = b.start, b.end, b.text
    at, n, last, tag_at, find = 0, len(html), html.rfind(">"), _TAG.match, html.find
    while at < n:
        lt = find("<", at)
        if lt < 0 or lt > last:
            lt = n
        if lt > at:
            data = html[at:lt]
            text(unescape(data) if "&" in data else data)
        if lt == n:
            break
        m = tag_at(html, lt)
        if m is None:
            after = html[lt + 1 : lt + 2]
            if after.isalpha() or (after == "/" and html[lt + 2 : lt + 3].isalpha()):
                tag_at = _LOOSE.match  # a quote that never closes: tags end at the next > from here on
                m = tag_at(html, lt)
            elif after == "!" or after == "?" or after == "/":
                if html.startswith("<!--", lt):
                    done = find("-->", lt + 2)
                    at = done + 3 if done >= 0 else n
                else:
                    at = find(">", lt) + 1
                continue
            if m is None:
                text("<")
                at = lt + 1
                continue
        at = m.end()
        closing, tag, source = m.groups()
        tag = tag.lower()
        if closing:
            end(tag)
        elif tag in RAW:
            found = RAW[tag].search(html, at)
            stop = n if found is None else found.start()
            data = html[at:stop]
            b.raw(tag, source, unescape(data) if tag in ("title", "textarea") else data)
            at = n if found is None else find(">", found.end()) + 1 or n
        elif tag == "plaintext":
            start(tag, source)
            text(html[at:])
            break
        else:
            start(tag, source)
    return b.root


# Selectors: tag, .class, #id, [name], [name=v], [name*=v], [name^=v], [name$=v], [name~=v];
# blank and > between compounds, commas between selectors. Values compare in either case.
_PIECE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*["']?([^"'\]]*?)["']?\s*)?\]""")
_TESTS = {
    "=": lambda have, want: have == want, "*=": lambda have, want: want in have, "^=": lambda have, want: have.startswith(want),
    "$=": lambda have, want: have.endswith(want), "~=": lambda have, want: want in have.split(),
}


@lru_cache(256)
def compiled(selector: str) -> tuple:
    """Selectors as lists of (child only, tag, attribute tests), the last compound first."""
    out = []
    for one in selector.split(","):
        steps, child = [], False
        for word in re.sub(r"\s*>\s*", " > ", one.strip()).split():
            if word == ">":
                child = True
                continue
            tag, tests, at = "*", [], 0
            while at < len(word):
                m = _PIECE.match(word, at)
                if m is None:
                    raise ValueError(f"not a selector: {selector}")
                if m[1]:
                    tag = m[1].lower()
                elif m[2] or m[3]:
                    tests.append(("class", "~=", m[2].lower()) if m[2] else ("id", "=", m[3].lower()))
                else:
                    tests.append((m[4].lower(), m[5], (m[6] or "").lower()))
                at = m.end()
            steps.append((child, tag, tuple(tests)))
            child = False
        if not steps:
            raise ValueError(f"not a selector: {selector}")
        out.append(tuple(reversed(steps)))
    return tuple(out)


def _fits(node: Node, tag: str, tests: tuple) -> bool:
    if tag != "*" and node.tag != tag:
        return False
    if not tests:
        return True
    if not node.source:
        return False
    have = node.attributes
    return all(name in have and (how is None or (_TESTS[how](have[name].lower(), want) and (want != "" or how == "="))) for name, how, want in tests)


def matches(node: Node, steps: tuple) -> bool:
    """Whether an element is one that the compounds lead to."""
    child, tag, tests = steps[0]
    if not _fits(node, tag, tests):
        return False
    if len(steps) == 1:
        return True
    up = node.parent
    if child:
        return up is not None and matches(up, steps[1:])
    while up is not None:
        if matches(up, steps[1:]):
            return True
        up = up.parent
    return False


def select(root: Node, selector: str) -> Iterator[Node]:
    """Elements that any of the selectors fits, in document order."""
    wanted = compiled(selector)
    return (node for node in root.elements() if any(matches(node, steps) for steps in wanted))

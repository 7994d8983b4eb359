"""A tokenizer and tree builder for HTML, after the HTML standard's tree construction, in plain Python.

Covered: implied html/head/body, raw text and RCDATA elements, void elements, implied end tags, p in button scope, list items,
the list of active formatting elements with reconstruction and the rule of three, the adoption agency in its common form
(misnested formatting elements), table sections and cells with implied tbody/tr, foster parenting. A template's content is
no part of the tree.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("style script xmp iframe noembed noframes noscript".split())
RCDATA = frozenset(("title", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre section summary table ul dd dt".split()
)
BLOCKS = CLOSES_P - {"p", "li", "dd", "dt", "hr"} | {"button", "body", "html"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
SPECIAL = CLOSES_P | SCOPE | frozenset("body button head input img tbody tfoot thead tr select textarea".split())
HEAD_ONLY = frozenset("base link meta title style script noscript".split())
TABLE = frozenset("table tbody thead tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th style script template".split())
TAG = re.compile(r"<(?:!--(.*?)(?:-->|$)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?]([^>]*)>)", re.S)
ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def tokens(html: str):
    """(kind, name or text, attributes): kinds are text, start, end, comment, doctype."""
    at, raw_until = 0, None
    html = html.replace("\r\n", "\n").replace("\r", "\n")
    n = len(html)
    while at < n:
        if raw_until:
            m = re.compile(rf"</{raw_until}(?=[\s/>])", re.I).search(html, at)
            end = m.start() if m else n
            if end > at:
                text = html[at:end]
                yield "text", unescape(text) if raw_until in RCDATA else text, None
            at, raw_until = end, None
            continue
        begin = html.find("<", at)
        if begin < 0:
            yield "text", unescape(html[at:]), None
            return
        if begin > at:
            yield "text", unescape(html[at:begin]), None
        m = TAG.match(html, begin)
        if not m:
            if re.match(r"</?[A-Za-z!]", html[begin : begin + 3]):
                return  # an unfinished tag at the end
            yield "text", "<", None
            at = begin + 1
            continue
        at = m.end()
        if m[3]:
            name = m[3].lower()
            if m[2]:
                yield "end", name, None
            else:
                yield "start", name, attributes(m[4]) if m[4] else {}
                if name in RAW or name in RCDATA:
                    raw_until = name
        elif m[1] is not None:
            yield "comment", m[1], None
        else:
            yield "doctype", m[5] or "", None


class Builder:
    def __init__(self):
        self.html = Node("html")
        self.head, self.body = Node("head"), Node("body")
        self.html.children += [self.head, self.body]
        self.stack = [self.html]
        self.active: list[Node | None] = []
        self.in_body = False

    def scope(self, names, extra=()) -> bool:
        for node in reversed(self.stack):
            if node.tag in names:
                return True
            if node.tag in SCOPE or node.tag in extra:
                return False
        return False

    def pop_to(self, names) -> None:
        while len(self.stack) > 2:
            if self.stack.pop().tag in names:
                return

    def open_body(self) -> None:
        if not self.in_body:
            self.in_body = True
            self.stack = [self.html, self.body]

    def put(self, x: Node | str) -> None:
        """At the end of the current node; what has no place right in a table goes before it."""
        top = self.stack[-1]
        kids = top.children
        at = len(kids)
        if top.tag in TABLE and (x.strip("\t\n\f\r ") if isinstance(x, str) else x.tag not in TABLE_PARTS):
            i = max(i for i, n in enumerate(self.stack) if n.tag == "table") if any(n.tag == "table" for n in self.stack) else 0
            if i:
                kids = self.stack[i - 1].children
                at = next((j for j in range(len(kids) - 1, -1, -1) if kids[j] is self.stack[i]), len(kids))
        if isinstance(x, str) and at and isinstance(kids[at - 1], str):
            kids[at - 1] += x
        else:
            kids.insert(at, x)

    def insert(self, tag: str, attrs: dict) -> Node:
        node = Node(tag, attrs)
        self.put(node)
        return node

    def reconstruct(self) -> None:
        i = len(self.active)
        while i and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for j in range(i, len(self.active)):
            old = self.active[j]
            node = self.insert(old.tag, dict(old.attrs))
            self.stack.append(node)
            self.active[j] = node

    def push_active(self, node: Node) -> None:
        same = []
        for i in range(len(self.active) - 1, -1, -1):
            old = self.active[i]
            if old is None:
                break
            if old.tag == node.tag and old.attrs == node.attrs:
                same.append(i)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(node)

    def close_p(self) -> None:
        if self.scope({"p"}, ("button",)):
            self.pop_to({"p"})

    def text(self, data: str) -> None:
        if not self.in_body:
            if not data.strip("\t\n\f\r "):
                return
            self.open_body()
        self.reconstruct()
        self.put(data)

    def start(self, tag: str, attrs: dict) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.open_body()
            return
        if not self.in_body and tag in HEAD_ONLY:
            node = Node(tag, attrs)
            self.head.children.append(node)
            if tag not in VOID:
                self.stack.append(node)
            return
        self.open_body()
        if tag in CLOSES_P:
            self.close_p()
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if tag in ("li", "dd", "dt"):
            same = {"li"} if tag == "li" else {"dd", "dt"}
            for node in reversed(self.stack):
                if node.tag in same:
                    self.pop_to({node.tag})
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
        elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self.stack.pop()
        elif tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup", "col"):
            self.table_part(tag)
        elif tag == "table" and self.stack[-1].tag in TABLE:
            self.end("table")
        elif tag == "a" and any(x is not None and x.tag == "a" for x in self.active):
            self.end("a")
        if tag in FORMATTING:
            self.reconstruct()
            node = self.insert(tag, attrs)
            self.stack.append(node)
            self.push_active(node)
            return
        if tag not in CLOSES_P and tag not in SPECIAL:
            self.reconstruct()
        node = self.insert(tag, attrs)
        if tag not in VOID:
            self.stack.append(node)
        if tag in ("td", "th", "caption", "applet", "marquee", "object"):
            self.active.append(None)

    def table_part(self, tag: str) -> None:
        def back_to(names) -> None:
            while len(self.stack) > 2 and self.stack[-1].tag not in names:
                if self.stack.pop().tag in ("td", "th", "caption"):
                    self.clear_active()

        if not any(n.tag == "table" for n in self.stack):
            return
        sections = ("tbody", "thead", "tfoot")
        if tag in ("caption", "colgroup", *sections):
            back_to(("table",))
        elif tag == "col":
            back_to(("table", "colgroup"))
        elif tag == "tr":
            back_to((*sections, "table"))
            if self.stack[-1].tag == "table":
                self.stack.append(self.insert("tbody", {}))
        else:
            back_to(("tr", *sections, "table"))
            if self.stack[-1].tag == "table":
                self.stack.append(self.insert("tbody", {}))
            if self.stack[-1].tag != "tr":
                self.stack.append(self.insert("tr", {}))

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def end(self, tag: str) -> None:
        if self.stack[-1].tag == tag and tag in HEAD_ONLY | RCDATA:
            self.stack.pop()
            return
        if tag in ("html", "body", "head"):
            return
        if tag == "p" and not self.scope({"p"}, ("button",)):
            self.open_body()
            self.insert("p", {})
            return
        if tag == "br":
            self.start("br", {})
            return
        if tag in FORMATTING:
            self.adopt(tag)
            return
        if tag in HEADINGS:
            if self.scope(HEADINGS):
                self.pop_to(HEADINGS)
            return
        for node in reversed(self.stack[2:]):
            if node.tag == tag:
                if self.scope({tag}, ("ol", "ul") if tag == "li" else ()) or tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot"):
                    self.pop_to({tag})
                    if tag in ("td", "th", "caption", "applet", "marquee", "object"):
                        self.clear_active()
                return
            if node.tag in SPECIAL and tag not in BLOCKS and tag not in SPECIAL:
                return

    def adopt(self, tag: str) -> None:
        for _ in range(8):
            entry = None
            for node in reversed(self.active):
                if node is None:
                    break
                if node.tag == tag:
                    entry = node
                    break
            if entry is None:
                return
            if entry not in self.stack:
                self.active.remove(entry)
                return
            at = self.stack.index(entry)
            block = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(entry)
                return
            # a block inside the element: the element ends before it and goes on inside
            parent, where = self.stack[at - 1], self.stack.index(block)
            self.stack[where - 1].children.remove(block)
            parent.children.append(block)
            inner = Node(entry.tag, dict(entry.attrs))
            inner.children, block.children = block.children, []
            block.children.append(inner)
            i = self.active.index(entry)
            self.active[i] = inner
            rest = self.stack[where + 1 :]
            del self.stack[at:]
            self.stack += [block, inner, *rest]


def parse(html: str) -> Node:
    b, template = Builder(), 0
    for kind, data, attrs in tokens(html):
        if data == "template" and kind in ("start", "end"):
            template = max(0, template + (1 if kind == "start" else -1))
        elif template:
            continue
        elif kind == "text":
            if b.stack[-1].tag in HEAD_ONLY and not b.in_body:
                b.stack[-1].children.append(data)
            else:
                b.text(data)
        elif kind == "start":
            b.start(data, attrs)
        elif kind == "end":
            b.end(data)
    return b.html

"""HTML tree to Markdown, in plain Python, and the Arrow functions that run it over columns."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomark.functions.html5 import Node, parse

WS = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
LANGUAGE = re.compile(r"lang(?:uage)?-([A-Za-z0-9_\-+.#]+)")
RUN = re.compile(f"[{WS}]+")
# fixed values
SKIPPED = frozenset(("script", "style", "noscript"))
NOISE = ("nav", "footer", "aside")
PROTECTED = frozenset(("main", "article"))
REMOVED = frozenset(("script", "style", "noscript", "applet", "link", "base"))
EMBEDDED = frozenset(("iframe", "object", "embed"))
SCHEMES = ("javascript:", "data:", "vbscript:", "file:", "about:")
MARKS = {"left": "---", "center": ":---:", "right": "---:"}
MAX_DEPTH = 1000
#: Bytes of text from which the normaliser works on code as well.
LARGE = 256 << 10
RECURSION = 20 * MAX_DEPTH


@dataclass(frozen=True)
class Options:
    gfm: bool = False
    preserve_tables: bool = True
    front_matter: bool = False
    resolve: bool = True
    prune: bool = True
    noise: tuple[str, ...] = field(default=NOISE)


#: What str.split() takes for white space and WS does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def squeeze(text: str) -> str:
    if any(c in text for c in SEPARATORS):
        return RUN.sub(" ", text).strip(" ")
    return " ".join(text.split())


def dangerous(url: str) -> bool:
    u = url.strip(WS)
    return bool(re.search(r"[\x00-\x1f\x7f-\x9f]|%(?:0[0-9a-f]|1[0-9a-f]|7f)", u, re.I)) or u.lower().startswith(SCHEMES)


def resolve(url: str, base: str | None) -> str:
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", url):
        return url
    s = urlsplit(base)
    if url.startswith("/"):
        return f"{s.scheme}://{s.netloc}{url}"
    path = re.sub("[?#].*$", "", base)
    return (path + "/" if re.fullmatch("[^:]+://[^/]+", path) else re.sub("[^/]*$", "", path)) + url


def resolve_metadata(url: str, base: str | None) -> str:
    """Metadata's own rules: only http and https are absolute, and only such a base resolves."""
    if url.startswith(("http://", "https://", "//")) or not base or not base.startswith(("http://", "https://")):
        return url
    if url.startswith("/"):
        return re.match("https?://[^/]*", base)[0] + url
    folder = base.rstrip("/")
    if not folder.endswith(("http:", "https:")) and not re.fullmatch("https?://[^/]*", folder):
        folder = folder[: folder.rfind("/")]
    return f"{folder.rstrip('/')}/{url}"


def destination(url: str) -> str:
    return f"<{url.replace('<', '%3C').replace('>', '%3E')}>" if re.search("[ ()<>]", url) else url


def label(text: str) -> str:
    return re.sub(r"[\r\n]", " ", re.sub(r"([\[\]\\])", r"\\\1", text))


def plain(node: Node, skip: frozenset = SKIPPED) -> str:
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in skip:
            todo.extend(reversed(x.children))
    return "".join(out)


def collapse(line: str) -> str:
    """Runs of blanks become one, but at the line's start and in inline code; code that is never closed goes on to the end."""
    if "  " not in line:
        return line
    lead = len(line) - len(line.lstrip(" "))
    out, code = [line[:lead]], ""
    for x in re.split("(`+)", line[lead:]):
        if x.startswith("`"):
            code = "" if x == code else code or x
        elif not code:
            x = re.sub(" {2,}", " ", x)
        out.append(x)
    return "".join(out)


def normalise(text: str) -> str:
    """Blanks at line ends, all but one of a run of blank lines and inner runs of blanks go, though not in fenced code; one
    newline ends the text. Texts over LARGE bytes lose blanks at line ends and blank lines in code as well."""
    large = len(text) > LARGE or (4 * len(text) > LARGE and len(text.encode("utf-8", "replace")) > LARGE)
    out: list[str] = []
    fence, blank = 0, False
    for line in text.replace("\r\n", "\n").split("\n"):
        run = 0
        if "```" in line:
            start = line.lstrip(WS)
            run = len(start) - len(start.lstrip("`"))
        trimmed = line.rstrip(WS)
        if run >= 3 and not fence:
            fence = run
            out.append(trimmed)
            blank = False
        elif fence and run >= fence and not start[run:].strip(WS):
            fence = 0
            out.append(collapse(trimmed) if large else trimmed)
            blank = False
        elif fence and not large:
            out.append(line)
            blank = False
        elif trimmed:
            out.append(trimmed if fence else collapse(trimmed))
            blank = False
        elif not blank:
            out.append("")
            blank = True
    while out and not out[-1]:
        out.pop()
    return "\n".join(out) + "\n"


class Text:
    """Text that grows at its end. It knows its last two characters, so that no step reads or copies all of it."""

    __slots__ = ("parts", "tail")

    def __init__(self):
        self.parts: list[str] = []
        self.tail = ""

    def __iadd__(self, s: str) -> "Text":
        if s:
            self.parts.append(s)
            self.tail = s[-2:] if len(s) > 1 else self.tail[-1:] + s
        return self

    def __str__(self) -> str:
        return "".join(self.parts)

    def gap(self) -> None:
        """A blank line before what follows, if anything stands before it."""
        if self.tail and self.tail != "\n\n":
            self += "\n" if self.tail.endswith("\n") else "\n\n"

    def close(self) -> None:
        if self.tail != "\n\n":
            self += "\n"


class Writer:
    def __init__(self, options: Options, base: str | None):
        self.o, self.base, self.buf = options, base if options.resolve else None, Text()

    def url(self, raw: str | None) -> str | None:
        return None if raw is None or dangerous(raw) else resolve(raw, self.base) if raw else raw

    def link(self, raw: str | None, *labels: str | None) -> None:
        """A line [label](url), the label the first that is not blank, else the url."""
        if raw is not None and (to := self.url(raw.strip(WS))) is not None:
            name = next((x.strip(WS) for x in labels if x and x.strip(WS)), to)
            self.buf += f"[{label(name)}]({destination(to)})\n"

    def text(self, data: str) -> None:
        body, buf = squeeze(data), self.buf
        apart = bool(buf.tail) and buf.tail[-1] != " "
        if not body:
            if apart:
                buf += " "
            return
        buf += (" " if apart and data[0] in WS else "") + body + (" " if data[-1] in WS else "")

    def inner(self, node: Node, depth: int) -> str:
        held, self.buf = self.buf, Text()
        self.walk(node, depth)
        out, self.buf = str(self.buf), held
        return out

    def walk(self, node: Node, depth: int = 0) -> None:
        if depth > MAX_DEPTH:
            raise ValueError("nesting is too deep")
        for x in node.children:
            if isinstance(x, str):
                self.text(x)
            else:
                self.element(x, depth + 1)

    def element(self, n: Node, depth: int) -> None:
        t = n.tag
        if t in REMOVED or (self.o.prune and t in self.o.noise and t not in PROTECTED):
            return
        if len(t) == 2 and t[0] == "h" and t[1] in "123456":
            self.buf.gap()
            self.buf += "#" * int(t[1]) + " " + squeeze(self.inner(n, depth)) + "\n\n"
        elif t == "p":
            self.buf.gap()
            before = len(self.buf.parts)
            self.walk(n, depth)
            if len(self.buf.parts) > before:
                self.buf += "\n\n"
        elif t in ("ul", "ol"):
            self.items(n, 0, depth)
        elif t == "li":
            self.item(n, "- ", 0, depth)
        elif t == "pre":
            self.buf.gap()
            classes = [c for x in n.children if isinstance(x, Node) and x.tag == "code" for c in x.attrs.get("class", "").split()]
            found = next((m[1] for m in map(LANGUAGE.fullmatch, classes) if m), "")
            raw = plain(n)
            run = max((len(x) for x in re.findall("`+", raw)), default=0)
            fence = "`" * (max(run, 3) + 1 if run else 3)
            self.buf += f"{fence}{found}\n{raw}{'' if raw.endswith(chr(10)) else chr(10)}{fence}\n\n"
        elif t == "code":
            raw = plain(n)
            fence = "`" * (max((len(x) for x in re.findall("`+", raw)), default=0) + 1)
            self.buf += fence + raw + fence
        elif t in ("strong", "b", "em", "i"):
            mark = "**" if t in ("strong", "b") else "*"
            self.buf += mark
            self.walk(n, depth)
            self.buf += mark
        elif t == "a":
            raw = plain(n)
            if "href" not in n.attrs:
                self.buf += squeeze(raw)
            elif squeeze(raw):
                to = self.url(n.attrs["href"])
                self.buf += label(squeeze(raw)) if to is None else f"[{label(squeeze(raw))}]({destination(to)})"
        elif t == "img":
            alt, to = n.attrs.get("alt", ""), self.url(n.attrs.get("src"))
            title = n.attrs.get("title", "").strip(WS)
            title = ' "' + title.replace("\\", "\\\\").replace('"', '\\"') + '"' if title else ""
            self.buf += label(alt.strip(WS)) if to is None else f"![{label(alt)}]({destination(to)}{title})"
        elif t == "table" and self.o.gfm and self.o.preserve_tables:
            self.table(n, depth)
        elif t in ("video", "audio"):
            self.link(n.attrs.get("src"), n.attrs.get("title"))
            if t == "video" and (to := self.url(n.attrs["poster"].strip(WS) if "poster" in n.attrs else None)) is not None:
                self.buf += f"![]({destination(to)})\n"
            self.walk(n, depth)
        elif t == "source":
            self.link(n.attrs.get("src"), n.attrs.get("type"))
        elif t == "track":
            self.link(n.attrs.get("src"), n.attrs.get("label"))
        elif t == "area":
            self.link(n.attrs.get("href"), n.attrs.get("alt"), n.attrs.get("title"))
        elif t in EMBEDDED:
            self.link(n.attrs.get("data" if t == "object" else "src"), n.attrs.get("title"))
            self.walk(n, depth)
        elif t == "input":
            kind = n.attrs.get("type", "").lower()
            shown = () if kind in ("hidden", "image") else ("value",) if kind in ("submit", "reset") else ("aria-label", "placeholder", "value")
            value = next((n.attrs[k] for k in shown if k in n.attrs), "").strip(WS)
            if value:
                self.buf += value + " "
        else:
            self.walk(n, depth)

    def items(self, n: Node, level: int, depth: int) -> None:
        self.buf.gap()
        for x in n.children:
            if isinstance(x, Node) and x.tag == "li":
                self.item(x, "1. " if n.tag == "ol" else "- ", level, depth + 1)
        self.buf.close()

    def item(self, n: Node, marker: str, level: int, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise ValueError("nesting is too deep")
        held, self.buf = self.buf, Text()
        for x in n.children:
            if isinstance(x, str):
                self.text(x)
            elif x.tag in ("ul", "ol"):
                if self.buf.tail and not self.buf.tail.endswith("\n"):
                    self.buf += "\n"
                self.items(x, level + 1, depth + 1)
            else:
                self.element(x, depth + 1)
        body, self.buf = str(self.buf).strip("\n"), held
        base = "  " * level
        first, *rest = body.split("\n")
        if first.lstrip(WS).startswith(("- ", "* ", "1. ")):  # an item's marker stands on a line of its own
            first, rest = "", [first, *rest]
        hang = base + " " * len(marker)
        lines = [base + marker + first, *[hang + x if x and x[0] not in " \t" else x for x in rest]]
        self.buf += "\n".join(lines) + "\n"

    def table(self, n: Node, depth: int) -> None:
        head: list[str] = []
        aligns: list[str | None] = []
        rows: list[list[str]] = []

        def align(x: Node) -> str | None:
            if "align" in x.attrs:
                value = x.attrs["align"].lower()
            else:
                pairs = (d.partition(":") for d in x.attrs.get("style", "").lower().split(";"))
                value = next((v.strip(WS) for k, _, v in pairs if k.strip(WS) == "text-align"), "")
            return value if value in MARKS else None

        def cells(r: Node) -> list[tuple[str, Node]]:
            return [(self.inner(c, 0).strip(WS), c) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]

        def take(found: list[Node]) -> None:
            """The first row is the head unless there is one."""
            if found and not head:
                title(found.pop(0))
            rows.extend([text for text, _ in cells(r)] for r in found)

        def title(r: Node) -> None:
            for text, c in cells(r):
                head.append(text)
                aligns.append(align(c))

        inner = lambda x, tag: [c for c in x.children if isinstance(c, Node) and c.tag == tag]
        for x in n.children:
            if isinstance(x, str):
                continue
            if x.tag == "thead":
                for r in inner(x, "tr")[:1]:
                    title(r)
            elif x.tag == "tbody":
                take(inner(x, "tr"))
            elif x.tag == "tr":
                take([x])
        self.buf.gap()
        if not head:
            return
        at = 0
        for group in inner(n, "colgroup"):
            for c in inner(group, "col"):
                span, own = c.attrs.get("span", "1"), align(c)
                for _ in range(min(1000, max(1, int(span) if span.isascii() and span.isdigit() else 1))):
                    aligns += [None] * (own is not None and at >= len(aligns))
                    if own is not None:
                        aligns[min(at, len(aligns) - 1)] = own
                    at += 1
        width = max(map(len, [head, *rows]))
        escape = lambda c: c.replace("\r\n", "\n").replace("\r", "\n").replace("\n", "<br>").replace("|", "\\|")
        line = lambda r: "|" + "".join(f" {x} |" for x in [*map(escape, r), *[""] * (width - len(r))]) + "\n"
        rule = [MARKS.get(a, "---") for a in [*aligns, *[None] * width][:width]]
        self.buf += line(head) + "|" + "".join(f" {x} |" for x in rule) + "\n" + "".join(map(line, rows))
        self.buf.close()


def find(node: Node, tag: str):
    """The nodes of a tag below a node, in the page's order."""
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if not isinstance(x, str):
            if x.tag == tag:
                yield x
            todo.extend(reversed(x.children))


def metadata(tree: Node, base: str | None) -> dict[str, str | None]:
    out: dict[str, str | None] = dict.fromkeys(("title", "description", "url", "image", "author", "published"))
    for x in find(tree, "title"):
        out["title"] = plain(x, frozenset()).strip(WS)
        break
    for x in find(tree, "meta"):
        name, content = x.attrs.get("property") or x.attrs.get("name"), x.attrs.get("content")
        if not name or content is None:
            continue
        if name in ("og:title", "twitter:title"):
            out["title"] = content
        elif name in ("og:description", "twitter:description"):
            out["description"] = content
        else:
            key = {"description": "description", "og:image": "image", "twitter:image": "image", "author": "author", "article:published_time": "published"}.get(name)
            if key and out[key] is None:
                out[key] = content
    canon = next((x.attrs.get("href") for x in find(tree, "link") if "canonical" in x.attrs.get("rel", "").lower().split()), None)
    to = resolve_metadata(canon, base) if canon else base
    out["url"] = to if to and not dangerous(to) else None
    return out


def front_matter(meta: dict[str, str | None]) -> str:
    def quoted(s: str) -> str:
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            s = s.replace(a, b)
        return f'"{s}"'

    return "---\n" + "".join(f"{k}: {quoted(v)}\n" for k, v in meta.items() if v) + "---\n\n"


def convert(html: str | None, base: str | None = None, options: Options = Options()) -> str | None:
    """Markdown of a page; null for null or nesting over MAX_DEPTH; empty for empty. A page without content is one newline."""
    if not html:
        return html
    tree = parse(html)
    w = Writer(options, base)
    if sys.getrecursionlimit() < RECURSION:
        sys.setrecursionlimit(RECURSION)  # a level of nesting takes a few calls
    try:
        w.walk(tree)
    except ValueError:
        return None
    return normalise((front_matter(metadata(tree, base)) if options.front_matter else "") + str(w.buf))


def html_to_markdown(html: Column, base: Column | None = None, options: Options = Options()) -> Column:
    @F.pandas_udf(T.StringType())
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([convert(x, y, options) for x, y in zip(h, b)], dtype=object)

    return run(html, base if base is not None else F.lit(None).cast("string"))


META = "struct<title:string,description:string,url:string,image:string,author:string,published:string>"


def html_metadata(html: Column, base: Column) -> Column:
    @F.pandas_udf(META)
    def run(h: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([metadata(parse(x or ""), y) for x, y in zip(h, b)], columns=["title", "description", "url", "image", "author", "published"])

    return run(html, base)


def html_links(html: Column, base: Column) -> Column:
    """Array of (label, url) of a page's safe links, in order."""

    @F.pandas_udf("array<struct<label:string,url:string>>")
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(h, b):
            links = [(squeeze(plain(a)), a.attrs["href"]) for a in find(parse(x or ""), "a") if "href" in a.attrs]
            out.append([dict(label=t, url=resolve(u, y)) for t, u in links if t and not dangerous(u)])
        return pd.Series(out, dtype=object)

    return run(html, base)

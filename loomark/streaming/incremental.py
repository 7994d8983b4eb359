"""Markdown while a page arrives: bytes go in chunk by chunk, finished lines come out at the ends of blocks.

A page is a Feed. It decodes its bytes with a carried tail, in the charset given or told by a meta tag in the first SNIFFED bytes
(which are held until then), cuts tokens that are complete, drops what is unsafe or noise, follows
the open blocks and writes. What it can't do without the whole page (tables, drawings) it leaves to the converter of whole
pages, as long as nothing has been given out; after that it closes what is open. Memory is bounded by Limits, not by the page.

Text up to the next tag is one piece, as long as it is under `lookahead`; so results don't depend on how a page is cut.

convert_stream() runs feeds over a table of chunks: a grouped map on a batch frame, a state per page on a stream. The state is
the pickled feed and the chunks that came too early; a page that stays silent for longer than the timeout is given out as it is.
"""

from __future__ import annotations

import codecs
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomark.functions.html5 import RAW, RCDATA, VOID, attributes
from loomark.functions.markdown import LANGUAGE, WS, Options, convert, dangerous, label, resolve_metadata, squeeze
from loomark.sources.decoding import codec_labels, decode_bytes, single_byte

TAG = re.compile(r"<(?:!--(.*?)-->|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?]([^>]*)>)", re.S)
# fixed values
DROPPED = frozenset(("script", "style", "noscript", "applet"))
EMBEDDED = frozenset(("iframe", "object", "embed", "video", "audio", "source", "track", "area"))
FORMS = frozenset(("form", "button", "select", "textarea", "fieldset", "legend", "label", "option", "optgroup", "datalist", "output", "input"))
TABLE = frozenset(("table", "thead", "tbody", "tr", "th", "td"))
DRAWN = frozenset(("svg", "math", "canvas"))
MAX_DEPTH, FRAME = 1000, 64
SNIFFED = 1024
META = [re.compile(p, re.I) for p in (r"<meta\s+charset\s*=\s*[\"']?([^\"'>;\s/]+)", r"<meta[^>]+charset\s*=\s*[\"']?([^\"'>;\s/]+)")]
# fixed values: start tags that end others, what they end and where the search stops
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IN_BUTTON = frozenset("applet button caption html marquee object table td th template".split())
RUBY = (frozenset(("rb", "rt", "rtc", "rp")), frozenset(("html", "ruby", "table", "template")))
OPTION = frozenset(("datalist", "select", "template"))
ENDS = {
    "li": [(frozenset(("li",)), frozenset("applet caption html marquee menu object ol table td th template ul".split()))],
    **dict.fromkeys(("dt", "dd"), [(frozenset(("dt", "dd")), frozenset(("dl", "html", "table", "template")))]),
    **dict.fromkeys(("rb", "rt", "rtc", "rp"), [RUBY]),
    "option": [(frozenset(("option",)), OPTION)],
    "optgroup": [(frozenset(("option",)), OPTION), (frozenset(("optgroup",)), OPTION)],
}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li pre blockquote ul ol".split())
SAME = {"b": "strong", "i": "em"}


class Fallback(Exception):
    """The page needs the converter of whole pages; nothing has been given out."""


class Stopped(Exception):
    """The page can't go on: over a limit, bytes that are no UTF-8, or something that needs the whole page too late."""


@dataclass
class Limits:
    """Bytes: of all input, of open blocks, of pending output, of one token or text."""

    total: int = 0
    stack: int = 64 << 10
    output: int = 256 << 10
    lookahead: int = 64 << 10


@dataclass
class Stats:
    chunks: int = 0
    tokens: int = 0
    flushes: int = 0
    peak: int = 0
    chars: int = 0


class Inflater:
    """Bytes of a gzip, deflate or identity body, chunk by chunk. A decompressor can't be stored: what it has read is stored
    instead and read again."""

    def __init__(self, encoding: str = "identity"):
        self.encoding, self.seen, self._d = encoding, b"", None

    def __getstate__(self):
        return {"encoding": self.encoding, "seen": self.seen, "_d": None}

    def feed(self, data: bytes) -> bytes:
        if self.encoding == "identity":
            return data
        try:
            out = self._decompressor().decompress(data)
        except zlib.error as e:
            raise Stopped("decompression_format_error") from e
        self.seen += data
        return out

    def _decompressor(self):
        if self._d is None:
            self._d = zlib.decompressobj(31 if self.encoding == "gzip" else -15)
            self._d.decompress(self.seen)
        return self._d

    def finish(self) -> None:
        if self.encoding != "identity" and not self._decompressor().eof:
            raise Stopped("decompression_truncated_input")


@dataclass
class Output:
    """Text that waits for the end of a block, and text that is ready."""

    limit: int
    pending: list[str] = field(default_factory=list)
    size: int = 0
    ready: str = ""
    fresh: bool = False  # the last character is a newline
    blanks: int = 0
    quotes: int = 0
    gap: bool = False  # a block has ended

    def raw(self, s: str) -> None:
        self.size += len(s)
        if self.size > self.limit:
            raise Stopped("budget_exceeded")
        self.pending.append(s)

    def put(self, s: str) -> None:
        for i, part in enumerate(s.replace("\r", "").split("\n")):
            if i and not (self.fresh and self.blanks):
                self.blanks = self.blanks + 1 if self.fresh else 0
                self.fresh = True
                self.raw("\n" + "> " * self.quotes)
            if part:
                self.raw(part)
                self.fresh, self.blanks = False, 0

    def open_block(self) -> None:
        if self.gap:
            self.put("\n")
            self.blanks = 0
        self.gap = False

    def flush(self) -> None:
        self.ready += "\n".join(line.rstrip(WS) for line in "".join(self.pending).split("\n"))
        if len(self.ready) > self.limit:
            raise Stopped("budget_exceeded")
        self.pending, self.size = [], 0

    def take(self, last: bool = False) -> str:
        out, self.ready = self.ready, ""
        if last:
            out = re.sub("\n+$", "\n", out)
            if out and not out.endswith("\n"):
                out += "\n"
        return out


class Feed:
    def __init__(self, options: Options = Options(), base: str | None = None, limits: Limits = Limits(), threshold: int = 0, encoding: str = "identity", charset: str | None = "UTF-8"):
        """charset: a label; None to look for one in the page."""
        self.o, self.base, self.limits, self.threshold = options, base, limits, threshold
        self.body, self.decoder_state, self.text = Inflater(encoding), (b"", 0), ""
        self.charset, self.codec, self.sniffed = charset, None, b""
        self.raw_until: str | None = None
        self.out, self.stats, self.committed = Output(limits.output), Stats(), False
        self.skip: list = []  # what is unsafe: its tag and the depth within it
        self.prune: list = []  # what is noise
        self.open: list[str] = []
        self.blocks: list[list] = []  # tag and what belongs to it
        self.code: list[str] | None = None
        self.link: list[str] | None = None
        self.bytes = 0
        self.in_head, self.title, self.canonical, self.in_title = False, "", None, False

    # bytes to tokens

    def feed(self, data: bytes) -> str:
        """Takes the next bytes; gives the Markdown that is ready."""
        self.stats.chunks += 1
        self.bytes += len(data)
        if self.limits.total and self.bytes > self.limits.total:
            raise Stopped("budget_exceeded")
        return self._take(self._decode(self.body.feed(data), False), False)

    def finish(self) -> str:
        """The rest, with all blocks closed."""
        self.body.finish()
        out = self._take(self._decode(b"", True), True)
        return out + self._close()

    def abort(self) -> str:
        """Closes what has been given out already; what has not is dropped."""
        self.out.pending, self.out.size, self.out.ready, self.code, self.link = [], 0, "", None, None
        return self._close()

    def _close(self) -> str:
        while self.blocks:
            self._leave(self.blocks.pop())
        self.out.flush()
        return self._count(self.out.take(True))

    def _count(self, out: str) -> str:
        self.stats.chars += len(out)
        return out

    def _decode(self, data: bytes, last: bool) -> str:
        if self.codec is None:
            self.sniffed += data
            if self.charset is None:
                if len(self.sniffed) < SNIFFED and not last:
                    return ""
                head = self.sniffed[:SNIFFED].decode("latin-1")
                self.charset = next((m[1] for p in META if (m := p.search(head))), "UTF-8")
            data, self.sniffed = self.sniffed, b""
            self.codec = codec_labels().get(self.charset.strip().lower())
            if self.codec is None:
                raise Stopped("encoding_error")
        try:
            if (table := single_byte(self.codec)) is not None:
                return codecs.charmap_decode(data, "strict", table)[0]
            decoder = codecs.getincrementaldecoder(self.codec)("strict")
            decoder.setstate(self.decoder_state)
            text = decoder.decode(data, last)
        except UnicodeDecodeError as e:
            raise Stopped("encoding_error") from e
        self.decoder_state = decoder.getstate()
        return text

    def _take(self, text: str, last: bool) -> str:
        self.text += text
        self.stats.peak = max(self.stats.peak, len(self.text) + self.out.size + len(self.out.ready) + FRAME * len(self.blocks))
        for kind, name, attrs in self._tokens(last):
            self.stats.tokens += 1
            self._event(kind, name, attrs)
        out = self._count(self.out.take())
        self.committed = self.committed or bool(out)
        return out

    def _tokens(self, last: bool) -> Iterator[tuple[str, str, dict | None]]:
        """Complete tokens; what may go on with the next chunk is held."""
        if not last and self.text.endswith("\r"):
            text, held = self.text[:-1], "\r"
        else:
            text, held = self.text, ""
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        at, n = 0, len(text)
        while at < n:
            if self.raw_until:
                m = re.compile(rf"</{self.raw_until}(?=[\s/>])", re.I).search(text, at)
                if not m and not last:
                    if self.raw_until in DROPPED:  # but for what may be the beginning of the end
                        at = max(at, n - len(self.raw_until) - 3)
                    break
                end = m.start() if m else n
                if end > at:
                    yield "text", unescape(text[at:end]) if self.raw_until in RCDATA else text[at:end], None
                at, self.raw_until = end, None
                continue
            begin = text.find("<", at)
            if begin != at:
                if begin < 0 and not last:
                    break
                end = begin if begin > 0 else n
                yield "text", unescape(text[at:end]), None
                at = end
                continue
            m = TAG.match(text, at)
            if not m:
                if not last and re.match(r"<(/?[A-Za-z]|/?$|[!?])", text[at:]):
                    break
                if re.match(r"</?[A-Za-z!]", text[at : at + 3]):
                    at = n  # an unfinished tag at the end
                    break
                end = text.find("<", at + 1)
                if end < 0 and not last:
                    break
                end = end if end > 0 else n
                yield "text", unescape(text[at:end]), None
                at = end
                continue
            at = m.end()
            if m[3]:
                name = m[3].lower()
                if m[2]:
                    yield "end", name, None
                else:
                    yield "start", name, attributes(m[4]) | ({"/": ""} if m[4].endswith("/") else {}) if m[4] else {}
                    if name in RAW or name in RCDATA:
                        self.raw_until = name
        self.text = text[at:] + held
        if len(self.text) > self.limits.lookahead:
            if self.text.startswith("<") or self.raw_until:
                raise self._needs_whole("lookahead_exceeded")
            cut = max(self.text.rfind(c) for c in " \n\t")
            rest, self.text = (self.text[cut:], self.text[:cut]) if cut > 0 else ("", self.text)
            yield "text", unescape(self.text), None
            self.text = rest

    def _needs_whole(self, what: str) -> Exception:
        return Stopped(f"{what}_after_commit") if self.committed else Fallback(what)

    # what goes on to the blocks

    def _event(self, kind: str, name: str, attrs: dict | None) -> None:
        self._head(kind, name, attrs)
        if kind == "start" and name in DRAWN:
            raise self._needs_whole(name)
        if self.skip or self.prune:
            self._left_out(kind, name, attrs)
        elif kind == "text":
            self._text(name)
        elif kind == "start":
            self._start(name, attrs)
        else:
            self._pop_open(name)
            if name not in EMBEDDED and name not in FORMS:
                self._end(name)

    def _head(self, kind: str, name: str, attrs: dict | None) -> None:
        if kind == "start" and name in ("head", "body"):
            self.in_head = name == "head"
        elif kind == "end" and name == "head":
            self.in_head = False
        elif self.in_head and kind == "start" and name == "link" and self.canonical is None and "canonical" in attrs.get("rel", "").lower().split():
            self.canonical = attrs.get("href")
        if self.in_head and name == "title":
            self.in_title = kind == "start" and not self.title
        elif self.in_title and kind == "text":
            self.title = (self.title + name)[: self.limits.lookahead]

    def _left_out(self, kind: str, name: str, attrs: dict | None) -> None:
        region = self.skip or self.prune
        if kind == "start" and name not in VOID and "/" not in attrs:
            if name in DROPPED and not self.skip:
                self.skip[:] = [name, 1]
            else:
                region[1] += 1
        elif kind == "end" and region[1] > 1:
            region[1] -= 1
        elif kind == "end" and name == region[0]:
            region.clear()
            self._pop_open(name)

    def _start(self, name: str, attrs: dict) -> None:
        alone = name in VOID or "/" in attrs
        if name in CLOSES_P:
            self._imply(frozenset(("p",)), IN_BUTTON)
        for targets, stops in ENDS.get(name, ()):
            self._imply(targets, stops)
        if name in ("link", "base"):
            return
        if name in DROPPED or (self.o.prune and name in self.o.noise):
            if not alone:
                (self.skip if name in DROPPED else self.prune)[:] = [name, 1]
            return
        if not alone:
            self.open.append(name)
            if len(self.open) > MAX_DEPTH:
                raise Stopped("nesting_depth")
        if name in EMBEDDED:
            keys = ("href", "src") if name == "area" else ("src", "data") if name in ("iframe", "object", "embed") else ("src",)
            url = next((attrs[k] for k in keys if k in attrs), None)
            if url is not None and not dangerous(url):
                self._text(f"[{name}]({destination(url)})")
        elif name not in FORMS:
            self._enter(name, {k: v for k, v in attrs.items() if k != "style" and not (k in ("href", "src") and dangerous(v))}, alone)

    def _imply(self, targets: frozenset, stops: frozenset) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i] in targets or self.open[i] in stops), None)
        if at is not None and self.open[at] in targets:
            gone, self.open = self.open[at:], self.open[:at]
            for name in reversed(gone):
                self._end(name)

    def _pop_open(self, name: str) -> None:
        if name in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(name) :]

    # blocks

    def _depth(self) -> int:
        return sum(b[0] in ("ul", "ol") for b in self.blocks)

    def _enter(self, name: str, attrs: dict, alone: bool) -> None:
        out = self.out
        if name in TABLE:
            raise self._needs_whole("table")
        if name == "img":
            self._inline(f"![{label(attrs.get('alt', ''))}]({destination(attrs.get('src', ''))})", within_link=False)
            return
        if name == "code" and self.blocks and self.blocks[-1][0] == "pre" and self.blocks[-1][1] is None:
            self.blocks[-1][1] = next((m[1] for m in map(LANGUAGE.fullmatch, attrs.get("class", "").split()) if m), None)
            return
        if name not in BLOCKS and name not in MARKS and name != "a":
            return
        if FRAME * (len(self.blocks) + 1) > self.limits.stack:
            raise Stopped("budget_exceeded")
        block = [name, None]
        if name in ("ul", "ol"):
            block[1] = int(attrs["start"]) if name == "ol" and re.fullmatch(r"\+?[0-9]{1,9}", attrs.get("start", "")) else 1
            if not self._depth():
                out.open_block()
        elif name == "li":
            lists = [b for b in self.blocks if b[0] in ("ul", "ol")]
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            out.put("  " * max(0, len(lists) - 1) + mark)
        elif name == "a":
            block[1] = attrs.get("href", "")
            self.link = []
        elif name in MARKS:
            self._inline(MARKS[name])
        else:
            out.open_block()
            if name == "pre":
                self.code = []
            elif name == "blockquote":
                out.quotes += 1
                out.raw("> " * out.quotes)
            elif name != "p":
                out.put("#" * int(name[1]) + " ")
        self.blocks.append(block)

    def _end(self, name: str) -> None:
        kin = SAME.get(name, name)
        at = next((i for i in range(len(self.blocks) - 1, -1, -1) if SAME.get(self.blocks[i][0], self.blocks[i][0]) == kin), None)
        if at is not None:
            gone, self.blocks = self.blocks[at:], self.blocks[:at]
            for block in reversed(gone):
                self._leave(block)

    def _leave(self, block: list) -> None:
        name, own = block
        out = self.out
        if name == "a":
            text, self.link = "".join(self.link or []), None
            if text.strip(WS):
                out.put(label(text) if not own.strip(WS) or dangerous(own) else f"[{label(text)}]({destination(own)})")
        elif name in MARKS:
            self._inline(MARKS[name])
        elif name == "pre":
            self._fence(own)
        elif name == "li":
            if not out.fresh:
                out.put("\n")
        elif name == "blockquote":
            out.quotes -= 1
            out.gap = True
        elif name in ("ul", "ol"):
            out.gap = True
        else:
            out.put("\n")
            out.gap = True
        if name in BLOCKS and out.size >= self.threshold and out.size:
            out.flush()
            self.stats.flushes += 1

    def _fence(self, language: str | None) -> None:
        text, self.code, out = "".join(self.code or []), None, self.out
        run = max((len(x) for x in re.findall("`+", text)), default=0)
        fence = "`" * max(3, run + 1)
        prefix = "> " * out.quotes
        out.put(f"{fence}{language or ''}\n")
        body = text.replace("\n", "\n" + prefix)
        out.raw(body if not body or body.endswith("\n" + prefix) else body + "\n")
        out.fresh, out.blanks = True, 0
        out.raw(fence + "\n" + prefix)
        out.gap = True

    def _inline(self, mark: str, within_link: bool = True) -> None:
        if within_link and self.link is not None:
            self.link.append(mark)
        else:
            self.out.put(mark)

    def _text(self, data: str) -> None:
        if self.link is not None:
            self._hold(self.link, data)
        elif self.code is not None:
            if sum(map(len, self.code)) + len(data) + self.out.size > self.limits.output:
                raise Stopped("budget_exceeded")
            self.code.append(data)
        elif data:
            body = squeeze(data)
            self.out.put((" " if data[0] in WS else "") + body + (" " if data[-1] in WS else "") if body else " ")

    def _hold(self, parts: list[str], data: str) -> None:
        """Labels end in ... where they would pass the limit of pending output."""
        room = self.limits.output - sum(map(len, parts))
        if room >= 0 and len(data) > room:
            parts[:] = ["".join(parts)[: max(0, self.limits.output - 3)], "..."]
            parts.append("")
            return
        if room >= 0:
            parts.append(data)

    def metadata(self) -> tuple[str | None, str | None]:
        """Title and url as far as the head tells them."""
        to = resolve_metadata(self.canonical, self.base) if self.canonical else self.base
        return self.title.strip(WS) or None, to if to and not dangerous(to) else None


def destination(url: str) -> str:
    """A destination in angle brackets where it needs them."""
    if not re.search(r"[ ()<>\\\n\r]", url):
        return url
    for a, b in (("\\", "\\\\"), ("<", "\\<"), (">", "\\>"), ("\n", "\\n"), ("\r", "\\r")):
        url = url.replace(a, b)
    return f"<{url}>"


OUT = "page_id long, markdown string, status string, reason string, title string, canonical string, n_chunks int, n_tokens long, n_flushes int, peak int"


class Page:
    """A feed, what it gave out, and chunks that came before their turn; bytes are kept until something is given out, so that
    the converter of whole pages can take over."""

    def __init__(self, options: Options, base: str | None, limits: Limits, threshold: int, encoding: str, charset: str | None):
        self.feed, self.options, self.base = Feed(options, base, limits, threshold, encoding, charset), options, base
        self.next, self.last, self.early, self.given, self.replay = 0, -1, {}, "", []
        self.ended: tuple[str, str | None] | None = None

    def add(self, seq: int, chunk: bytes, is_last: bool) -> None:
        if seq >= self.next:
            self.early[seq] = chunk
        self.last = seq if is_last else self.last
        while self.next in self.early:
            self._step(self.early.pop(self.next))
            self.next += 1

    def _step(self, chunk: bytes) -> None:
        if self.ended:
            if self.ended[0] == "fallback":
                self.replay.append(chunk)
            return
        if not self.feed.committed:
            self.replay.append(chunk)
        self._guard(lambda: self.feed.feed(chunk))
        if self.feed.committed and not (self.ended and self.ended[0] == "fallback"):
            self.replay = []

    def _guard(self, step) -> None:
        try:
            self.given += step()
        except Fallback as e:
            self.ended = "fallback", str(e)
        except Stopped as e:
            self.ended = "failed", str(e)
            if self.feed.committed:
                self.given += self.feed.abort()

    def done(self) -> bool:
        return self.last >= 0 and self.next > self.last

    def row(self, key: int, complete: bool = True) -> pd.DataFrame:
        if not self.ended and complete:
            self._guard(self.feed.finish)
        status, reason = self.ended or ("converted" if complete else "abandoned", None)
        text = self.given
        if not complete and not self.ended and self.feed.committed:
            text += self.feed.abort()
        if status == "fallback":
            inflater = Inflater(self.feed.body.encoding)
            try:
                body = decode_bytes(b"".join(map(inflater.feed, self.replay)), self.feed.charset or "UTF-8")
                if body is None:
                    raise Stopped("encoding_error")
                text = convert(body, self.base, self.options)
            except Stopped as e:
                status, text, reason = "failed", None, str(e)
        elif status == "failed" and not self.feed.committed:
            text = None
        s, (title, url) = self.feed.stats, self.feed.metadata()
        return pd.DataFrame([[key, text, status, reason, title, url, self.next, s.tokens, s.flushes, s.peak]], columns=[x.split()[0] for x in OUT.split(", ")])


def convert_stream(chunks: DataFrame, options: Options = Options(), limits: Limits = Limits(), threshold: int = 0, encoding: str = "identity", charset: str | None = "UTF-8", timeout_seconds: int = 600) -> DataFrame:
    """chunks (page_id, url, seq, chunk, is_last) -> a row per page (OUT): converted, fallback (by the converter of whole pages),
    failed, or, on a stream, abandoned. Chunks may come in any order and twice; a null id is a page of its own."""
    new = lambda url: Page(options, url, limits, threshold, encoding, charset)
    if not chunks.isStreaming:

        def whole(key, df: pd.DataFrame) -> pd.DataFrame:
            page = new(df["url"].iloc[0])
            for seq, chunk, is_last in sorted(zip(df["seq"], df["chunk"], df["is_last"])):
                page.add(int(seq), bytes(chunk), bool(is_last))
            return page.row(key[0], page.done())

        return chunks.groupBy("page_id").applyInPandas(whole, OUT)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page = pickle.loads(state.get[0]) if state.exists else new(key[1])
        if state.hasTimedOut:
            state.remove()
            yield page.row(key[0], False)
            return
        for df in frames:
            for seq, chunk, is_last in sorted(zip(df["seq"], df["chunk"], df["is_last"])):
                page.add(int(seq), bytes(chunk), bool(is_last))
        if page.done():
            if state.exists:
                state.remove()
            yield page.row(key[0])
        else:
            state.update((pickle.dumps(page),))
            state.setTimeoutDuration(1000 * timeout_seconds)

    return chunks.groupBy("page_id", "url").applyInPandasWithState(step, OUT, "page binary", "append", GroupStateTimeout.ProcessingTimeTimeout)

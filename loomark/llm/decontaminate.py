"""Benchmark decontamination by the q-gram lemma.

Benchmark items and documents are lower-cased and their white space is collapsed. An item is searched for in windows of
WINDOW characters, STRIDE apart (the last one at its end; shorter items whole). A window of length m that occurs with at
most k = ERROR * m edits shares at least m - q + 1 - k * q of its q-grams with the text, on diagonals k apart at most. So
shared q-grams are counted in overlapping bands of diagonals (each 2 * (k + 1) wide, one begins every k + 1), bands below that
bound are dropped, and the others are verified by a banded alignment of the window within the band's region.

A document is contaminated if any window is verified in it. Windows of one item that are found give one span. Every verbatim
quote of WINDOW + STRIDE - 1 characters holds a whole window, and is found; most that lack up to ERROR * WINDOW of that are too.
Items under Q characters have no q-gram; they are looked for exactly, as whole words.

A block of the benchmark, of BLOCK_CHARS at most, is searched for in a pass of its own, whose result is written before the next
one begins: driver and tasks hold one block at a time. Shared q-grams are counted in pieces of POSTINGS, and bands are
settled as soon as the text is past them, so that a gram common to many windows costs time, not memory.

Defined cases: null and empty texts and items are empty and never match; null item ids are reported as null; null ids and
repeated rows are kept row by row; empty tables give no rows; other columns pass through find().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomark.llm.common import aside, cut, remove, table

Q = 8
WINDOW, STRIDE = 100, 20
ERROR = 0.1
BLOCK_CHARS = 4 << 20
CHUNK_CHARS = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
BITS = 22
POSTINGS = 1 << 21
HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())])


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(c: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from each position on."""
    h, width, power = c.astype(np.uint64), 1, BASE
    while width < Q:
        h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
        width, power = 2 * width, power * power
    return h * np.uint64(0xC2B2AE3D27D4EB4F)


def aligned(windows: np.ndarray, c: np.ndarray, first: np.ndarray, width: int, begin_at: np.ndarray, end_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best banded alignment of each window (one row each) with the characters c[begin_at:end_at], on diagonals
    first .. first + width - 1: edits, start, end."""
    big = 1 << 20
    n, m = windows.shape
    at = first[:, None] + np.arange(width)
    lo, hi = begin_at[:, None], end_at[:, None]
    cost, begin, step = np.where((at >= lo) & (at <= hi), 0, big), at.copy(), np.arange(width)
    out_cost, out_begin = np.full((n, 1), big), np.zeros((n, 1), at.dtype)
    for i in range(m):
        col = at + i
        same = c[np.clip(col, 0, len(c) - 1)] == windows[:, i : i + 1]
        swap = np.where((col >= lo) & (col < hi), cost + ~same, big)
        skip = np.hstack([cost[:, 1:] + 1, out_cost])  # a character of the window is missing in the text
        new = np.minimum(swap, skip)
        start = np.where(swap <= skip, begin, np.hstack([begin[:, 1:], out_begin]))
        lowest = np.minimum.accumulate(new - step, axis=1)  # characters of the text that the window lacks
        source = np.maximum.accumulate(np.where(new - step == lowest, step, 0), axis=1)
        cost = np.where((col + 1 >= lo) & (col + 1 <= hi), lowest + step, big)
        begin = np.take_along_axis(start, source, 1)
    best = cost.argmin(1)[:, None]
    edits, start, end = (np.take_along_axis(x, best, 1)[:, 0] for x in (cost, begin, at + m))
    return edits, start, end


class Index:
    """The windows of a block of items; one per Python worker."""

    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        self.items = [item for item, _ in items]
        self.windows: list[tuple[int, np.ndarray, int, int]] = []  # the item by its place
        short: dict[str, list[int]] = {}
        for item, (_, text) in enumerate(items):
            own = normal(text)
            c = codes(own)
            if len(c) < Q:
                if own:
                    short.setdefault(own, []).append(item)
                continue
            starts = list(range(0, max(1, len(c) - WINDOW + 1), STRIDE))
            if starts[-1] + WINDOW < len(c):
                starts.append(len(c) - WINDOW)
            for s in starts:
                w = c[s : s + WINDOW]
                k = min(int(ERROR * len(w)), (len(w) - Q) // Q)
                self.windows.append((item, w, k, len(w) - Q + 1 - k * Q))
        self.short = ahocorasick.Automaton() if short else None
        for own, places in short.items():
            self.short.add_word(own, (len(own), places))
        if short:
            self.short.make_automaton()
        self.step = int(ERROR * WINDOW) + 1
        hs = [grams(w) for _, w, _, _ in self.windows]
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(hs)), [len(x) for x in hs]) if hs else np.zeros(0, int)
        at = np.concatenate([np.arange(len(x)) for x in hs]) if hs else np.zeros(0, int)
        order = np.argsort(h, kind="stable")
        self.owner, self.at = owner[order], at[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << BITS, bool)
        self.table[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.need = np.array([w[3] for w in self.windows], np.int64)

    def candidates(self, c: np.ndarray) -> list[tuple[int, int]]:
        """(window, first diagonal) of the bands that hold enough shared q-grams."""
        h = grams(c)
        i = np.flatnonzero(self.table[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(i) or not len(self.keys):
            return []
        k = np.minimum(np.searchsorted(self.keys, h[i]), len(self.keys) - 1)
        real = self.keys[k] == h[i]
        i, k = i[real], k[real]
        n = self.count[k]
        span = (len(c) + 2 * WINDOW) // self.step + 2
        total, begin, out = np.cumsum(n), 0, []
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of bands that the text is not past yet
        while begin < len(i):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + POSTINGS, "right")))
            own, m = slice(begin, end), n[begin:end]
            post = np.repeat(self.first[k[own]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            owner = self.owner[post]
            band = (np.repeat(i[own], m) - self.at[post] + WINDOW) // self.step
            new, many = np.unique(np.concatenate([owner * span + band, owner * span + np.maximum(band - 1, 0)]), return_counts=True)
            if len(keys):
                new, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                many = np.bincount(at, np.concatenate([counts, many])).astype(np.int64)
            past = np.ones(len(new), bool) if end == len(i) else (new % span + 2) * self.step < i[end]
            out.append(new[past & (many >= self.need[new // span])])
            keys, counts, begin = new[~past], many[~past], end
        return [(int(x // span), int(x % span) * self.step - WINDOW) for x in (np.concatenate(out) if out else [])]

    def exact(self, text: str) -> list[tuple[int, int, int, int]]:
        """Hits of the short items in a normal text, as whole words."""
        out = []
        for last, (size, places) in self.short.iter(text):
            a, b = last + 1 - size, last + 1
            if not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[last].isalnum()):
                out += [(item, a, b, 0) for item in places]
        return out

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text the hits (item, start, end, edits), in characters of the text, in the items' order and by start."""
        norm = [normal(t) for t in texts]
        sizes = np.array([len(x) for x in norm]) + 1
        begins = np.concatenate([[0], np.cumsum(sizes)])
        c = codes("\0".join(norm) + "\0")
        found: dict[int, set] = {}
        todo: dict[int, list[tuple[int, int, int]]] = {}  # by the window's length: window, diagonal, text
        for w, diagonal in self.candidates(c):
            m = len(self.windows[w][1])
            d0, d1 = np.searchsorted(begins, (max(diagonal, 0), min(diagonal + 2 * self.step + m, len(c) - 1)), "right") - 1
            todo.setdefault(m, []).extend((w, diagonal, d) for d in range(int(d0), min(int(d1), len(texts) - 1) + 1))
        for jobs in todo.values():
            for j in range(0, len(jobs), 4096):
                part = jobs[j : j + 4096]
                d = np.array([x[2] for x in part])
                rows = np.stack([self.windows[x[0]][1] for x in part])
                edits, start, end = aligned(rows, c, np.array([x[1] for x in part]), 2 * self.step, begins[d], begins[d + 1] - 1)
                for x, k, a, b in zip(part, edits.tolist(), (start - begins[d]).tolist(), (end - begins[d]).tolist()):
                    item, _, most, _ = self.windows[x[0]]
                    if k <= most:
                        found.setdefault(x[2], set()).add((item, a, b, k))
        if self.short is not None:
            for d, text in enumerate(norm):
                if hits := self.exact(text):
                    found.setdefault(d, set()).update(hits)
        out: list[list] = [[] for _ in texts]
        for d, hits in found.items():
            place = positions(texts[d])
            merged: list[list[int]] = []
            for item, s, e, edits in sorted(hits):
                if merged and merged[-1][0] == item and s <= merged[-1][2]:
                    merged[-1][2], merged[-1][3] = max(merged[-1][2], e), max(merged[-1][3], edits)
                else:
                    merged.append([item, s, e, edits])
            out[d] = [(self.items[item], place[s], place[e - 1] + 1, edits) for item, s, e, edits in merged]
        return out


def positions(text: str) -> list[int]:
    """For each character of normal(text) the position in text that it comes from."""
    out, gap = [], False
    for i, ch in enumerate(text):
        if ch.isspace():
            gap = bool(out)
            continue
        if gap:
            out.append(i - 1)
            gap = False
        out += [i] * len(ch.lower())
    return out


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[int, Iterator[list[tuple[int | None, str]]]]:
    """The number of blocks, and the items of each, one block at a time, by id."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = -(-2 * total // block_chars) or 1

    def each() -> Iterator[list[tuple[int | None, str]]]:
        for b in range(n):
            part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
            yield sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    return n, each()


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep_text: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with the column _hits: array of (item_id, start, end, edits); without the text unless keep_text."""
    spark = docs.sparkSession
    docs, back = aside(docs, text_col)
    out = docs.withColumn("_hits", F.array().cast(T.ArrayType(HIT)))
    n, parts = blocks(benchmark, block_chars=block_chars)
    written = None
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in HIT]))
    for number, items in enumerate(parts):
        if number:
            old = written
            out, written = cut(out, f"hits_{number}")
            if old:
                remove(spark, old)
        shared = spark.sparkContext.broadcast(items)
        drop = not keep_text and number == n - 1
        names = [c for c in out.columns if c != "_hits" and not (drop and c == text_col)]
        at, hits_at = out.columns.index(text_col), out.columns.index("_hits")
        schema = T.StructType([*[out.schema[c] for c in names], T.StructField("_hits", T.ArrayType(HIT))])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names, at=at, hits_at=hits_at) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                size = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(at)], np.int64)
                part_of = np.concatenate([[0], np.cumsum(size)[:-1]]) // CHUNK_CHARS if len(size) else size
                for p in np.unique(part_of):
                    a, b = int(np.searchsorted(part_of, p)), int(np.searchsorted(part_of, p, "right"))
                    part = batch.slice(a, b - a)
                    new = index.search(part.column(at).to_pylist())
                    old = part.column(hits_at).to_pylist()
                    hits = [(o or []) + [dict(item_id=i, start=s, end=e, edits=k) for i, s, e, k in n] for o, n in zip(old, new)]
                    yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], pa.array(hits, kind)], [*names, "_hits"])

        out = out.mapInArrow(run, schema)
    return back(out)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: their items, and the spans item:start:end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"), keep_text=False).where(F.size("_hits") > 0)
    return found.select(
        "doc_id",
        F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["item_id"]))).alias("item_ids"),
        F.size("_hits").cast("long").alias("n_spans"),
        F.array_join(F.transform("_hits", lambda h: F.concat_ws(":", h["item_id"], h["start"], h["end"])), ",").alias("spans"),
    )

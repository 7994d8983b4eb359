"""Byte-level BPE over Arrow batches, with the tokenizers library.

The rank file gives the vocabulary; every way to cut a token into two tokens of lower rank is a merge, in rank order,
so that the merges are those of a rank-driven encoder. Text is cut into pieces by `pattern`; each distinct piece of a
batch goes through the tokenizer once and stays in a bounded cache. Ids are little-endian unsigned 32-bit integers in a
BINARY column, which Spark hashes, stores and measures itself.

Decoding reverses the byte table: an id gives its token in the table's characters, a document's tokens are joined, and each
character goes back to its byte; only then are the bytes read as UTF-8, so that characters split over several tokens come
back whole. offsets() maps a document's tokens to character spans; tokens that share a split character share its position.

Defined cases: a null text is empty; an empty text has no ids and decodes to no bytes; null ids and repeated rows are
kept row by row; an empty table gives no rows; other columns are dropped; very long texts are cut piece by piece, and
special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.llm.common import small_batches, table

CACHE_PIECES = 1 << 17
#: Longer pieces are not kept in the cache.
CACHE_CHARS = 64
BATCH_BYTES = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_table() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return [out[b] for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one rank file; one per Python worker."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.cache: dict[str, bytes] = {}
        self._tokenizer = None

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer, models, pre_tokenizers

            chars, ranks = byte_table(), self.ranks
            as_text = lambda b: "".join(map(chars.__getitem__, b))
            merges = [
                (as_text(t[:i]), as_text(t[i:]))
                for t, _ in sorted(ranks.items(), key=lambda x: x[1])
                for i in range(1, len(t))
                if t[:i] in ranks and t[i:] in ranks
            ]
            model = models.BPE({as_text(t): r for t, r in ranks.items()}, merges, ignore_merges=True, cache_capacity=0)
            self._tokenizer = Tokenizer(model)
            self._tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return self._tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        new = list({p for ps in pieces for p in ps if p not in cache})
        long: dict[str, bytes] = {}
        if new:
            coded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            for p, c in zip(new, coded):
                (cache if len(p) <= CACHE_CHARS else long)[p] = np.asarray(c.ids, "<u4").tobytes()
        if long:
            return [b"".join([cache.get(p) or long[p] for p in ps]) for ps in pieces]
        return [b"".join(map(cache.__getitem__, ps)) for ps in pieces]


@lru_cache(2)
def codec(path: str) -> Codec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path)


def inverse_table() -> np.ndarray:
    """The byte of each character of byte_table(), by code point."""
    out = np.zeros(512, np.uint8)
    out[[ord(c) for c in byte_table()]] = np.arange(256)
    return out


class Reverse:
    """The vocabulary by id: tokens in the byte table's characters, and what offsets need of them."""

    def __init__(self, path: str):
        chars, ranks = byte_table(), load_ranks(path)
        n = max(ranks.values()) + 1
        self.inverse, self.names = inverse_table(), [""] * n
        #: Characters that begin in a token, and whether its first byte belongs to one that began before.
        self.begun, self.inside = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t, r in ranks.items():
            self.names[r] = "".join(map(chars.__getitem__, t))
            self.begun[r] = sum(b & 0xC0 != 0x80 for b in t)
            self.inside[r] = t[0] & 0xC0 == 0x80

    def decode(self, ids: bytes) -> bytes:
        text = "".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return self.inverse[np.frombuffer(text.encode("utf-16-le"), "<u2")].tobytes()

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(ids, "<u4")
        ends = np.cumsum(self.begun[at])
        return ends - self.begun[at] - self.inside[at], ends


@lru_cache(2)
def reverse(path: str) -> Reverse:
    return Reverse(path)


def decode_ids(ids: bytes, path: str) -> bytes:
    return reverse(path).decode(ids)


def offsets(ids: bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and exclusive last character of each token."""
    return reverse(path).offsets(ids)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH_BYTES each."""
    begin = 0
    total = np.cumsum(sizes)
    while begin < len(sizes):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + BATCH_BYTES, "right")))
        yield begin, end
        begin = end


def _sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_offsets: bool = False, with_decoded: bool = False
) -> DataFrame:
    """(id, ids binary) and, with_offsets, starts and ends: character positions, stored as ids are; with_decoded, decoded as of
    decode(), by the same Python worker: a second node has a second worker for each task, with a vocabulary of its own."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids binary" + ", starts binary, ends binary" * with_offsets + ", decoded binary" * with_decoded
    names = [id_col, "ids", *["starts", "ends"] * with_offsets, *["decoded"] * with_decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for a, b in _slices(_sizes(batch.column(1))):
                part = batch.slice(a, b - a)
                ids = own.encode(part.column(1).to_pylist())
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if with_offsets:
                    both = [offsets(x, path) for x in ids]
                    columns += [pa.array([x[i].astype("<u4").tobytes() for x in both], pa.binary()) for i in (0, 1)]
                if with_decoded:
                    columns.append(pa.array([decode_ids(x, path) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """coded with the column decoded (binary) added. decoded.cast('string') is the text."""
    path = path or default_path()
    rows = coded.select(id_col, *[c for c in ("ids", "starts", "ends") if c in coded.columns])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(_sizes(batch.column(1))):
                part = batch.slice(a, b - a)
                ids = part.column(1)
                out = [decode_ids(ids[i].as_buffer(), path) for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def digests(docs: DataFrame) -> DataFrame:
    both = encode(docs, with_offsets=True, with_decoded=True)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat("starts", "ends"), 256).alias("offsets_sha256"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

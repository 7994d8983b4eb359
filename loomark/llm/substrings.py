"""Exact substring deduplication: bytes covered by a LENGTH-byte string that also starts anywhere else are removed.

Bucket-pointer refinement over a sampled suffix array. A string of LENGTH bytes belongs to its anchor, the Q-gram of
lowest hash in it (the last one among equals), so that equal strings have equal anchors at equal offsets and only anchors
enter the first buckets, not every suffix. The strings of one anchor start side by side: they are its run.

1. Texts that occur twice or more are removed whole; one row of each stands for it from then on.
2. Initial buckets: anchors by their Q-gram's identifier. A bucket of one is done: its strings occur once.
3. A bucket's runs are refined by the identifier of all their bytes, from the first string's offset to the last one's. Runs that
   agree are duplicates as a whole, and one of them stands for its class. A bucket without other runs is done.
4. The strings of the runs that are left are refined recursively, by their anchors' offsets in ranges of GRIDS (the last of one
   offset). A bucket is that of the identifier which refines the anchor's bucket by the bytes that all strings of a range share;
   alone in it, all strings of a range occur once. Others are refined by the identifier of all bytes of the range: ranges that
   agree are duplicates as a whole and one of them stands for its class; in buckets of several classes each goes on to the next
   grid. So every step sorts by identifiers of the last one's buckets and of bytes at later offsets, and settles what it can.

Identifiers that only rule strings out are 64-bit polynomial hashes over random bytes' values, finally mixed. Those that prove
equality are 128-bit BLAKE2b digests of the bytes themselves, and texts are told apart by two 64-bit hashes. Buckets are counted
before they are shuffled, and the joins back are of many rows to one, which the engine splits where a key is hot. Memory of
a task is that of CHUNK bytes of text, a batch of rows, and a text with its open runs.

Defined cases: null and empty texts keep nothing and lose nothing; texts under LENGTH bytes stay; strings never cross
documents; overlapping occurrences in one document count; null ids and repeated rows are rows of their own; an empty table
gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.llm.common import cut, remove, small, small_batches, table

LENGTH, Q = 200, 64
#: Offsets in a range, step by step.
GRIDS = (32, 8, 1)
#: Offsets that an anchor may have in a string.
SPAN = LENGTH - Q + 1
CHUNK = 1 << 19
BITS = 22
BROADCAST_ROWS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of the base and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    n = CHUNK + 2 * LENGTH
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = base, pow(base, -1, 1 << 64)
    return _mix(np.arange(1, 257, dtype=np.uint64)), np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sums(raw: np.ndarray) -> np.ndarray:
    value, _, down = _powers()
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[raw] * down[: len(raw)], dtype=np.uint64)])


def _ids(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identifiers of the strings begin .. end."""
    return _mix((sums[end] - sums[begin]) * _powers()[1][begin])


def _window_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(key)
    padded = np.concatenate([key, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """Anchors of the texts begins .. ends of raw: (text, position, shape, bucket, two halves of the run's digest).
    shape: the anchor's offset in its first string, times 256, plus that in its last."""
    sums = _sums(raw)
    at = np.arange(len(raw) - Q + 1)
    gram = _ids(sums, at, at + Q)
    low = np.uint64((1 << BITS) - 1)
    key = (gram & ~low) | (low - at.astype(np.uint64))
    best = (low - (_window_min(key, SPAN) & low)).astype(np.int64)
    starts = np.arange(len(best))
    text = np.searchsorted(begins, starts, "right") - 1
    inside = starts + LENGTH <= ends[text]
    starts, best, text = starts[inside], best[inside], text[inside]
    if not len(starts):
        return None
    edge = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])]))
    lo, hi, p, text = starts[edge], starts[np.concatenate([edge[1:] - 1, [len(starts) - 1]])], best[edge], text[edge]
    view = memoryview(raw)
    around = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (hi + LENGTH).tolist())])
    shape = (p - lo) << 8 | (p - hi)
    return text, p - begins[text], shape, gram[p].view(np.int64), *np.frombuffer(around, "<i8").reshape(-1, 2).T


def _pieces(texts: list[memoryview]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of joined texts: bytes, begins, ends, index of each text, bytes of it that come before.
    Longer texts are cut into parts that overlap by LENGTH - 1 bytes."""
    held: list[tuple[int, int, memoryview]] = []
    size = 0

    def done():
        n = np.array([len(v) for *_, v in held])
        ends = np.cumsum(n)
        return np.frombuffer(b"".join(v for *_, v in held), np.uint8), ends - n, ends, np.array([i for i, *_ in held]), np.array([a for _, a, _ in held])

    for i, v in enumerate(texts):
        for a in range(0, max(1, len(v) - LENGTH + 1), CHUNK - LENGTH):
            part = v[a : a + CHUNK - 1]
            if held and size + len(part) > CHUNK:
                yield done()
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if size >= LENGTH:
        yield done()


ANCHOR = "k1 long, k2 long, p long, shape long, bucket long, a1 long, a2 long"
RUN = "k1 long, k2 long, p long, shape long, bucket long, single boolean, raw binary"
UNIT = "k1 long, k2 long, p long, a int, b int, single boolean, core long, d1 long, d2 long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        texts = [memoryview(t.as_buffer()) for t in batch.column(2)]
        for raw, begins, ends, index, before in _pieces(texts):
            if (got := anchors(raw, begins, ends)) is not None:
                text, p, *rest = got
                row = index[text]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k1[row], k2[row], p + before[text], *rest)], _names(ANCHOR))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their open members -> the bytes of each run."""
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.binary()]
    for batch in batches:
        out: list[tuple] = []
        for k1, k2, text, members in zip(*[batch.column(i) for i in range(4)]):
            raw, k1, k2 = memoryview(text.as_buffer()), k1.as_py(), k2.as_py()
            for m in members.as_py():
                p, shape = m["p"], m["shape"]
                out.append((k1, k2, p, shape, m["bucket"], m["single"], bytes(raw[p - (shape >> 8) : p - (shape & 255) + LENGTH])))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], _names(RUN))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], _names(RUN))


def _units(grid: int):
    """Runs, or runs with a list `parts` of (first and last offset, single) -> a row per range of the grid: the identifier of
    the bytes that all its strings share, and the digest of all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = batch.slice(i, 1000)
                k1, k2, p, shape, bucket, single = (rows.column(j).to_numpy(zero_copy_only=False) for j in range(6))
                texts = [x.as_buffer() for x in rows.column(6)]
                size = np.array([x.size for x in texts])
                joined = b"".join(texts)
                view, sums = memoryview(joined), _sums(np.frombuffer(joined, np.uint8))
                of, a, b = np.arange(len(k1)), shape & 255, shape >> 8
                anchor = np.cumsum(size) - size + b
                if rows.num_columns > 7:
                    parts = rows.column(7)
                    of = np.repeat(of, parts.value_lengths().to_numpy(zero_copy_only=False))
                    flat = parts.flatten()
                    a, b, single = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                    a, b = a.astype(np.int64), b.astype(np.int64)
                n = b // grid - a // grid + 1
                own = np.repeat(np.arange(len(n)), n)
                k = (a // grid)[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                r, a, b = of[own], np.maximum(a[own], k * grid), np.minimum(b[own], (k + 1) * grid - 1)
                at = anchor[r]
                before = _mix(bucket.view(np.uint64)[r] * np.uint64(3) + (k * 64 + grid).astype(np.uint64))
                core = _mix(before ^ _ids(sums, at - k * grid, at - (k + 1) * grid + 1 + LENGTH))
                got = b"".join([blake2b(view[x:y], digest_size=16).digest() for x, y in zip((at - b).tolist(), (at - a + LENGTH).tolist())])
                columns = (k1[r], k2[r], p[r], a.astype(np.int32), b.astype(np.int32), single[own].astype(bool), core.view(np.int64), *np.frombuffer(got, "<i8").reshape(-1, 2).T)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _names(UNIT))

    return run


def _keep(length: int):
    """(id, text bytes, spans of starts, whole) -> (id, n_bytes, kept, spans removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sizes, kept, removed = [], [], []
                for text, starts, whole in zip(part.column(1), part.column(2), part.column(3).to_pylist()):
                    raw = memoryview(text.as_buffer())
                    spans: list[list[int]] = []
                    if whole and len(raw) >= length:
                        spans = [[0, len(raw)]]
                    elif starts.is_valid and len(starts.values):
                        lo, hi = (starts.values.field(k).to_numpy() for k in (0, 1))
                        order = np.argsort(lo, kind="stable")
                        lo, hi = lo[order], np.maximum.accumulate(hi[order]) + length
                        new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                        spans = [[int(lo[a]), int(hi[b])] for a, b in zip(new, [*(new[1:] - 1), len(lo) - 1])]
                    edges = [0, *[x for s in spans for x in s], len(raw)]
                    sizes.append(len(raw))
                    removed.append([dict(start=a, end=b) for a, b in spans])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [part.schema.names[0], "n_bytes", "kept", "removed"])

    return run


def release(spark: SparkSession) -> None:
    """Lets the engine drop the shuffle files of finished steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts that occur twice or more: k1, k2, least id; spans of starts of repeated strings: k1, k2, lo, hi)."""
    spark = docs.sparkSession
    k1, k2, raw = _keys(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), k1, k2, raw.alias("raw")).where(F.octet_length("raw") >= LENGTH)
    copies = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least")).where("_n > 1").select("k1", "k2", "_least")
    copies, _ = cut(copies, "copies")
    held = _hint(copies, BROADCAST_ROWS).withColumn("_copy", F.lit(True))
    one = rows.join(held, ["k1", "k2"], "left").where(F.col("_copy").isNull() | F.col("_id").eqNullSafe(F.col("_least")))
    first, first_path = cut(one.select("k1", "k2", "raw").mapInArrow(_sample, ANCHOR), "anchors")

    mixed = (F.min("a1") != F.max("a1")) | (F.min("a2") != F.max("a2"))
    buckets, buckets_path = cut(first.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), mixed.alias("mixed")).where("_n > 1").select("bucket", "mixed"), "buckets")
    release(spark)
    left, left_path = cut(first.join(buckets, "bucket"), "refined")
    remove(spark, first_path, buckets_path)
    release(spark)

    of_class = ["bucket", "a1", "a2"]
    classes, classes_path = cut(left.where("mixed").groupBy(*of_class).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("k1", "k2", "p", "shape")).alias("_m")), "classes")
    whole = left.where("mixed").join(classes.where("_n > 1").select(*of_class), of_class, "left_semi")
    known = lambda df: df.select("k1", "k2", (F.col("p") - F.shiftright("shape", 8)).alias("lo"), (F.col("p") - F.col("shape").bitwiseAND(255)).alias("hi"))
    settled, _ = cut(known(whole), "settled")
    uniform, _ = cut(known(left.where("not mixed")), "uniform")
    member = F.struct(F.col("_m.p").alias("p"), F.col("_m.shape").alias("shape"), "bucket", (F.col("_n") == 1).alias("single"))
    per_text, text_path = cut(classes.groupBy(F.col("_m.k1").alias("k1"), F.col("_m.k2").alias("k2")).agg(F.collect_list(member).alias("members")), "open_members")
    remove(spark, left_path, classes_path)
    # only texts with open members are shuffled
    open_texts = one.select("k1", "k2", "raw").join(_hint(per_text.select("k1", "k2"), BROADCAST_ROWS), ["k1", "k2"], "left_semi")
    texts = open_texts.join(per_text.hint("merge"), ["k1", "k2"]).select("k1", "k2", "raw", "members")
    runs, runs_path = cut(texts.mapInArrow(_runs, RUN), "runs", compression="zstd")
    remove(spark, text_path)
    release(spark)

    spans = settled.union(uniform)
    open_runs, parts_path, of_class = runs, None, ["core", "d1", "d2"]
    for grid in GRIDS:
        units, units_path = cut(open_runs.mapInArrow(_units(grid), UNIT), f"units_{grid}")
        classes, classes_path = cut(units.groupBy(*of_class).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("k1", "k2", "p", "a", "b")).alias("_m")), f"classes_{grid}")
        twice = _hint(classes.where("_n > 1").select(*of_class), BROADCAST_ROWS)
        equal = units.where("single").join(twice, of_class, "left_semi")
        spans = spans.union(cut(equal.select("k1", "k2", (F.col("p") - F.col("b")).alias("lo"), (F.col("p") - F.col("a")).alias("hi")), f"settled_{grid}")[0])
        remove(spark, units_path, *([parts_path] if parts_path else []))
        if grid > 1:
            several, _ = cut(classes.groupBy("core").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("core"), f"several_{grid}")
            part = F.struct(F.col("_m.a").alias("a"), F.col("_m.b").alias("b"), (F.col("_n") == 1).alias("single"))
            more = classes.join(_hint(several, BROADCAST_ROWS), "core", "left_semi").groupBy(*[F.col(f"_m.{c}").alias(c) for c in ("k1", "k2", "p")]).agg(F.collect_list(part).alias("parts"))
            open_runs, parts_path = cut(runs.join(more, ["k1", "k2", "p"]).select(*_names(RUN), "parts"), f"parts_{grid}", compression="zstd")
        remove(spark, classes_path)
        release(spark)
    remove(spark, runs_path)
    return copies, spans


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def _keys(text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), F.encode(text, "UTF-8")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, kept binary, removed array of (start, end))."""
    small_batches(docs.sparkSession)
    copies, spans = repeats(docs, id_col, text_col)
    per_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))
    k1, k2, raw = _keys(text_col)
    rows = docs.select(F.col(id_col), k1, k2, raw.alias("raw"))
    whole = _hint(copies.select("k1", "k2", F.lit(True).alias("whole")), BROADCAST_ROWS)
    rows = rows.join(whole, ["k1", "k2"], "left")
    done = rows.where("whole").withColumn("starts", F.lit(None).cast("array<struct<lo:long,hi:long>>"))
    some = rows.where("whole is null").join(per_text, ["k1", "k2"], "left")
    both = done.unionByName(some).select(id_col, "raw", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(_keep(LENGTH), f"`{id_col}` {kind}, n_bytes long, kept binary, removed array<struct<start:long,end:long>>")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

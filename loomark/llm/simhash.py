"""Near-duplicates by SimHash: exact pairs of 64-bit fingerprints within a Hamming radius.

A text is lower-cased (A-Z), cut into words [^\\x20\\x09-\\x0D]+ and these into shingles of `width` words, repeats included,
joined by a blank; fewer words form one shingle. A fingerprint bit is 1 if it is set in over half the XXH64 hashes (seed 42).

Links are found exactly. Equal fingerprints are one point. Points are partitioned by their Hamming distances to VANTAGES sampled
vantage points: by the triangle bound linked points differ by at most radius there, so a shell of SHELL distances takes the points
of the next shell's first radius distances too, and some shard holds both ends of every link. Distances of unlike texts lie
close around 32 bits, so shells alone leave shards that grow with the table. Each is therefore partitioned once more: the bits are
cut into blocks, radius of which may differ at most in one bit each, and for every choice of the other blocks points are brought
together that agree there. Shards above LARGE points are cut again into shells around a vantage point of their own, ROUNDS times
at most; what a shell can't cut lies close together and is found by few searches. In each shard the links are searched with a
vantage-point tree on whole fingerprints, whose branches are pruned by the triangle bound |d(x, v) - d(y, v)| <= radius.

A search returns a spanning forest of a shard's links, not all pairs; components come from graph.components().

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; null ids never name a component
unless all its ids are null; repeated rows share a fingerprint; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.llm.common import cut, small, table
from loomark.llm.graph import components

WIDTH, RADIUS = 4, 4
VANTAGES = 2
#: Distances a shell holds; over the radius, so that only neighbours overlap.
SHELL = 8
#: Points above which a shard is cut again, and how often.
LARGE, ROUNDS = 1 << 16, 6
LEAF = 16
#: Points a shard holds on average, about, before more blocks are used.
SHARD_POINTS = 1 << 14


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    from xxhash import xxh64_intdigest as xx

    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xx(joined, 42)
    size = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    h = np.array([xx(joined[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], [id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp long")


def masks(points: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, of one of which every linked pair has all bits equal."""
    for blocks in range(radius + 1, 17):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        kept = blocks - radius
        if points >> (64 * kept // blocks) <= SHARD_POINTS or blocks == 16:
            own = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
            return [sum(c) for c in combinations(own, kept)]
    raise AssertionError


class VPTree:
    """A vantage-point tree over distinct 64-bit codes."""

    def __init__(self, codes: np.ndarray, leaf: int = LEAF):
        self.codes, self.leaf, self.free = codes, leaf, np.ones(len(codes), bool)
        self.root = self._build(np.arange(len(codes)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        vantage = self.codes[at[0]]
        d = np.bitwise_count(self.codes[at] ^ vantage)
        mid = int(np.median(d))
        near, far = d <= mid, d > mid
        if not far.any():
            near, far, mid = d < mid, d >= mid, mid - 1
            if not near.any():
                return at
        return vantage, (int(d[near].min()), mid), (int(d[far].min()), int(d[far].max())), self._build(at[near]), self._build(at[far])

    def take(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions within the radius that no earlier call took."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, np.ndarray):
                node = node[self.free[node]]
                out.append(node[np.bitwise_count(self.codes[node] ^ code) <= radius])
                continue
            vantage, inner, outer, a, b = node
            d = int(np.bitwise_count(vantage ^ code))
            if inner[0] - radius <= d <= inner[1] + radius:
                todo.append(a)
            if outer[0] - radius <= d <= outer[1] + radius:
                todo.append(b)
        found = np.concatenate(out)
        self.free[found] = False
        return found


def forest(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links between distinct codes."""
    if len(codes) <= 64:
        near = np.bitwise_count(codes[:, None] ^ codes[None]) <= radius
        if np.count_nonzero(near) == len(codes):
            return []
    tree, links = VPTree(codes), []
    for i in range(len(codes)):
        if not tree.free[i]:
            continue
        tree.free[i] = False
        todo = [i]
        while todo:
            x = todo.pop()
            for y in tree.take(codes[x], radius).tolist():
                links.append((x, y))
                todo.append(y)
    return links


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def done(parts: list[np.ndarray]) -> pa.RecordBatch | None:
            codes = np.concatenate(parts).view(np.uint64) if parts else np.zeros(0, np.uint64)
            links = forest(codes, radius) if len(codes) > 1 else []
            if links:
                own = codes.view(np.int64)
                a, b = (own[[x[i] for x in links]] for i in (0, 1))
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            return None

        for batch in batches:
            unit = batch.column(0).to_numpy(zero_copy_only=False)
            code = batch.column(1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.zeros(0, int)
            for i, begin in enumerate(first.tolist()):
                end = int(first[i + 1]) if i + 1 < len(first) else len(unit)
                if unit[begin] != key:
                    if (out := done(held)) is not None:
                        yield out
                    key, held = unit[begin], []
                held.append(code[begin:end])
        if (out := done(held)) is not None:
            yield out

    return run


def _shells(distance: Column, radius: int) -> Column:
    """The shells that take a point: its own, and the one below where a link may cross the border."""
    own = F.floor(distance / SHELL).cast("int")
    return F.when((distance % SHELL < radius) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))


def links(points: DataFrame, n: int, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """points (fp), distinct -> links (a, b) that connect what is within the radius."""
    if not 0 <= radius < SHELL:
        raise ValueError(f"the radius is under {SHELL}")
    distance = lambda v: F.bit_count(F.col("fp").bitwiseXOR(v))
    vantages = [r.fp for r in points.orderBy(F.xxhash64("fp"), "fp").limit(VANTAGES).collect()]
    shells = [f"s{i}" for i in range(len(vantages))]
    for name, v in zip(shells, vantages):
        points = points.withColumn(name, F.explode(_shells(distance(F.lit(v)), radius)))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    each = [F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for i, m in enumerate(masks(n, radius))]
    # Two shards whose hashes meet only cost time: distances are of whole fingerprints.
    keyed = points.select("fp", *shells, F.explode(F.array(*each)).alias("k")).select("fp", F.xxhash64("k.c", "k.v", *shells).alias("shard"))
    keyed, _ = cut(keyed, "shards_0")
    done: list[DataFrame] = []
    for r in range(ROUNDS):
        own = F.struct(F.xxhash64("fp", F.lit(r)).alias("h"), F.col("fp").alias("v"))
        hot, _ = cut(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"), F.min(own)["v"].alias("v")).where(F.col("_n") > large).select("shard", "v"), f"hot_{r}")
        if hot.isEmpty():
            break
        # at most copies / large rows; beyond 4 MB a shuffled join
        both = keyed.join(F.broadcast(hot) if small(hot, 200_000) else hot, "shard", "left")
        done.append(both.where("v is null").select("fp", "shard"))
        shell = F.explode(_shells(distance(F.col("v")), radius))
        keyed, _ = cut(both.where("v is not null").select("fp", "shard", shell.alias("s")).select("fp", F.xxhash64("shard", "s", F.lit(r)).alias("shard")), f"shards_{r + 1}")
    for part in done:
        keyed = keyed.union(part)
    return keyed.repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp").mapInArrow(_search(radius), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id linked to the row, itself included."""
    own, _ = cut(fingerprints(docs, id_col, text_col, width), "fingerprints")
    points, _ = cut(own.groupBy("fp").agg(F.min(id_col).alias("_least")), "points")
    root = components(links(points.select("fp"), points.count(), radius))
    named = points.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    named, _ = cut(named, "roots")
    least = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    return own.join(named.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

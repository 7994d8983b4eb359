"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group, and groups are hashed into buckets of geometrically falling size (half of all hashes in the
first SLOTS buckets, a quarter in the next, ...). Groups that alone fill more than 1/HEAVY of a shard in any dimension
are packed by themselves; there are at most 3 * shards * HEAVY of them. Those above 1/SPLIT of a shard are split into pieces
of that size at most. So the driver packs a bounded number of units whatever the size of the table: largest first, each into
the shard where the dot product of the unit with the shard's residual capacity is highest. The small buckets come last and
even out what is left; single moves from the largest shard to the smallest then close the gap in bytes. Rows are numbered by
runs of about RUN_ROWS of a unit, whose beginnings are running sums computed on the executors, shard by shard.

Law `bytes`: the shards' sizes are near equal. Equal texts share a shard unless their group is split.

Defined cases: a null text is empty, as is its group; null ids and repeated rows are rows of their own; an empty table
gives no rows; more shards than rows leave shards empty; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomark.llm.common import cut, small, table

SHARDS = 40
OVERHEAD = 16
LEVELS, SLOTS = 11, 512
HEAVY, SPLIT = 16, 2
#: Rows that one task numbers at most, about.
RUN_ROWS = 1_000_000
#: Weights of bytes, tokens and rows in the dot product.
WEIGHTS = (4.0, 1.0, 1.0)
LARGE = 1 << 20


def pack(units: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """units: (n, dimensions) demands. Shard of each unit: the highest dot product with residual capacity."""
    if not len(units):
        return np.zeros(0, int)
    share = units / np.maximum(units.sum(0), 1e-12) * shards * np.sqrt(np.array(weights))
    residual = np.tile(np.sqrt(np.array(weights)), (shards, 1))
    out = np.zeros(len(units), int)
    for i in np.lexsort((np.arange(len(units)), -share.max(1))):
        out[i] = best = int(np.argmax(residual @ share[i]))
        residual[best] -= share[i]
    return out


def even(size: np.ndarray, shard_of: np.ndarray, shards: int, moves: int = 4000) -> np.ndarray:
    """Moves single units from the shard with the most bytes to the one with the fewest while that narrows the gap."""
    out, load = shard_of.copy(), np.bincount(shard_of, size, shards)
    for _ in range(moves):
        a, b = int(np.argmax(load)), int(np.argmin(load))
        gap = load[a] - load[b]
        own = np.flatnonzero((out == a) & (size < gap) & (size > 0))
        if not len(own):
            break
        best = own[np.argmin(np.abs(size[own] - gap / 2))]
        out[best] = b
        load[a] -= size[best]
        load[b] += size[best]
    return out


def _bucket(h: Column) -> Column:
    """LEVELS of SLOTS buckets, each level with half the hashes of the one before."""
    part = F.shiftrightunsigned(h, 12).cast("double") / float(1 << 52)
    level = F.least(F.floor(-F.log2(F.greatest(part, F.lit(1e-12)))), F.lit(LEVELS - 1)).cast("int")
    return level * SLOTS + F.pmod(h, F.lit(SLOTS)).cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """(id, size, text_crc32, tokens, shard, slot); tokens: a count per row, the words (runs of other characters than
    [\\x20\\x09-\\x0D]) where not given."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++"))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        (tokens if tokens is not None else words).cast("long").alias("tokens"),
        F.xxhash64(text).alias("_h"),
        F.monotonically_increasing_id().alias("_r"),
    )
    rows = cut(rows.withColumn("_b", _bucket(F.col("_h"))), "shard_rows")[0]
    sums = [F.sum("size").alias("s"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")]

    buckets = rows.groupBy("_b").agg(*sums).collect()  # LEVELS * SLOTS rows at most
    total = np.array([[b.s, b.t, b.n] for b in buckets], float).sum(0) if buckets else np.ones(3)
    limit = [float(x) for x in total / shards / HEAVY]
    above = lambda a, b, c: (F.col(a) > limit[0]) | (F.col(b) > limit[1]) | (F.col(c) > limit[2])
    full = [b._b for b in buckets if b.s > limit[0] or b.t > limit[1] or b.n > limit[2]]
    heavy = []
    if full:
        groups = rows.where(F.col("_b").isin(full)).groupBy("_h", "text_crc32").agg(*sums)
        heavy = groups.where(above("s", "t", "n")).collect()  # 3 * shards * HEAVY rows at most
    at, parts = LARGE, []
    for g in sorted(heavy, key=lambda g: (g._h, g.text_crc32)):
        n = min(g.n, int(np.ceil(max(g.s / limit[0], g.t / limit[1], g.n / limit[2]) * SPLIT / HEAVY)))
        parts.append((g._h, g.text_crc32, at, n))
        at += n
    large = spark.createDataFrame(parts, "_gh long, _gc long, _at int, _n int")
    keyed = rows.join(F.broadcast(large), (F.col("_h") == F.col("_gh")) & (F.col("text_crc32") == F.col("_gc")), "left")
    piece = F.col("_at") + F.pmod(F.xxhash64("_r"), F.col("_n")).cast("int")
    runs = max(1, int(np.ceil(total[2] / (2 * SLOTS) / RUN_ROWS)))
    keyed = keyed.withColumn("_u", F.coalesce(piece, F.col("_b"))).withColumn("_s", F.pmod(F.xxhash64("_h", "_r"), F.lit(runs)).cast("int"))

    units, _ = cut(keyed.groupBy("_u", "_s").agg(*sums), "shard_units")
    whole = units.groupBy("_u").agg(*[F.sum(c).alias(c) for c in "stn"]).collect()  # a row for each bucket and heavy piece
    whole.sort(key=lambda u: u._u)
    demand = np.array([[u.s, u.t, u.n] for u in whole], float).reshape(-1, 3)
    shard_of = even(demand[:, 0], pack(demand, shards), shards)
    plan = spark.createDataFrame([(u._u, int(s)) for u, s in zip(whole, shard_of)], "_u int, shard int")
    before = Window.partitionBy("shard").orderBy("_u", "_s").rowsBetween(Window.unboundedPreceding, -1)
    runs_of = units.join(F.broadcast(plan), "_u").select("_u", "_s", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    runs_of, _ = cut(runs_of, "shard_runs")
    out = keyed.join(F.broadcast(runs_of) if small(runs_of, 200_000) else runs_of, ["_u", "_s"])
    rank = F.row_number().over(Window.partitionBy("_u", "_s").orderBy("_h", "text_crc32", "_r"))
    return out.select(F.col(id_col), "size", "text_crc32", "tokens", "shard", (F.col("_base") + rank - 1).cast("long").alias("slot"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")

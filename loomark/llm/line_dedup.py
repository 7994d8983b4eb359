"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A document is a row. Its text is split at \\n; a null or empty text is one empty line. A line's key is the
line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased; keys are held as XXH64 hashes, made once and written.

Documents are dealt into batches. A batch's keys are merge-anti-joined with the runs: what no run holds is fresh. The batch then
becomes a run at level 0: (hash, number of documents, fresh), bucketed and sorted by hash, so that the merge joins with it
shuffle nothing; every key is fresh in exactly one run, and in other runs it only adds to its number. When a level holds
`fanout` runs they are merged into one run of the next level. Keys that at least `min_docs` documents hold lose their lines.

Defined cases: empty keys never count; a key repeated in one document counts once; repeated rows are separate
documents; null ids are allowed; an empty table gives no rows; other columns are passed through untouched
(dedup_lines) or dropped (the query). Very long texts stay in their row: only hashes are shuffled, the text once, and the work
is linear in the lines of a text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.llm.common import BLANKS, ascii_lower, aside, cut, fresh_path, remove, small, table

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
#: Up to FEW_LINES lines runs have a bucket for each BUCKET_LINES lines; beyond it, as many as the session has partitions.
FEW_LINES, BUCKET_LINES = 1 << 20, 1 << 17
#: Frequent keys are broadcast up to this many (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Array of a hash per line, null for keys under min_chars code points."""

    def one(line: Column) -> Column:
        key = key_of(line)
        return F.when(F.char_length(key) >= min_chars, F.xxhash64(key))

    return F.transform(lines_of(text), one)


class LineRuns:
    """Levelled sorted runs of (h, n, fresh): a key's hash, the number of documents that hold it, and whether the run brought it.

    lines: how many lines come in all, where that is known. For few of them a bucket, that is a file, for each partition of a large
    session would hold next to nothing; and on a local file system Hadoop starts a process for every file it writes.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, min_chars: int = MIN_CHARS, lines: int | None = None):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        # as many as an aggregation has, so that its result meets a run's buckets without another shuffle
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        few = max(1, -(-lines // BUCKET_LINES)) if lines is not None and lines <= FEW_LINES else self.buckets
        #: Whether partitions are joined, also where the session doesn't do so itself; each task then writes a file for every bucket.
        self.few = few < self.buckets
        self.buckets = min(few, self.buckets)
        #: By level: the table and the path of each run.
        self.levels: dict[int, list[tuple[str, str]]] = {}

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", fresh_path(self.spark, "line_run")
        dealt = rows.coalesce(self.buckets) if self.few else rows.repartition(self.buckets, "h")
        dealt.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, *runs: tuple[str, str]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def _runs(self) -> list[tuple[str, str]]:
        return [run for level in sorted(self.levels) for run in self.levels[level]]

    def _tables(self) -> list[DataFrame]:
        return [self.spark.read.table(name) for name, _ in self._runs()]

    def keys(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(h): a row for each document and key."""
        return docs.select(F.explode(F.array_distinct(key_hashes(F.col(text_col), self.min_chars))).alias("h")).where("h is not null")

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (h, ...) that no run holds: a merge anti-join against each."""
        for run in self._tables():
            keys = keys.join(run.where("fresh").select("h").hint("merge"), "h", "left_anti")
        return keys

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        self.add_keys(self.keys(docs, text_col))

    def add_keys(self, keys: DataFrame) -> None:
        """Adds a batch as a run of its own, then compacts the levels that are full."""
        counts = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        batch = None
        if self.levels:
            batch = self._write(counts)
            counts = self.spark.read.table(batch[0])
            rows = self.fresh(counts).withColumn("fresh", F.lit(True))
            for run in self._tables():
                known = counts.join(run.where("fresh").select("h").hint("merge"), "h", "left_semi")
                rows = rows.union(known.withColumn("fresh", F.lit(False)))
        else:
            rows = counts.withColumn("fresh", F.lit(True))
        self.levels.setdefault(0, []).append(self._write(rows))
        if batch:
            self._drop(batch)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self._merge(level)
            level += 1

    def _merge(self, level: int) -> None:
        old = self.levels[level]
        new = self._write(self._summed(old))
        del self.levels[level]
        self.levels.setdefault(level + 1, []).append(new)
        self._drop(*old)

    def _summed(self, runs: list[tuple[str, str]]) -> DataFrame:
        # by path: over a union of bucketed tables the engine would leave out the shuffle that the sums need
        rows = self.spark.read.schema("h long, n long, fresh boolean").parquet(*[path for _, path in runs])
        return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh"))

    def counts(self) -> DataFrame:
        """(h, n) over all runs."""
        runs = self._runs()
        return self._summed(runs).select("h", "n") if runs else self.spark.createDataFrame([], "h long, n long")

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        return self.counts().where(F.col("n") >= min_docs).select("h")

    def new_lines(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The documents' key hashes that no run holds yet."""
        return self.fresh(self.keys(docs, text_col).distinct())

    def remove(self) -> None:
        self._drop(*self._runs())
        self.levels = {}


def dedup_lines(
    docs: DataFrame,
    batches: int = BATCHES,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """docs with the columns _n_lines, _n_dropped and _kept (the text without the dropped lines).

    batches: parts into which docs are dealt by a hash, each of which is added to the runs in turn.
    """
    spark = docs.sparkSession
    docs, back = aside(docs, id_col, text_col)
    text = F.col(text_col)
    # rows that are the same in both hashes are the same in text
    row = [F.xxhash64(F.col(id_col), text).alias("_r1"), F.xxhash64(F.lit("row"), F.col(id_col), text).alias("_r2")]
    hashed, _ = cut(docs.select(*row, key_hashes(text, min_chars).alias("_h")), "line_hashes")
    runs = LineRuns(spark, min_chars=min_chars, lines=hashed.agg(F.sum(F.size("_h"))).first()[0] or 0)
    for k in range(batches):
        part = hashed.where(F.pmod("_r1", F.lit(batches)) == k)
        runs.add_keys(part.select(F.explode(F.array_distinct("_h")).alias("h")).where("h is not null"))
    frequent, _ = cut(runs.frequent(min_docs), "frequent_lines")
    runs.remove()
    if small(frequent, BROADCAST_ROWS):
        frequent = F.broadcast(frequent)

    held = hashed.select("_r1", "_r2", F.posexplode("_h").alias("_pos", "h")).where("h is not null")
    drops = held.join(frequent, "h", "left_semi").groupBy("_r1", "_r2").agg(F.collect_set("_pos").alias("_drop"))
    joined = docs.select("*", *row).join(drops, ["_r1", "_r2"], "left").drop("_r1", "_r2")
    lines = lines_of(text)
    # the lines of a text once, then by position
    keep = lambda l: F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("_drop")), lambda i: F.get(l, i))
    kept = F.array_join(F.get(F.transform(F.array(lines), keep), F.lit(0)), "\n")
    out = (
        joined.withColumn("_n_lines", F.size(lines).cast("long"))
        .withColumn("_n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long"))
        .withColumn("_kept", F.when(F.col("_drop").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept))
        .drop("_drop")
    )
    return back(out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256")
    )


OP4_SQL = """
WITH l AS (
  SELECT rowid_ AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
), k AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), j AS (
  SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY r
"""

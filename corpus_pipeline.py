"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
docs. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.llm import bpe, decontaminate, langid, line_dedup, simhash
from loomark.llm.common import aside, cut, remove, small, table

#: Keys of rows that stay are broadcast up to this many (about 40 MB); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def passing(stage: Stage) -> Stage:
    """The stage, with all columns but those of documents set aside meanwhile, so that none clashes with its own."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held, back = aside(docs, "doc_id", "text", "lang", "source", "n_chars")
        return back(stage(spark, held, sf_dir))

    return run_stage


@passing
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay."""
    found = langid.classify(docs, langid.fit(docs), prefix="_lid_")
    return found.where(~F.col("_lid_rejected")).select(*docs.columns)


@passing
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their frequent lines; a null text stays null. n_chars, where there is one, follows."""
    found = line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("_kept"))
    new = {"text": text.alias("text"), "n_chars": F.char_length(text).cast("long").alias("n_chars")}
    return found.select(*[new.get(c, F.col(c)) for c in docs.columns])


@passing
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest doc_id stays, and one of rows that repeat it."""
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.struct(F.col("doc_id"), key.alias("k")).alias("_id"), "text")
    found = simhash.groups(rows, "_id")
    stay, _ = cut(found.where(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("_id.k").alias("_key")).agg(F.count(F.lit(1)).alias("_n")), "survivors")
    held = F.broadcast(stay) if small(stay, BROADCAST_ROWS) else stay
    out = docs.withColumn("_key", key).join(held, "_key", "left_semi")
    if not stay.where("_n > 1").isEmpty():  # rows that are the same in id and text: the one whose other values sort first
        others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
        out = out.groupBy("_key").agg(F.min_by(F.struct(*docs.columns), others).alias("_r")).select("_r.*")
    return out.select(*docs.columns)


@passing
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("_hits") == 0).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: Compression, fingerprints and merges have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = cut(docs, name)
            if last:
                remove(spark, last)
            last = path
    return docs

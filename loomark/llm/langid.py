"""Language identification by compression.

Each language has a zstandard raw-content dictionary: a bounded sample of its labelled texts. A text is cut into blocks
of BLOCK bytes, so that the dictionary stays in reach in long texts, and every block is compressed with each dictionary.
The language whose sizes sum to the least wins; the margin to the next tells how sure that is, and texts whose margin
is narrow, or that have no letter, are rejected.

The sample: at most `sample_bytes` a language (SAMPLE_BYTES; less where the languages' sum would pass MODEL_BYTES), in pieces
of PIECE characters of documents chosen by the hash of id and text, equal rows and equal texts once, the lowest SAMPLE_ROWS hashes
a language at most. Everything else covers all rows and whole texts.

Defined cases: a null text, or one without a letter, is `und`, rejected, with score 0; with no labelled text every
text is `und`; null ids count as not held out; equal sizes go to the language that sorts first; repeated rows and
empty tables are kept as they are; other columns pass through (classify) or are dropped (the query).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomark.llm.common import aside, small_batches, table

SAMPLE_BYTES = 1 << 17
PIECE = 2000
BLOCK = 4096
#: Of all dictionaries together: what the driver and every task hold.
MODEL_BYTES = 1 << 25
SAMPLE_ROWS = 1 << 14
#: Share of the second-best size; narrower margins are rejected. Of 2,499 labelled held-out texts this rejects 0.2 % of the
#: rightly and about half of the wrongly told ones, of texts of random letters nine in ten, of texts half in one language and
#: half in another about four in ten.
MIN_MARGIN = 0.01
#: Bytes of margin that count as one unit of log-odds.
UNIT = 4.0


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary content, from the rows that have a language and are not held out."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(
        "l is not null and length(t) > 0"
    ).where(~held_out(F.col("i")))
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.octet_length("t"), F.lit(PIECE))).alias("b")).collect()
    if not counts:
        return {}
    sample_bytes = max(1, min(sample_bytes, MODEL_BYTES // len(counts)))
    scale = 1 << 30
    # twice the sample's bytes in expectation, so that equal texts can go
    share = F.create_map(*[x for r in counts for x in (F.lit(r.l), F.lit(int(min(1.0, 2.0 * sample_bytes / r.b) * scale)))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("i"), F.col("t")), F.lit(scale))
    at = F.pmod(F.xxhash64(F.lit("place"), F.col("i"), F.col("t")), F.greatest(F.char_length("t") - PIECE, F.lit(0)) + 1).cast("int")
    sample = rows.where(draw < share[F.col("l")]).select("l", draw.alias("d"), F.substring("t", at + 1, F.lit(PIECE)).alias("t")).distinct()
    sample = sample.orderBy("d", "l", "t").limit(SAMPLE_ROWS * len(counts)).collect()
    out: dict[str, list[bytes]] = {r.l: [] for r in counts}
    held = {r.l: 0 for r in counts}
    seen = set()
    for r in sorted(sample, key=lambda r: (r.l, r.d, r.t)):
        raw = r.t.encode()
        if held[r.l] < sample_bytes and (r.l, raw) not in seen:
            seen.add((r.l, raw))
            raw = raw[: sample_bytes - held[r.l]]
            out[r.l].append(raw)
            held[r.l] += len(raw)
    return {lang: b"\n".join(parts) for lang, parts in sorted(out.items()) if parts}


class Classifier:
    """Compressors of a fitted model; one per Python worker."""

    def __init__(self, model: dict[str, bytes]):
        import zstandard

        # matches of three bytes: syllables and short words count
        how = zstandard.ZstdCompressionParameters.from_level(
            5, strategy=zstandard.STRATEGY_GREEDY, min_match=3, window_log=18, hash_log=17, chain_log=17, search_log=4, write_content_size=0
        )
        self.langs = sorted(model)
        self.run = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=how)
            self.run.append(zstandard.ZstdCompressor(compression_params=how, dict_data=content).compress)

    def sizes(self, raw: bytes) -> list[int]:
        view = memoryview(raw)
        blocks = [view[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum([len(run(b)) for b in blocks]) for run in self.run]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, margin."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        sizes = np.array(self.sizes(text.encode()), float)
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        second = float(np.min(np.delete(sizes, best)))
        gap = second - sizes[best]
        return self.langs[best], float(1 / (1 + np.exp(-gap / UNIT))), gap / second


def classify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, margin and rejected, each name after the prefix.

    model is a broadcast of MODEL_BYTES at most."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs, back = aside(docs, text_col)
    at = docs.columns.index(text_col)
    added = [(f"{prefix}{n}", t) for n, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("margin", T.DoubleType()), ("rejected", T.BooleanType()))]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [own.predict(t.as_py()) for t in part.column(at)]
                lang, score, margin = (list(x) for x in zip(*found))
                gone = [x == "und" or m < min_margin for x, m in zip(lang, margin)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(gone, pa.bool_())], [*part.schema.names, *[n for n, _ in added]])

    return back(docs.mapInArrow(run, schema))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    found = classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")

"""Queries of pages converted while they arrive, with SQL that states the incremental converter's text by string algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.functions.markdown import html_to_markdown
from loomark.plans import conversion
from loomark.plans.policies import CHUNK, _packed, pages
from loomark.streaming.chunks import slice_bytes
from loomark.streaming.incremental import convert_stream

#: Over any page's text: nothing is given out before the end.
HELD = 1 << 18
CUT = 777
#: With its tags, one chunk.
WORD = "w" * 2084


def _chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    return slice_bytes(rows, size)


def stream_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in small chunks: the text, the title and the number of chunks."""
    got = convert_stream(_chunks(pages(spark, sf_dir), CUT))
    return got.select("page_id", "status", F.sha2("markdown", 256).alias("md_sha256"), F.char_length("markdown").cast("long").alias("n_chars"), F.col("n_chunks").cast("long").alias("n_chunks"), "title", F.col("canonical").alias("url"))


def _text(x: str) -> str:
    """A piece of text: runs of white space are one blank, also at its ends."""
    return f"regexp_replace({conversion.DECODE.format(x=x)}, '[\\s]+', ' ', 'g')"


STREAM = f"""
WITH o AS (
  SELECT page_id, url, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad,
         regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?s)</h1>(.*?)</article>', 1) AS art FROM pages
), p0 AS (
  SELECT page_id, unnest(generate_series(1, len(a))) AS i, unnest(a) AS raw FROM (SELECT page_id, string_split(art, '<p>')[2:] AS a FROM o)
), b AS (
  SELECT page_id, string_agg(CASE WHEN raw LIKE '%<b>%' THEN '**' || t || '**' ELSE rtrim(t) END, chr(10) || chr(10) ORDER BY i) AS body
  FROM (SELECT page_id, i, raw, {_text("regexp_replace(raw, '<[^>]*>', '', 'g')")} AS t FROM p0) GROUP BY page_id
)
SELECT page_id, url, html, trim({conversion.DECODE.format(x="title")}) AS title, {_text("title")} || {_text("ad")} || '# ' || rtrim({_text("h1")}) || chr(10) || chr(10) || body || chr(10) AS md FROM o JOIN b USING (page_id)
"""
CONVERSION_SQL = f"SELECT page_id, 'converted' AS status, sha256(md) AS md_sha256, length(md) AS n_chars, ceil(strlen(html) / {CUT}.0)::BIGINT AS n_chunks, title, url FROM ({STREAM})"


def stream_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both converters side by side: whether their texts are the same, and how far apart their lengths are."""
    stream = convert_stream(_chunks(pages(spark, sf_dir))).select("page_id", F.col("markdown").alias("s"))
    whole = conversion.pages(spark, sf_dir).select("page_id", html_to_markdown(F.col("html"), F.col("url")).alias("w"))
    n = lambda c: F.char_length(c).cast("long")
    same = F.col("s").eqNullSafe(F.col("w"))
    # what differs on these pages: bold that is never closed goes on in the next paragraph, and a heading after text begins a line
    stars = lambda c: F.regexp_replace(F.regexp_replace(c, r"\*", ""), r"\s", "")
    return whole.join(stream, "page_id", "full").select("page_id", same.alias("identical"), (n("w") - n("s")).alias("longer"), (stars(F.col("s")) == stars(F.col("w"))).alias("same_words"))


PARITY_SQL = f"""
WITH s AS ({STREAM}), w AS ({conversion._sql(False)})
SELECT page_id, sha256(md) = md_sha256 AS identical, n_chars - length(md) AS longer, TRUE AS same_words FROM s JOIN w USING (page_id)
"""


def stream_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with tables and drawings: before anything is given out the converter of whole pages takes over, after it the page ends."""
    i = F.col("page_id")
    extra = F.when(i % 3 == 0, "<table><tr><td>x</td></tr></table>").when(i % 5 == 0, "<svg></svg>").when(i % 7 == 0, F.concat(F.lit("<p "), F.repeat(F.lit("x"), 70_000))).otherwise("")
    rows = pages(spark, sf_dir).select("page_id", "url", F.concat(F.lit(f"<article><p>{WORD}</p>"), extra, F.lit("<p>last</p></article>")).alias("html"))
    both = convert_stream(_chunks(rows, 2100), threshold=HELD).select("page_id", F.lit("held").alias("mode"), "status", "reason", "markdown")
    return both.union(convert_stream(_chunks(rows, 2100)).select("page_id", F.lit("given").alias("mode"), "status", "reason", "markdown"))


FALLBACKS_SQL = f"""
WITH k AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'table' WHEN page_id % 5 = 0 THEN 'svg' WHEN page_id % 7 = 0 THEN 'lookahead_exceeded' END AS what FROM pages), m AS (SELECT unnest(['held', 'given']) AS mode)
SELECT page_id, mode, CASE WHEN what IS NULL THEN 'converted' WHEN mode = 'held' THEN 'fallback' ELSE 'failed' END AS status, CASE WHEN mode = 'held' THEN what ELSE what || '_after_commit' END AS reason,
  '{WORD}' || chr(10) || CASE WHEN what IS NULL OR (mode = 'held' AND what <> 'table') THEN chr(10) || 'last' || chr(10) WHEN mode = 'held' AND what = 'table' THEN chr(10) || 'x' || chr(10) || chr(10) || 'last' || chr(10) ELSE '' END AS markdown
FROM k, m
"""


def stream_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that come as gzip in chunks, some cut short: inflated chunk by chunk."""
    i = F.col("page_id")
    raw = _packed("html", F.when(i % 4 == 0, 3).otherwise(0))
    packed = pages(spark, sf_dir).select("page_id", "url", raw.alias("raw"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / 500).cast("int"))
    rows = packed.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"), n.alias("n"))
    chunks = rows.select("page_id", "url", "seq", F.substring("raw", F.col("seq") * 500 + 1, F.lit(500)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("is_last"))
    got = convert_stream(chunks, encoding="gzip", threshold=HELD)
    return got.select("page_id", "status", "reason", F.sha2("markdown", 256).alias("md_sha256"))


INFLATION_SQL = f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'failed' ELSE 'converted' END AS status, CASE WHEN page_id % 4 = 0 THEN 'decompression_truncated_input' END AS reason, CASE WHEN page_id % 4 > 0 THEN sha256(md) END AS md_sha256 FROM ({STREAM})"""

def stream_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pages whose charset a meta tag tells, in the first bytes or too late, or tells wrongly."""
    k = F.col("page_id") % 5
    label = F.when(k == 0, "iso-8859-1").when(k == 1, "'UTF8'").when(k == 2, "no-such").when(k == 4, "gb18030").otherwise("utf-8")
    text = F.concat(F.lit("é "), F.substring("url", 1, 60))
    html = F.concat(F.when(k == 4, F.repeat(F.lit(" "), 1100)).otherwise(""), F.lit("<meta charset="), label, F.lit("><p>"), text, F.lit("</p>"))
    raw = F.when(k == 0, F.encode(html, "ISO-8859-1")).otherwise(F.encode(html, "UTF-8"))
    rows = pages(spark, sf_dir).select("page_id", "url", raw.alias("raw"))
    chunks = rows.select("page_id", "url", F.posexplode(F.array(F.substring("raw", F.lit(1), F.lit(40)), F.substring("raw", F.lit(41), F.lit(5000)))).alias("seq", "chunk")).withColumn("is_last", F.col("seq") == 1)
    return convert_stream(chunks, charset=None).select("page_id", "status", "reason", "markdown")


CHARSETS_SQL = """SELECT page_id, CASE WHEN page_id % 5 = 2 THEN 'failed' ELSE 'converted' END AS status, CASE WHEN page_id % 5 = 2 THEN 'encoding_error' END AS reason,
  CASE WHEN page_id % 5 <> 2 THEN CASE WHEN page_id % 5 = 4 THEN ' ' ELSE '' END || 'é ' || substr(url, 1, 60) || chr(10) END AS markdown
FROM pages"""

QUERIES = {"stream_charsets": stream_charsets, "stream_conversion": stream_conversion, "stream_parity": stream_parity, "stream_fallbacks": stream_fallbacks, "stream_inflation": stream_inflation}
ORACLE_SQL = {"stream_charsets": CHARSETS_SQL, "stream_conversion": CONVERSION_SQL, "stream_parity": PARITY_SQL, "stream_fallbacks": FALLBACKS_SQL, "stream_inflation": INFLATION_SQL}

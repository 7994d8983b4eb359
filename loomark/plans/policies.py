"""Queries of decoding, caching, routing, configuration, header plans, commit states, chunked conversion and load, with SQL."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomark.functions import text as X
from loomark.functions.blake3 import etag
from loomark.functions.markdown import html_to_markdown
from loomark.operators import policy as P
from loomark.plans import conversion
from loomark.sources import decoding
from loomark.streaming.chunks import convert_chunks, slice_bytes

BUDGET, CHUNK = 8000, 4096


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@F.pandas_udf(T.BinaryType())
def _packed(html: pd.Series, kind: pd.Series) -> pd.Series:
    """The page as a server may send it: gzip, deflate, gzip of two members, gzip cut short, plain under a wrong name."""

    def gzip(x: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush()

    def one(x: bytes, k: int) -> bytes:
        if k == 1:
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            return c.compress(x) + c.flush()
        return {0: gzip, 2: lambda y: gzip(y[: len(y) // 2]) + gzip(y[len(y) // 2 :]), 3: lambda y: gzip(y)[:-5]}.get(k, bytes)(x)

    return pd.Series([one((x or "").encode(), k) for x, k in zip(html, kind)], dtype=object)


def decompression(spark, sf_dir):
    k = (F.col("page_id") % 6).cast("int")
    header = F.when(k == 1, "Deflate").when(k == 5, " br").otherwise("GZIP")
    out = pages(spark, sf_dir).select("page_id", decoding.decompress_bounded(_packed("html", k), decoding.content_encoding(header), BUDGET).alias("d"))
    return out.select("page_id", "d.status", F.col("d.code").cast("long").alias("code"), F.sha2("d.body", 256).alias("body_sha256"))


DECOMPRESSION_SQL = f"""
WITH s AS (SELECT page_id, html, CASE WHEN page_id % 6 = 5 THEN 'unsupported' WHEN page_id % 6 = 4 THEN 'format' WHEN strlen(html) > {BUDGET} THEN 'budget_exceeded' WHEN page_id % 6 = 3 THEN 'truncated' ELSE 'ok' END AS status FROM pages)
SELECT page_id, status, CASE status WHEN 'ok' THEN 0 WHEN 'budget_exceeded' THEN 101 WHEN 'format' THEN 102 WHEN 'truncated' THEN 103 END::BIGINT AS code, CASE WHEN status = 'ok' THEN sha256(html) END AS body_sha256 FROM s
"""


def charset_decoding(spark, sf_dir):
    """Whole documents in several encodings under labels of any case, unknown ones, names of codecs that are no charset, and
    bytes that are not of the encoding."""
    k = F.col("doc_id") % 10
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\x7F\xA0-\xFF]", "?"), "ISO-8859-1")
    euro = F.concat(latin, F.unhex(F.lit("80939499")))
    raw = F.when(k == 1, F.encode("text", "UTF-16LE")).when(k == 4, F.encode("text", "UTF-16BE")).when(k.isin(5, 6), euro).when(k == 9, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "UTF-8"))
    names = {1: " UTF-16 ", 2: "x-unknown", 4: "utf-16BE", 5: "ISO-8859-1", 6: "windows-1252", 7: "rot13", 8: "zlib", 9: "UTF8"}
    name = F.lit("Utf-8")
    for i, n in names.items():
        name = F.when(k == i, n).otherwise(name)
    name = F.when(k != 3, name)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(decoding.decode_text(raw, name), 256).alias("text_sha256"))


CHARSET_SQL = """SELECT doc_id, CASE WHEN doc_id % 10 IN (5, 6) THEN sha256(regexp_replace(text, '[^\\x00-\\x7F\\x{A0}-\\x{FF}]', '?', 'g') || '€“”™') WHEN doc_id % 10 IN (0, 1, 3, 4) THEN sha256(text) END AS text_sha256 FROM documents"""


def http_dates(spark, sf_dir):
    i = F.col("page_id")
    months = F.array(*map(F.lit, P.MONTHS))
    date = F.concat(F.when(i % 7 == 0, "Xyz").otherwise("Tue"), F.lit(", "), F.lpad((i % 33).cast("string"), 2, "0"), F.lit(" "), F.element_at(months, (i % 12 + 1).cast("int")), F.lit(" "), (1960 + i % 145).cast("string"), F.lit(" "), F.lpad((i % 25).cast("string"), 2, "0"), F.lit(":15:09 GMT"))
    return pages(spark, sf_dir).select("page_id", P.parse_http_date(date).alias("epoch"))


HTTP_DATES_SQL = """
WITH d AS (SELECT page_id, page_id % 145 + 1960 AS y, try_cast(concat_ws('-', (page_id % 145 + 1960)::VARCHAR, lpad((page_id % 12 + 1)::VARCHAR, 2, '0'), lpad((page_id % 33)::VARCHAR, 2, '0')) AS DATE) AS d FROM pages)
SELECT page_id, CASE WHEN page_id % 7 <> 0 AND page_id % 25 < 24 AND y BETWEEN 1970 AND 2100 THEN (d - DATE '1970-01-01')::BIGINT * 86400 + page_id % 25 * 3600 + 909 END AS epoch FROM d
"""

CC = ("", "public, max-age=60", "no-store", "max-age=5", 'private="x', "Private", 's-maxage=1, PUBLIC, no-transform', "a b, c")


def cache_control(spark, sf_dir):
    k = (F.col("page_id") % 9).cast("int")
    h = F.when(k < 8, F.element_at(F.array(*map(F.lit, CC)), k + 1))
    return pages(spark, sf_dir).select("page_id", P.cache_control_private(h).alias("cache_control"), P.no_transform(h).alias("no_transform"))


CACHE_SQL = """
SELECT page_id, CASE page_id % 9 WHEN 1 THEN 'max-age=60, private' WHEN 2 THEN 'no-store' WHEN 3 THEN 'max-age=5, private' WHEN 4 THEN 'private, no-store' WHEN 5 THEN 'Private'
 WHEN 6 THEN 's-maxage=1, no-transform, private' WHEN 7 THEN 'private, no-store' ELSE 'private' END AS cache_control, page_id % 9 = 6 AS no_transform FROM pages
"""


def header_values(spark, sf_dir):
    i = F.col("page_id")
    size = F.concat(i.cast("string"), F.when(i % 4 == 0, "k").when(i % 4 == 1, "M").when(i % 4 == 2, "").otherwise("x"))
    trace = F.concat(F.when(i % 3 == 0, "01").otherwise("00"), F.lit("-"), F.lpad(F.lower(F.hex(i)), 32, "0"), F.lit("-"), F.lpad(F.lower(F.hex(i % 5)), 16, "0"), F.lit("-0"), (i % 2).cast("string"))
    t = P.parse_traceparent(trace)
    return pages(spark, sf_dir).select("page_id", P.parse_size(size).alias("bytes"), t["trace_id"].alias("trace_id"), t["sampled"].alias("sampled"), P.error_class((i % 16).cast("int")).alias("error_class"), P.error_behaviour(F.when(i % 3 == 0, "pass").when(i % 3 == 1, "status(429)").otherwise("fail_closed"), i % 4 == 0).alias("behaviour"))


HEADER_VALUES_SQL = """
WITH t AS (SELECT *, page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id > 0 AS ok FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id * 1024 WHEN 1 THEN page_id * 1048576 WHEN 2 THEN page_id END AS bytes,
 CASE WHEN ok THEN lpad(lower(to_hex(page_id)), 32, '0') END AS trace_id, CASE WHEN ok THEN page_id % 2 = 1 END AS sampled,
 CASE WHEN page_id % 16 IN (1, 2, 5, 7, 12, 13, 14) THEN 'conversion' WHEN page_id % 16 IN (3, 10) THEN 'timeout' WHEN page_id % 16 IN (4, 6, 9, 11) THEN 'memory' WHEN page_id % 16 = 8 THEN 'mid_flight' ELSE 'panic' END AS error_class,
 CASE WHEN page_id % 4 = 0 THEN 'terminate' WHEN page_id % 3 = 0 THEN 'pass' WHEN page_id % 3 = 1 THEN '429' ELSE '502' END AS behaviour
FROM t
"""


def processing_paths(spark, sf_dir):
    i = F.col("page_id")
    p = P.processing_path(
        F.when(i % 4 == 0, "off").when(i % 4 == 1, "force").otherwise("auto"), F.when(i % 5 == 0, "HEAD").otherwise("GET"), F.when(i % 7 == 0, 304).otherwise(200),
        F.when(i % 11 == 0, "full").otherwise("ims_only"), F.when(i % 6 == 0, "Text/Event-Stream; x=1").otherwise("text/html"), F.when(i % 9 == 0, -1).otherwise(F.octet_length("html")), 4096)
    return pages(spark, sf_dir).select("page_id", p.alias("p")).select("page_id", "p.path", "p.reason")


PATHS_SQL = """
WITH r AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'config_disabled' WHEN page_id % 5 = 0 OR page_id % 7 = 0 OR page_id % 11 = 0 THEN 'not_candidate' WHEN page_id % 6 = 0 THEN 'excluded_content_type'
  WHEN page_id % 4 = 1 OR page_id % 9 = 0 OR strlen(html) >= 4096 THEN 'eligible' ELSE 'below_threshold' END AS reason FROM pages)
SELECT page_id, CASE WHEN reason = 'eligible' THEN 'streaming' ELSE 'fullbuffer' END AS path, reason FROM r
"""


def configurations(spark, sf_dir):
    i = F.col("page_id")
    profile = F.when(i % 4 == 0, "strict_cache").when(i % 4 == 1, "balanced").when(i % 4 == 2, "streaming_first")
    s, c = F.when(i % 3 == 0, "force").when(i % 3 == 1, "auto"), F.when(i % 5 == 0, "full").when(i % 5 == 1, "off")
    e = F.when(i % 2 == 0, "fail_closed").otherwise("pass")
    return pages(spark, sf_dir).select("page_id", P.effective("streaming", s, profile).alias("streaming"), P.effective("cache", c, profile).alias("cache"), P.effective("max_size", F.lit(None).cast("int"), profile).cast("long").alias("max_size"), F.concat_ws(",", P.conflicts(profile, s, c, e)).alias("conflicts"))


CONFIGURATIONS_SQL = """
WITH x AS (SELECT page_id, page_id % 4 AS p, CASE page_id % 3 WHEN 0 THEN 'force' WHEN 1 THEN 'auto' END AS xs, CASE page_id % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'off' END AS xc FROM pages),
e AS (SELECT *, coalesce(xs, CASE p WHEN 0 THEN 'off' WHEN 2 THEN 'force' ELSE 'auto' END) AS streaming, coalesce(xc, CASE p WHEN 0 THEN 'full' WHEN 2 THEN 'off' ELSE 'ims_only' END) AS cache FROM x)
SELECT page_id, streaming, cache, CASE WHEN p = 3 THEN 10485760 ELSE 8388608 END::BIGINT AS max_size, concat_ws(',', CASE WHEN p = 0 AND xs <> 'off' THEN 'error:strict_cache_forces_streaming' END,
 CASE WHEN p = 2 AND xc <> 'off' THEN 'error:streaming_first_forces_cache' END, CASE WHEN p = 2 AND xs <> 'force' THEN 'error:streaming_first_forces_streaming' END,
 CASE WHEN cache = 'full' AND streaming = 'force' THEN 'error:full_with_force' END, CASE WHEN cache = 'full' AND streaming = 'auto' THEN 'warning:full_with_auto' END,
 CASE WHEN page_id % 2 = 0 AND streaming = 'force' THEN 'warning:fail_closed_with_force' END) AS conflicts FROM e
"""


def header_plans(spark, sf_dir):
    k = (F.col("page_id") % 6).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("convert", "head", "error", "not_modified", "no_body", "bypass"))), k + 1)
    held = F.create_map(*[F.lit(x) for x in ("content-type", "text/html", "Content-Length", "9", "content-encoding", "gzip", "ETag", "old", "X-A", "1")])
    after = P.apply_headers(held, P.header_plan(kind, F.lit("text/markdown"), k == 0), F.lit("new"))
    line = F.array_sort(F.transform(F.map_entries(after), lambda e: F.concat(F.lower(e["key"]), F.lit(":"), e["value"])))
    return pages(spark, sf_dir).select("page_id", F.concat_ws(",", line).alias("headers"))


HEADER_PLANS_SQL = """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'content-type:text/markdown,etag:new,x-a:1' WHEN 1 THEN 'content-type:text/markdown,etag:old,x-a:1' WHEN 2 THEN 'content-type:text/markdown,x-a:1'
 WHEN 3 THEN 'content-type:text/html,etag:old,x-a:1' WHEN 4 THEN 'content-encoding:gzip,content-type:text/html,etag:old,x-a:1' ELSE 'content-encoding:gzip,content-length:9,content-type:text/html,etag:old,x-a:1' END AS headers FROM pages
"""


def commit_states(spark, sf_dir):
    i = F.col("page_id")
    events = F.array(F.when(i % 10 == 0, "other").otherwise("eligible"), F.when(i % 9 == 0, "auto_risk").otherwise("streaming_start"), F.when(i % 8 == 0, "on_error_pass").otherwise("commit"), F.when(i % 7 == 0, "error").otherwise("data"), F.lit("data"))
    return pages(spark, sf_dir).select("page_id", P.commit_state(events, i % 2 == 0, F.when(i % 3 == 0, "pass").otherwise("reject")).alias("state"))


COMMIT_SQL = """
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'passthrough' WHEN page_id % 9 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'full_buffer_fallback' ELSE 'passthrough' END WHEN page_id % 8 = 0 THEN 'passthrough'
 WHEN page_id % 7 = 0 THEN CASE WHEN page_id % 3 = 0 THEN 'post_commit_safe_finish' ELSE 'post_commit_abort' END ELSE 'committed' END AS state FROM pages
"""


def chunked(spark, sf_dir):
    done = convert_chunks(slice_bytes(pages(spark, sf_dir), CHUNK))
    return done.select("page_id", F.sha2("markdown", 256).alias("md_sha256"), F.char_length("markdown").cast("long").alias("n_chars"), X.estimate_tokens(F.col("markdown")).alias("n_tokens"))


def etags(spark, sf_dir):
    return conversion.pages(spark, sf_dir).select("page_id", etag(html_to_markdown(F.col("html"), F.col("url"))).alias("etag"))


def in_flight(spark, sf_dir):
    """Highest concurrency an hour: running sums within each hour, on top of the sum of all hours before it, so that no
    window runs over all rows; only one row an hour meets in a single task."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    begin = e.select("ts", F.lit(1).alias("d"))
    end = e.select(F.expr("ts + make_dt_interval(0, 0, 0, event_id % 300 + 1)").alias("ts"), F.lit(-1).alias("d"))
    # equal times are one step, so that their order does not count
    steps = begin.union(end).groupBy("ts").agg(F.sum("d").alias("d")).withColumn("hour", F.date_trunc("hour", "ts"))
    hours = steps.groupBy("hour").agg(F.sum("d").alias("s"))
    before = hours.select("hour", (F.sum("s").over(W.orderBy("hour")) - F.col("s")).alias("base"))
    running = steps.withColumn("r", F.sum("d").over(W.partitionBy("hour").orderBy("ts")))
    top = running.groupBy("hour").agg(F.max("r").alias("top"))
    return top.join(before, "hour").select(F.col("hour").cast("string").alias("hour"), (F.col("top") + F.col("base")).cast("long").alias("high_watermark"))


IN_FLIGHT_SQL = """
WITH x AS (SELECT ts, 1 AS d FROM events UNION ALL SELECT ts + to_seconds((event_id % 300 + 1)::BIGINT), -1 FROM events), s AS (SELECT ts, sum(d) AS d FROM x GROUP BY ts), r AS (SELECT ts, sum(d) OVER (ORDER BY ts) AS n FROM s)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, max(n)::BIGINT AS high_watermark FROM r GROUP BY 1
"""


def doctor(spark, sf_dir):
    """Findings of seven rules over counters, one set of counters a user bucket."""
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    m = e.groupBy((F.col("user_id") % 20).alias("bucket")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(i % 9 == 0).alias("fallback"), F.count_if(i % 997 == 0).alias("overload"), F.count_if(i % 21 == 0).alias("backpressure"),
        F.count_if(i % 2 == 0).alias("dec_full"), F.count_if(i % 19 == 1).alias("dec_stream"), F.count_if(i % 1009 == 0).alias("dec_budget"), F.max(i * 100).alias("watermark"), F.count_if(i % 3 == 0).alias("copied"), F.count_if(i % 16 == 0).alias("zero_copy"))
    rule = lambda name, bad: F.when(bad, name)
    c = F.col
    found = F.array_compact(F.array(
        rule("D01", c("fallback") / c("requests") > 0.10), rule("D02", c("overload") > 0), rule("D03", c("backpressure") / c("requests") > 0.05), rule("D04", F.when(c("dec_stream") == 0, c("dec_full") > 0).otherwise(c("dec_full") / c("dec_stream") > 10)),
        rule("D05", c("dec_budget") > 0), rule("D06", c("watermark") > 0.8 * (1 << 20)), rule("D07", (c("zero_copy") > 0) & (c("copied") / c("zero_copy") > 5))))
    return m.select("bucket", F.explode(found).alias("rule"))


DOCTOR_SQL = """
WITH m AS (SELECT user_id % 20 AS bucket, count(*) AS n, count(*) FILTER (WHERE event_id % 9 = 0) AS f, count(*) FILTER (WHERE event_id % 997 = 0) AS o, count(*) FILTER (WHERE event_id % 21 = 0) AS b, count(*) FILTER (WHERE event_id % 2 = 0) AS df,
 count(*) FILTER (WHERE event_id % 19 = 1) AS ds, count(*) FILTER (WHERE event_id % 1009 = 0) AS db, max(event_id * 100) AS w, count(*) FILTER (WHERE event_id % 3 = 0) AS c, count(*) FILTER (WHERE event_id % 16 = 0) AS z FROM events GROUP BY 1)
SELECT bucket, 'D01' AS rule FROM m WHERE f > n * 0.10 UNION ALL SELECT bucket, 'D02' FROM m WHERE o > 0 UNION ALL SELECT bucket, 'D03' FROM m WHERE b > n * 0.05
UNION ALL SELECT bucket, 'D04' FROM m WHERE df > 10 * ds UNION ALL SELECT bucket, 'D05' FROM m WHERE db > 0 UNION ALL SELECT bucket, 'D06' FROM m WHERE w > 838860.8 UNION ALL SELECT bucket, 'D07' FROM m WHERE z > 0 AND c > 5 * z
"""

QUERIES = {
    "decompression": decompression, "charset_decoding": charset_decoding, "http_dates": http_dates, "cache_control": cache_control, "header_values": header_values, "processing_path": processing_paths,
    "configurations": configurations, "header_plans": header_plans, "commit_states": commit_states, "chunked_conversion": chunked, "markdown_etag": etags, "in_flight": in_flight, "doctor_rules": doctor,
}
ORACLE_SQL = {
    "decompression": DECOMPRESSION_SQL, "charset_decoding": CHARSET_SQL, "http_dates": HTTP_DATES_SQL, "cache_control": CACHE_SQL, "header_values": HEADER_VALUES_SQL, "processing_path": PATHS_SQL,
    "configurations": CONFIGURATIONS_SQL, "header_plans": HEADER_PLANS_SQL, "commit_states": COMMIT_SQL, "chunked_conversion": conversion.ORACLE_SQL["html_to_markdown"], "in_flight": IN_FLIGHT_SQL, "doctor_rules": DOCTOR_SQL,
}

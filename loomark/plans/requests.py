"""Queries of scalar functions and of the decision chain over a table of requests derived from the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.functions import text as X
from loomark.operators import decisions as D

#: Both sides build the same rows from page_id; the text is plain SQL that Spark and DuckDB share.
REQUESTS = """
SELECT page_id, url, octet_length(encode(html{utf})) AS content_length,
  CASE page_id % 7 WHEN 0 THEN 'POST' WHEN 1 THEN 'HEAD' ELSE 'GET' END AS method,
  CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 206 ELSE 200 END AS status,
  CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/html, text/markdown;q=0.5' WHEN 3 THEN 'text/markdown;q=0'
    WHEN 4 THEN 'text/html;q=0.8, text/markdown;q=0.8' WHEN 5 THEN '*/*' WHEN 6 THEN 'application/json' ELSE 'TEXT/Markdown ; q=0.9,text/html;q=0.3' END AS accept,
  CASE page_id % 6 WHEN 0 THEN 'text/event-stream' WHEN 1 THEN 'application/json' WHEN 2 THEN 'TEXT/HTML; charset=utf-8' WHEN 3 THEN 'text/htmlx' ELSE 'text/html' END AS content_type,
  CASE page_id % 9 WHEN 0 THEN 'a=1; session_id=x' WHEN 1 THEN 'PHPSESSID=q' WHEN 2 THEN 'theme=dark; xauth=1' ELSE NULL END AS cookie,
  CASE page_id % 5 WHEN 0 THEN '"a", W/"b"' WHEN 1 THEN '*' WHEN 2 THEN '"z"' ELSE NULL END AS if_none_match,
  1000 + page_id % 13 AS last_modified, CASE page_id % 4 WHEN 0 THEN NULL ELSE 1006 END AS if_modified_since,
  concat('10.', cast(page_id % 4 AS {str}), '.0.', cast(page_id % 250 AS {str})) AS ip,
  CASE page_id % 3 WHEN 0 THEN 'for=1;host=bad, for=2;host="cdn.example";proto=HTTPS' ELSE NULL END AS forwarded,
  CASE page_id % 3 WHEN 1 THEN 'x.example' ELSE NULL END AS x_host
FROM pages
"""
SQL_REQUESTS = REQUESTS.format(utf="", str="VARCHAR")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return spark.sql(REQUESTS.format(utf=", 'UTF-8'", str="STRING").replace("FROM pages", "FROM {pages}"), pages=pages)


def accept(spark, sf_dir):
    return requests(spark, sf_dir).select("page_id", D.negotiate_accept(F.col("accept")).alias("decision"), D.negotiate_accept(F.col("accept"), True).alias("with_wildcard"))


ACCEPT_SQL = """
SELECT page_id, CASE page_id % 8 WHEN 1 THEN 'convert' WHEN 2 THEN 'lower_q' WHEN 3 THEN 'explicit_reject' WHEN 4 THEN 'convert' WHEN 7 THEN 'convert' ELSE 'no_accept' END AS decision,
 CASE page_id % 8 WHEN 1 THEN 'convert' WHEN 2 THEN 'lower_q' WHEN 3 THEN 'explicit_reject' WHEN 4 THEN 'convert' WHEN 5 THEN 'convert' WHEN 7 THEN 'convert' ELSE 'no_accept' END AS with_wildcard
FROM pages
"""


def eligible(spark, sf_dir):
    r = requests(spark, sf_dir)
    e = D.eligibility(F.lit(True), F.col("method"), F.col("status"), F.lit(None).cast("string"), F.col("content_type"), F.col("content_length"), F.lit(8000))
    return r.select("page_id", e.alias("eligibility"), D.is_authenticated(F.lit(None), F.col("cookie")).alias("authenticated"))


ELIGIBLE_SQL = f"""
SELECT page_id, CASE WHEN method = 'POST' THEN 'ineligible_method' WHEN status = 206 THEN 'ineligible_range' WHEN status <> 200 THEN 'ineligible_status'
  WHEN page_id % 6 = 0 THEN 'ineligible_streaming' WHEN page_id % 6 IN (1, 3) THEN 'ineligible_content_type' WHEN content_length > 8000 THEN 'ineligible_size' ELSE 'eligible' END AS eligibility,
  page_id % 9 IN (0, 1) AS authenticated
FROM ({SQL_REQUESTS})
"""


def conditional(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.select("page_id", D.not_modified(F.col("if_none_match"), F.lit('"b"'), F.col("if_modified_since"), F.col("last_modified")).alias("not_modified"))


CONDITIONAL_SQL = """
SELECT page_id, CASE WHEN page_id % 5 IN (0, 1) THEN true WHEN page_id % 5 = 2 THEN false WHEN page_id % 4 = 0 THEN false ELSE page_id % 13 <= 6 END AS not_modified FROM pages
"""


def base_urls(spark, sf_dir):
    r = requests(spark, sf_dir)
    trusted = D.cidr_contains(F.col("ip"), "10.0.0.0/15")
    b = D.base_url(trusted, F.col("forwarded"), F.col("x_host"), F.lit("https"), F.lit("origin.example:8080"), F.lit("http"))
    return r.select("page_id", trusted.alias("trusted"), b.alias("b")).select("page_id", "trusted", "b.base_url", "b.source")


BASE_SQL = """
SELECT page_id, page_id % 4 < 2 AS trusted,
 CASE WHEN page_id % 4 < 2 AND page_id % 3 = 0 THEN 'https://cdn.example' WHEN page_id % 4 < 2 AND page_id % 3 = 1 THEN 'https://x.example' ELSE 'http://origin.example:8080' END AS base_url,
 CASE WHEN page_id % 4 < 2 AND page_id % 3 = 0 THEN 'forwarded' WHEN page_id % 4 < 2 AND page_id % 3 = 1 THEN 'x_forwarded' ELSE 'host' END AS source
FROM pages
"""


def chain(spark, sf_dir):
    r = requests(spark, sf_dir)
    e = D.eligibility(F.lit(True), F.col("method"), F.col("status"), F.lit(None).cast("string"), F.col("content_type"), F.col("content_length"), F.lit(0))
    a = D.negotiate_accept(F.col("accept"))
    # each once, as columns of their own
    r = r.select("content_length", e.alias("e"), a.alias("a"))
    e, a = F.col("e"), F.col("a")
    reason = F.when(e != "eligible", "not_eligible").when(a == "no_accept", "skipped_no_accept").when(a == "explicit_reject", "skipped_accept_reject").when(a != "convert", "skipped_accept").otherwise("converted")
    return r.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("content_length").alias("bytes"))


CHAIN_SQL = f"""
SELECT reason, count(*) AS n, sum(content_length)::BIGINT AS bytes FROM (
  SELECT *, CASE WHEN method = 'POST' OR status <> 200 OR page_id % 6 IN (0, 1, 3) THEN 'not_eligible' WHEN page_id % 8 IN (0, 5, 6) THEN 'skipped_no_accept'
    WHEN page_id % 8 = 3 THEN 'skipped_accept_reject' WHEN page_id % 8 = 2 THEN 'skipped_accept' ELSE 'converted' END AS reason
  FROM ({SQL_REQUESTS})) GROUP BY reason
"""


def text_functions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = spark.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() < n:  # a small scan of long texts is dealt to all cores
        d = d.repartition(n)
    t = F.col("text")
    return d.select("doc_id", X.estimate_tokens(t, 3.8).alias("tokens"), F.sha2(X.normalize_text(t), 256).alias("normal_sha256"), F.char_length(X.yaml_escape(t)).cast("long").alias("yaml_chars"), F.sha2(X.normalize_label(t), 256).alias("label_sha256"), F.char_length(X.escape_label(t)).cast("long").alias("label_chars"))


TEXT_SQL = r"""
SELECT doc_id, ceil(cast(cast(length(text) AS FLOAT) / cast(3.8 AS FLOAT) AS FLOAT))::BIGINT AS tokens,
  sha256(trim(regexp_replace(text, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS normal_sha256,
  length(text) + length(text) - length(regexp_replace(text, '[\\"\n\r\t]', '', 'g')) AS yaml_chars,
  sha256(trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '[- ]', '_', 'g')), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')) AS label_sha256,
  length(text) + length(text) - length(regexp_replace(text, '[\[\]\\]', '', 'g')) AS label_chars
FROM documents
"""


def page_functions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    h = F.col("html")
    return p.select("page_id", X.parser_working_set(h).alias("working_set"), X.detect_charset(F.lit(None).cast("string"), h).alias("charset"), X.resolve_url(F.lit("/a b"), F.col("url")).alias("absolute"), X.escape_destination(X.resolve_url(F.lit("/a b"), F.col("url"))).alias("destination"), X.is_dangerous_url(F.concat(F.when(F.col("page_id") % 3 == 0, " JavaScript:").when(F.col("page_id") % 3 == 1, "http:%0a").otherwise(""), F.col("url"))).alias("dangerous"))


PAGE_SQL = r"""
SELECT page_id, strlen(html) * 7 + (length(html) - length(replace(html, '<', ''))) * 512 + 1024 AS working_set, 'UTF-8' AS charset,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a b' AS absolute, '<' || regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a b>' AS destination, page_id % 3 < 2 AS dangerous
FROM pages
"""

QUERIES = {"accept_negotiation": accept, "eligibility": eligible, "conditional_requests": conditional, "base_url": base_urls, "decision_chain": chain, "text_functions": text_functions, "page_functions": page_functions}
ORACLE_SQL = {"accept_negotiation": ACCEPT_SQL, "eligibility": ELIGIBLE_SQL, "conditional_requests": CONDITIONAL_SQL, "base_url": BASE_SQL, "decision_chain": CHAIN_SQL, "text_functions": TEXT_SQL, "page_functions": PAGE_SQL}

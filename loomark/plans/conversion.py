"""Queries over pages: conversion, metadata, links, and their SQL, which states the expected text by string algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.functions import text as X
from loomark.functions.markdown import Options, html_links, html_metadata, html_to_markdown


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, dealt so that conversion uses all cores: page sizes differ widely."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df


def _converted(options: Options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        md = pages(spark, sf_dir).select("page_id", html_to_markdown(F.col("html"), F.col("url"), options).alias("markdown"))
        return md.select("page_id", F.sha2("markdown", 256).alias("md_sha256"), F.char_length("markdown").cast("long").alias("n_chars"), X.estimate_tokens(F.col("markdown")).alias("n_tokens"))

    return run


DECODE = "regexp_replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&', 'g')"
SQUEEZE = "trim(regexp_replace({x}, '[\\s]+', ' ', 'g'))"


def _sql(front: bool, prune: bool = True) -> str:
    clean = lambda x: SQUEEZE.format(x=DECODE.format(x=x))
    star = "repeat('**', CASE WHEN opens THEN least(k - 1, 3) + 1 ELSE least(k, 3) END::INT)"
    yaml = "'---' || chr(10) || 'title: \"' || replace(replace(trim(" + DECODE.format(x="o.title") + "), '\\', '\\\\'), '\"', '\\\"') || '\"' || chr(10) || 'url: \"' || o.url || '\"' || chr(10) || '---' || chr(10) || chr(10) || " if front else ""
    # noise that stays: a list of links before the advertisement, a last paragraph in as many marks as are still open
    escaped = "regexp_replace({x}, '([\\[\\]\\\\])', '\\\\\\1', 'g')"
    name, to = clean("regexp_extract(x, '(?s)>([^<]*)</a>', 1)"), "o.origin || " + DECODE.format(x="regexp_extract(x, 'href=.([^\"]*)', 1)")
    item = f"'- ' || CASE WHEN {name} = '' THEN '' ELSE '[' || {escaped.format(x=name)} || '](' || CASE WHEN regexp_matches({to}, '[ ()<>]') THEN '<' || {to} || '>' ELSE {to} END || ')' END"
    nl2 = "chr(10) || chr(10)"
    begin = clean("o.title || o.ad") if prune else f"{clean('o.title')} || {nl2} || (SELECT string_agg(rtrim({item}), chr(10) ORDER BY i) FROM links WHERE links.page_id = o.page_id) || {nl2} || {clean('o.ad')}"
    end = "" if prune else f"|| {nl2} || repeat('**', least(b.opened, 3)::INT) || {clean('o.foot')} || repeat('**', least(b.opened, 3)::INT)"
    return f"""
WITH o AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS foot, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
         regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
         regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad,
         regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
         regexp_extract(html, '(?s)</h1>(.*?)</article>', 1) AS art,
         regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1) AS nav
  FROM pages
), links AS (
  SELECT page_id, unnest(generate_series(1, len(a))) AS i, unnest(a) AS x FROM (SELECT page_id, regexp_extract_all(nav, '(?s)<li>.*?</li>') AS a FROM o)
), p0 AS (
  SELECT page_id, unnest(generate_series(1, len(a))) AS i, unnest(a) AS raw FROM (SELECT page_id, string_split(art, '<p>')[2:] AS a FROM o)
), p AS (
  SELECT page_id, i, raw LIKE '%<b>%' AS opens, sum((raw LIKE '%<b>%')::INT) OVER (PARTITION BY page_id ORDER BY i) AS k,
         {clean("regexp_replace(raw, '<[^>]*>', '', 'g')")} AS t
  FROM p0
), b AS (
  SELECT page_id, string_agg({star} || t || {star}, chr(10) || chr(10) ORDER BY i) AS body, max(k) AS opened FROM p GROUP BY page_id
), m AS (
  SELECT o.page_id, {yaml} {begin} || chr(10) || chr(10) || '# ' || {clean("o.h1")} || chr(10) || chr(10) || b.body {end} || chr(10) AS md
  FROM o JOIN b USING (page_id)
)
SELECT page_id, sha256(md) AS md_sha256, length(md) AS n_chars, ceil(length(md) / 4.0)::BIGINT AS n_tokens FROM m
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir).select("page_id", html_links(F.col("html"), F.col("url")).alias("a"))
    return found.select("page_id", F.posexplode("a").alias("pos", "x")).select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("x.label").alias("label"), F.col("x.url").alias("url"))


LINKS_SQL = f"""
WITH n AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a href.*?</a>') AS a FROM pages),
x AS (SELECT page_id, origin, unnest(generate_series(1, len(a))) AS pos, unnest(a) AS t FROM n)
SELECT page_id, pos, {SQUEEZE.format(x=DECODE.format(x="regexp_extract(t, '(?s)>(.*)</a>', 1)"))} AS label, origin || {DECODE.format(x="regexp_extract(t, 'href=.([^\"]*)', 1)")} AS url
FROM x WHERE {SQUEEZE.format(x="regexp_extract(t, '(?s)>(.*)</a>', 1)")} <> ''
"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", html_metadata(F.col("html"), F.col("url")).alias("m")).select("page_id", "m.title", "m.url", "m.description")


METADATA_SQL = f"SELECT page_id, trim({DECODE.format(x='regexp_extract(html, $$(?s)<title>(.*?)</title>$$, 1)')}) AS title, url, NULL::VARCHAR AS description FROM pages"

QUERIES = {
    "html_to_markdown": _converted(Options()),
    "html_to_markdown_front_matter": _converted(Options(front_matter=True)),
    "html_to_markdown_unpruned": _converted(Options(prune=False)),
    "html_links": links,
    "html_metadata": metadata,
}
ORACLE_SQL = {
    "html_to_markdown": _sql(False),
    "html_to_markdown_front_matter": _sql(True),
    "html_to_markdown_unpruned": _sql(False, False),
    "html_links": LINKS_SQL,
    "html_metadata": METADATA_SQL,
}

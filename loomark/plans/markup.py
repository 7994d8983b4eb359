"""Queries of single elements: pages are built row by row from the tables, and their SQL states the Markdown by string algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.functions.markdown import Options, html_metadata, html_to_markdown

BASE = "https://shop.example/parts/list?page=1"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism)


def _markdown(html: str, gfm: bool = False):
    """html: a Spark SQL expression over part's columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = Options(gfm=gfm)
        return _parts(spark, sf_dir).select("p_partkey", html_to_markdown(F.expr(html), F.lit(BASE), options).alias("markdown"))

    return run


#: Lists: as many items as the size says, ordered or not, an empty item, a nested list of the other kind, an item of its own.
LISTS = r"""
concat('<p>', p_name, '</p><', kind, '>\n', array_join(transform(sequence(1, p_size % 4 + 1), i -> concat('<li>', p_name, '  ', i, '</li>')), '\n'),
  if(p_size % 3 = 0, '<li></li>', ''), '<li>', p_brand, '<', other, '><li>', p_type, '</li><li><b>', p_size, '</b></li></', other, '></li></', kind, '><li>alone</li>')
""".replace("kind", "if(p_partkey % 2 = 0, 'ul', 'ol')").replace("other", "if(p_partkey % 2 = 0, 'ol', 'ul')")
LISTS_SQL = """
SELECT p_partkey, p_name || chr(10) || chr(10) || array_to_string(list_transform(range(1, p_size % 4 + 2), lambda i: mark || p_name || ' ' || i), chr(10)) || chr(10)
  || CASE WHEN p_size % 3 = 0 THEN trim(mark) || chr(10) ELSE '' END || mark || p_brand || chr(10) || chr(10) || '  ' || inner_mark || p_type || chr(10) || '  ' || inner_mark || '**' || p_size || '**' || chr(10)
  || chr(10) || '- alone' || chr(10) AS markdown
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN '- ' ELSE '1. ' END AS mark, CASE WHEN p_partkey % 2 = 0 THEN '1. ' ELSE '- ' END AS inner_mark FROM part)
"""

#: Code: the language of a class, fences by the longest run of backticks, inline code, emphasis.
CODE = r"""
concat('<pre><code class="hl language-', if(p_size % 5 = 0, 'no lang!', replace(p_brand, 'Brand', 'c')), '">', p_name, '\n\n\n  ', ticks, ' &lt;', p_type, '&gt;</code></pre>',
  '<p>see <code>', ticks, p_name, '</code> and <em>', p_brand, '</em> <strong>', p_type, '</strong><i></i></p>')
""".replace("ticks", "repeat('`', p_size % 6)")
CODE_SQL = """
SELECT p_partkey, fence || CASE WHEN p_size % 5 = 0 THEN 'no' ELSE replace(p_brand, 'Brand', 'c') END || chr(10) || p_name || chr(10) || chr(10) || chr(10) || '  ' || ticks || ' <' || p_type || '>' || chr(10) || fence
  || chr(10) || chr(10) || 'see ' || one || ticks || p_name || one || ' and *' || p_brand || '* **' || p_type || '**' || '**' || chr(10) AS markdown
FROM (SELECT *, repeat('`', CASE WHEN p_size % 6 = 0 THEN 3 ELSE greatest(p_size % 6, 3) + 1 END::INT) AS fence, repeat('`', (p_size % 6)::INT) AS ticks, repeat('`', (p_size % 6 + 1)::INT) AS one FROM part)
"""

#: Links and images: labels with brackets and nested markup, destinations with blanks, unsafe and missing ones, titles.
LINKS = r"""
concat('<p><a href="', {to}, '">', p_name, ' <b>[', p_brand, ']</b></a> <a href="', {to}, '"> </a><a>plain [', p_type, ']</a> ',
  '<img src="', if(p_size % 7 = 0, 'data:x', concat('img/', p_size, '.png')), '" alt=" ', p_name, ' " title=" ', if(p_size % 2 = 0, '', concat('a \\ &quot;', p_brand)), ' "></p>')
""".replace("{to}", "case p_size % 5 when 0 then concat('javascript:', p_name) when 1 then concat('/', p_name) when 2 then replace(p_name, ' ', '_') when 3 then concat('//cdn.example/', p_size) else concat('mailto:', p_size, '@x.example') end")
LINKS_SQL = r"""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN label ELSE '[' || label || '](' || CASE p_size % 5 WHEN 1 THEN '<https://shop.example/' || p_name || '>'
   WHEN 2 THEN 'https://shop.example/parts/' || replace(p_name, ' ', '_') WHEN 3 THEN '//cdn.example/' || p_size ELSE 'mailto:' || p_size || '@x.example' END || ')' END
  || ' plain [' || p_type || '] ' || CASE WHEN p_size % 7 = 0 THEN p_name ELSE '![ ' || p_name || ' ](https://shop.example/parts/img/' || p_size || '.png'
   || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' "a \\ \"' || p_brand || '"' END || ')' END || chr(10) AS markdown
FROM (SELECT *, p_name || ' \[' || p_brand || '\]' AS label FROM part)
"""

#: Tables: alignment by attribute, style or column, rows of unequal length, pipes, a heading row or none.
TABLES = r"""
concat('<table>', if(p_size % 4 = 3, '<colgroup><col align="right"><col></colgroup>', ''), if(p_size % 2 = 0, '<thead>', ''), '<tr><th', case p_size % 4 when 1 then ' align="LEFT"' when 2 then ' style="color:red; text-align: center"' else '' end,
  '>', p_name, '</th><th align="odd">', p_brand, ' | x</th></tr>', if(p_size % 2 = 0, '</thead><tbody>', ''),
  array_join(transform(sequence(1, p_size % 3 + 1), i -> concat('<tr><td>', p_type, '</td><td>', i, '</td>', if(i = 2, '<td>more</td>', ''), '</tr>')), ''), '</table><p>after</p>')
"""
TABLES_SQL = """
SELECT p_partkey, '| ' || p_name || ' | ' || p_brand || ' \\| x |' || CASE WHEN wide THEN ' |' ELSE '' END || chr(10)
  || '| ' || CASE p_size % 4 WHEN 2 THEN ':---:' WHEN 3 THEN '---:' ELSE '---' END || ' | --- |' || CASE WHEN wide THEN ' --- |' ELSE '' END || chr(10)
  || array_to_string(list_transform(range(1, p_size % 3 + 2), lambda i: '| ' || p_type || ' | ' || i || ' |' || CASE WHEN i = 2 THEN ' more |' WHEN wide THEN ' |' ELSE '' END), chr(10))
  || chr(10) || chr(10) || 'after' || chr(10) AS markdown
FROM (SELECT *, p_size % 3 >= 1 AS wide FROM part)
"""

#: Media, embedded pages and forms.
MEDIA = r"""
concat('<h2>', p_name, '</h2><video src="v/', p_size, '.mp4"', if(p_size % 2 = 0, concat(' title="', p_brand, '"'), ''), if(p_size % 3 = 0, ' poster="/p.png"', ''), '><source src="s', p_size, '" type="t/', p_size, '"><track src="k" label="', p_brand, '"></video>',
  '<audio src="/a.mp3"></audio><map><area href="/m" alt="', if(p_size % 5 = 0, '', p_type), '" title="', p_name, '"></map><iframe src="', if(p_size % 4 = 0, 'vbscript:x', 'i.html'), '" title="', p_type, '"></iframe><object data="o"></object><embed src="e">',
  '<form><fieldset><label>', p_brand, ' <input type="', case p_size % 4 when 0 then 'hidden' when 1 then 'submit' when 2 then 'text' else 'IMAGE' end, '" placeholder="ask" value="', p_size, '"></label><button>', p_type, '</button></fieldset></form>')
"""
MEDIA_SQL = """
SELECT p_partkey, '## ' || p_name || chr(10) || chr(10) || '[' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE v END || '](' || v || ')' || chr(10) || CASE WHEN p_size % 3 = 0 THEN '![](https://shop.example/p.png)' || chr(10) ELSE '' END
  || '[t/' || p_size || '](' || d || 's' || p_size || ')' || chr(10) || '[' || p_brand || '](' || d || 'k)' || chr(10) || '[https://shop.example/a.mp3](https://shop.example/a.mp3)' || chr(10)
  || '[' || CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_type END || '](https://shop.example/m)' || chr(10) || CASE WHEN p_size % 4 = 0 THEN '' ELSE '[' || p_type || '](' || d || 'i.html)' || chr(10) END
  || '[' || d || 'o](' || d || 'o)' || chr(10) || '[' || d || 'e](' || d || 'e)' || chr(10) || p_brand || ' ' || CASE p_size % 4 WHEN 1 THEN p_size || ' ' WHEN 2 THEN 'ask ' ELSE '' END || p_type || chr(10) AS markdown
FROM (SELECT *, 'https://shop.example/parts/v/' || p_size || '.mp4' AS v, 'https://shop.example/parts/' AS d FROM part)
"""


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nesting up to and over the limit: no text, and an error, beyond it."""
    n = F.col("n_nationkey").cast("int")
    html = F.concat(F.expr("repeat('<div>', 985 + n_nationkey)"), "n_name")
    md = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", html_to_markdown(html).alias("markdown"))
    return md.select("n_nationkey", "markdown", F.when(F.col("markdown").isNull(), "invalid_input").otherwise("ok").alias("status")).where(n.isNotNull())


# <html> is level 0, <body> is level 1
DEPTH_SQL = "SELECT n_nationkey, CASE WHEN n_nationkey + 985 + 1 <= 1000 THEN n_name || chr(10) END AS markdown, CASE WHEN n_nationkey + 985 + 1 <= 1000 THEN 'ok' ELSE 'invalid_input' END AS status FROM nation"

#: Heads with metadata: property before name, the last of og: and twitter: titles and descriptions, the first of the others.
HEAD = r"""
concat('<html><head><title> ', p_name, '  t </title><meta name="description" content="', p_type, '"><meta name="description" content="late">',
  if(p_size % 2 = 0, concat('<meta property="og:title" content="', p_brand, '">'), ''), if(p_size % 3 = 0, concat('<meta name="twitter:title" content="tw ', p_size, '">'), ''),
  if(p_size % 4 = 0, '<meta property="author" name="description" content="both">', ''), if(p_size % 5 = 0, '<meta property="og:description" content="">', ''),
  '<meta name="twitter:image" content="', p_size, '.png"><meta property="og:image" content="second.png"><meta name="author" content="', p_brand, '"><meta property="article:published_time" content="2024-01-0', p_size % 9 + 1, '">',
  case p_size % 6 when 0 then '' when 1 then '<link rel="alternate CANONICAL" href="/c/x">' when 2 then '<link rel="canonical" href="c/x"><link rel="canonical" href="/second">' when 3 then '<link rel="canonicals" href="/no">' when 4 then '<link rel="canonical" href="mailto:x">' else '<link rel="canonical" href="javascript:x">' end,
  '</head><body><title>second</title></body></html>')
"""
PAGE = "case p_partkey % 4 when 0 then concat('https://a.example/d/', p_size) when 1 then 'https://a.example' when 2 then 'http://a.example/d/e/' else 'ftp://a.example/x' end"


def head_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _parts(spark, sf_dir).select("p_partkey", html_metadata(F.expr(HEAD), F.expr(PAGE)).alias("m")).select("p_partkey", "m.*")
    return m.withColumn("n_bytes", metadata_bytes([F.col(c) for c in m.columns[1:]]))


def metadata_bytes(values: list[Column]) -> Column:
    """Bytes of all metadata values."""
    return sum((F.coalesce(F.octet_length(v), F.lit(0)) for v in values), F.lit(0)).cast("long")


HEAD_SQL = f"""
WITH x AS (SELECT *, {PAGE} AS page FROM part), m AS (
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'tw ' || p_size WHEN p_size % 2 = 0 THEN p_brand ELSE p_name || '  t' END AS title,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS description, p_size || '.png' AS image,
  CASE WHEN p_size % 4 = 0 THEN 'both' ELSE p_brand END AS author, '2024-01-0' || (p_size % 9 + 1) AS published,
  CASE p_size % 6 WHEN 1 THEN CASE p_partkey % 4 WHEN 3 THEN '/c/x' WHEN 2 THEN 'http://a.example/c/x' ELSE 'https://a.example/c/x' END
    WHEN 2 THEN CASE p_partkey % 4 WHEN 0 THEN 'https://a.example/d/c/x' WHEN 1 THEN 'https://a.example/c/x' WHEN 2 THEN 'http://a.example/d/c/x' ELSE 'c/x' END
    WHEN 4 THEN CASE p_partkey % 4 WHEN 0 THEN 'https://a.example/d/mailto:x' WHEN 1 THEN 'https://a.example/mailto:x' WHEN 2 THEN 'http://a.example/d/mailto:x' ELSE 'mailto:x' END
    WHEN 5 THEN CASE p_partkey % 4 WHEN 0 THEN 'https://a.example/d/javascript:x' WHEN 1 THEN 'https://a.example/javascript:x' WHEN 2 THEN 'http://a.example/d/javascript:x' END
    ELSE page END AS url
FROM x)
SELECT p_partkey, title, description, url, image, author, published, strlen(title) + strlen(description) + coalesce(strlen(url), 0) + strlen(image) + strlen(author) + strlen(published) AS n_bytes FROM m
"""

QUERIES = {
    "markdown_lists": _markdown(LISTS),
    "markdown_code": _markdown(CODE),
    "markdown_links_images": _markdown(LINKS),
    "markdown_tables": _markdown(TABLES, gfm=True),
    "markdown_media_forms": _markdown(MEDIA),
    "markdown_depth": depth,
    "head_metadata": head_metadata,
}
ORACLE_SQL = {
    "markdown_lists": LISTS_SQL,
    "markdown_code": CODE_SQL,
    "markdown_links_images": LINKS_SQL,
    "markdown_tables": TABLES_SQL,
    "markdown_media_forms": MEDIA_SQL,
    "markdown_depth": DEPTH_SQL,
    "head_metadata": HEAD_SQL,
}

"""Functions under their SQL names against the expressions and functions behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomark import sql
from loomark.functions import markdown
from loomark.operators import checks, decisions


def test_names(spark):
    names = sql.register(spark)
    assert {"html_to_markdown", "negotiate_accept", "decide_base_url", "html_events", "accept_entries", "decompress_bounded"} <= set(names) and len(names) == len(set(names))
    accepts = [None, "", "text/markdown", "text/html, text/markdown;q=0.5", "text/markdown;q=0", "text/html;q=0.8, text/markdown;q=0.8", "*/*", "a" * 5000]
    rows = spark.createDataFrame([(x,) for x in accepts], "a string")
    for r in rows.select(F.expr("negotiate_accept(a)").alias("x"), decisions.negotiate_accept(F.col("a")).alias("y")).collect():
        assert r.x == r.y
    tags = spark.createDataFrame([(m, t, s) for m in ("off", "ims_only", "full") for t in (None, '"a", W/"b"', "*", '"c"') for s in (None, 5, 20)], "m string, t string, s long")
    f = F.lit(False)
    for r in tags.select(F.expr("decide_conditional(m, false, false, t, '\"b\"', s, 10)").alias("x"), checks.decide_conditional(F.col("m"), f, f, F.col("t"), F.lit('"b"'), F.col("s"), F.lit(10)).alias("y")).collect():
        assert tuple(r.x) == tuple(r.y)
    r = spark.sql("SELECT detect_charset('text/html; charset=x', '') AS c, sanitize_url('JAVASCRIPT:x') AS s, resolve_url('a', 'http://h/d/p') AS r, estimate_tokens('12345') AS t, normalize_markdown('a  \\n\\n\\nb') AS n, decide_eligibility(true, 'GET', 200, null, 'text/html', 5, 9) AS e").first()
    assert (r.c, r.s, r.r, r.t, r.n, r.e) == ("X", None, "http://h/d/a", 2, "a\n\nb\n", "eligible")
    r = spark.sql("SELECT html_to_markdown('<h1>x</h1>', null) AS m, markdown_etag('abc') AS g, html_metadata('<title>t', 'http://h/') AS d, decompress_bounded(cast('x' AS binary), 'identity', 9) AS b, decide_base_url(true, 'host=a;proto=https', null, null, 'h', 'http').base_url AS u").first()
    assert (r.m, r.g, r.d.title, r.b.status, r.u) == ("# x\n", '"6437b3ac38465133ffb63b75273a8db5"', "t", "ok", "https://a")


def test_table_functions(spark):
    sql.register(spark)
    html = "<p>a <a href=/x>l</a><meta name=n content=c><table><tr><td>1<td>2<tr><td>3</table>"
    spark.createDataFrame([(html,)], "h string").createOrReplaceTempView("one_page")
    q = lambda s: [tuple(r) for r in spark.sql(s).collect()]
    assert q("SELECT t.* FROM one_page, LATERAL html_links(h, 'http://h/') t") == [(1, "l", "http://h/x")]
    assert q("SELECT t.* FROM one_page, LATERAL html_meta(h) t") == [(0, "n", "c")]
    assert q("SELECT t.* FROM one_page, LATERAL html_tables(h) t") == [(0, 0, 0, "1"), (0, 0, 1, "2"), (0, 1, 0, "3")]
    assert q("SELECT kind, name FROM one_page, LATERAL html_events(h) t WHERE pos < 2") == [("start", "p"), ("text", "a ")]
    assert q("SELECT * FROM accept_entries('Text/HTML;q=0.5, a/b')") == [(0, "text/html", "0.5"), (1, "a/b", None)]
    assert markdown.convert(html, "http://h/").startswith("a [l](http://h/x)")

"""Queries of attribute, URL, label and reason checks, flag chains, conditional modes, log gates, spans and coverage, with SQL.

Inputs vary by row: they are cut from urls, texts and digests of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomark.functions import text as X
from loomark.operators import checks as C
from loomark.operators import decisions as D
from loomark.operators.policy import no_transform


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _bit(k: int):
    """Bit k of the first bytes of the url's digest."""
    return (F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long").bitwiseAND(1 << k)) != 0


BITS = "(('0x' || substr(md5(url), 1, 8))::BIGINT)"


def attributes(spark, sf_dir):
    """Attributes named after the url's digest: handlers, style, links with schemes in any case and escaped control characters."""
    d = F.md5("url")
    one = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    href = F.concat(F.when(_bit(0), "JavaScript:").when(_bit(1), " data:").when(_bit(2), "https://x/%1F").otherwise("/p?"), "url")
    attrs = F.array(one(F.concat(F.lit("data-"), F.substring(d, 1, 3)), F.lit("1")), one(F.concat(F.when(_bit(3), "on").otherwise("o"), F.when(_bit(4), F.substring(d, 4, 2)).otherwise("")), F.lit("f()")),
        one(F.when(_bit(5), "style").otherwise("class"), F.lit("x")), one(F.when(_bit(6), "href").when(_bit(7), "src").otherwise("title"), href))
    return pages(spark, sf_dir).select("page_id", C.attribute_action(attrs).alias("action"), F.array_join(C.attributes_to_remove(attrs), ",").alias("removed"), F.array_join(C.attributes_kept(attrs), ",").alias("kept"))


ATTRIBUTES_SQL = f"""
WITH b AS (SELECT page_id, url, md5(url) AS d, {BITS} AS x FROM pages),
f AS (SELECT page_id, 'data-' || substr(d, 1, 3) AS n0, CASE WHEN x & 8 <> 0 THEN 'on' ELSE 'o' END || CASE WHEN x & 16 <> 0 THEN substr(d, 4, 2) ELSE '' END AS n1, x & 8 <> 0 AND x & 16 <> 0 AS handler,
  CASE WHEN x & 32 <> 0 THEN 'style' ELSE 'class' END AS n2, x & 32 <> 0 AS style, CASE WHEN x & 64 <> 0 THEN 'href' WHEN x & 128 <> 0 THEN 'src' ELSE 'title' END AS n3, x & 192 <> 0 AND x & 7 <> 0 AS link FROM b)
SELECT page_id, CASE WHEN handler OR style THEN 'strip_attributes' WHEN link THEN 'strip_url' ELSE 'allow' END AS action,
  concat_ws(',', CASE WHEN handler THEN n1 END, CASE WHEN style THEN n2 END, CASE WHEN link THEN n3 END) AS removed,
  concat_ws(',', n0, CASE WHEN NOT handler THEN n1 END, CASE WHEN NOT style THEN n2 END, CASE WHEN NOT link THEN n3 END) AS kept
FROM f
"""


def url_checks(spark, sf_dir):
    """URLs with a character from 1 to 130 put into them."""
    u = F.concat(F.substring("url", 1, 9), F.char(F.col("page_id") % 130 + 1), F.substring("url", 10, 1000))
    return pages(spark, sf_dir).select(u.alias("u"), "page_id").select(
        "page_id", C.has_controls(F.col("u")).alias("controls"), C.link_has_controls(F.col("u")).alias("link_controls"), C.host_has_invalid(F.col("u")).alias("host_invalid"),
        C.link_error(F.col("u")).alias("error"), F.md5(X.sanitize_url(F.col("u"))).alias("safe_md5"))


URL_SQL = """
WITH u AS (SELECT page_id, substr(url, 1, 9) || chr((page_id % 130 + 1)::INT) || substr(url, 10) AS u, page_id % 130 + 1 AS k FROM pages)
SELECT page_id, k < 32 AND k NOT IN (9, 10, 13) AS controls, k < 32 AS link_controls, TRUE AS host_invalid,
  CASE WHEN k < 32 THEN 'URL contains control characters' WHEN k BETWEEN 127 AND 159 THEN 'URL has dangerous scheme' END AS error, CASE WHEN k >= 32 AND k NOT BETWEEN 127 AND 159 THEN md5(u) END AS safe_md5
FROM u
"""


def code_texts(spark, sf_dir):
    """Fences, sizes and savings of documents with backticks put into them."""
    t = F.concat(F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), "text", F.repeat(F.lit("`"), (F.col("doc_id") % 9).cast("int")))
    d = documents(spark, sf_dir).select("doc_id", t.alias("t"))
    return d.select("doc_id", X.longest_backtick_run(F.col("t")).cast("long").alias("run"), X.code_fence(F.col("t")).alias("fence"), X.format_bytes(F.octet_length("t").cast("long") * (F.col("doc_id") % 700)).alias("size"),
        X.token_savings(F.col("t"), F.octet_length("t").cast("long") % 900).alias("saved"))


CODE_SQL = """
WITH t AS (SELECT doc_id, repeat('`', (doc_id % 6)::INT) || text || repeat('`', (doc_id % 9)::INT) AS t FROM documents),
r AS (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) AS run, strlen(t) * (doc_id % 700) AS b FROM t)
SELECT doc_id, run, repeat('`', CASE WHEN run = 0 THEN 3 ELSE greatest(run, 3) + 1 END::INT) AS fence,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024.0) ELSE format('{:.1f} MB', b / 1048576.0) END AS size,
  CASE WHEN strlen(t) % 900 > 0 THEN greatest(0, strlen(t) // 4 - strlen(t) % 900) ELSE 0 END AS saved
FROM r
"""


def label_words(spark, sf_dir):
    """The first word of every document, and every fixed name in a case of its own, by class."""
    names = spark.createDataFrame([(x.upper() if i % 2 else x,) for i, x in enumerate((*C.LABELS_ALLOWED, *C.LABELS_BLOCKED))], "key string")
    words = documents(spark, sf_dir).select(F.regexp_extract("text", "([A-Za-z]+)", 1).alias("key")).unionByName(names)
    return words.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", "n", C.label_class(F.col("key")).alias("class"))


LABEL_WORDS_SQL = f"""
WITH w AS (SELECT regexp_extract(text, '([A-Za-z]+)', 1) AS key FROM documents UNION ALL SELECT CASE WHEN i % 2 = 1 THEN upper(x) ELSE x END FROM (SELECT unnest({[*C.LABELS_ALLOWED, *C.LABELS_BLOCKED]}) AS x, unnest(range(16)) AS i))
SELECT key, count(*) AS n, CASE WHEN lower(key) IN {C.LABELS_ALLOWED} THEN 'allowed' WHEN lower(key) IN {C.LABELS_BLOCKED} THEN 'blocked' ELSE 'unknown' END AS class FROM w GROUP BY key
"""

FLAGS = [name for name, *_ in C.CHAIN]


def _decided(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "html", C.decide({name: _bit(k) if ends else (_bit(k) | _bit(k + 8)) for k, (name, ends, _) in enumerate(C.CHAIN)}).alias("decision"))


def decisions(spark, sf_dir):
    """The eight-flag chain; flags are bits of the url's digest."""
    return _decided(spark, sf_dir).select("page_id", "decision")


_ON = [f"{BITS} & {1 << k} <> 0" if ends else f"({BITS} & {(1 << k) | (1 << (k + 8))}) = 0" for k, (_, ends, _) in enumerate(C.CHAIN)]
DECISIONS_SQL = "SELECT page_id, CASE " + " ".join(f"WHEN {on} THEN '{reason}'" for on, (_, _, reason) in zip(_ON, C.CHAIN)) + " ELSE 'CONVERT' END AS decision FROM pages"
#: The chain's reasons as codes of the reason table.
CODES = {"CONVERT": "converted", "DISABLED": "disabled", "NOT_ELIGIBLE": "not_eligible", "SKIP_NO_ACCEPT": "skipped_no_accept", "SKIP_ACCEPT": "skipped_accept", "SKIP_CONDITIONAL": "skipped_conditional", "FAIL_DECOMPRESSION": "decompression_error", "PARSE_TIMEOUT": "timeout", "PARSE_BUDGET_EXCEEDED": "budget_exceeded"}


def reasons(spark, sf_dir):
    """Decisions looked up in the reason table, counted by counter, place and reason, with what a log at warn would hold."""
    code = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), lambda k, _: k == F.col("decision"))), F.lit(0))
    rows = C.with_reasons(_decided(spark, sf_dir).select("page_id", code.alias("reason"), F.octet_length("html").cast("long").alias("bytes")))
    return rows.groupBy("reason", "metric_key", "callsite").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if(C.logged(F.lit("warn"), F.col("reason"))).alias("logged_at_warn"), F.count_if(C.logged(F.lit("info"), F.col("reason"))).alias("logged_at_info"))


_TABLE = ", ".join(f"('{r}', '{k}', '{c}')" for k, rows in C.REASONS.items() for r, c in rows.items())
REASONS_SQL = f"""
WITH d AS ({DECISIONS_SQL}), c AS (SELECT page_id, CASE decision {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CODES.items())} END AS reason FROM d), t(reason, metric_key, callsite) AS (VALUES {_TABLE})
SELECT reason, metric_key, callsite, count(*) AS n, sum(strlen(html))::BIGINT AS bytes, count(*) FILTER (WHERE metric_key IN ('markdown_errors_total', 'markdown_failed_open_total', 'markdown_failed_closed_total')) AS logged_at_warn, count(*) AS logged_at_info
FROM c JOIN t USING (reason) JOIN pages USING (page_id) GROUP BY 1, 2, 3
"""


def failures(spark, sf_dir):
    """Which log lines are failures: every reason, and older codes made of the url's digest."""
    old = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("FAIL_", "ELIGIBLE_FAILED_", "STREAMING_FAIL_", "STREAMING_SKIP_", "ENGINE_", "STREAMING_BUDGET_", "STREAMING_CONVERT")]), (F.col("page_id") % 7 + 1).cast("int")), F.upper(F.substring(F.md5("url"), 1, 4)))
    rows = pages(spark, sf_dir).select(old.alias("reason")).unionByName(C.reason_table(spark).select("reason"))
    return rows.select("reason", C.is_failure(F.col("reason")).alias("failure"), C.logged(F.lit("error"), F.col("reason")).alias("logged")).distinct()


FAILURES_SQL = f"""
WITH r AS (SELECT ['FAIL_', 'ELIGIBLE_FAILED_', 'STREAMING_FAIL_', 'STREAMING_SKIP_', 'ENGINE_', 'STREAMING_BUDGET_', 'STREAMING_CONVERT'][page_id % 7 + 1] || upper(substr(md5(url), 1, 4)) AS reason, page_id % 7 IN (0, 1, 2, 5) AS failure FROM pages
 UNION ALL SELECT reason, metric_key IN ('markdown_errors_total', 'markdown_failed_open_total', 'markdown_failed_closed_total') FROM (VALUES {_TABLE}) t(reason, metric_key, callsite))
SELECT DISTINCT reason, failure, failure AS logged FROM r
"""


def conditional_modes(spark, sf_dir):
    """Conditional requests in all modes; tags and dates come from the url's digest."""
    d = F.md5("url")
    mode = F.when(_bit(0) & _bit(1), "off").when(_bit(0), "ims_only").otherwise("full")
    etag = F.concat(F.lit('"'), F.substring(d, 1, 2), F.lit('"'))
    tags = F.when(_bit(2), F.concat(F.lit('"x", W/'), F.when(_bit(3), etag).otherwise('"none"'))).when(_bit(4) & _bit(5), "*")
    since, last = F.when(_bit(6), F.lit(1000)).cast("long"), (F.col("page_id") % 2000).cast("long")
    c = C.decide_conditional(mode, _bit(7) & _bit(8), _bit(9) & _bit(10), tags, etag, since, last)
    return pages(spark, sf_dir).select("page_id", c.alias("c")).select("page_id", "c.*")


CONDITIONAL_SQL = f"""
WITH b AS (SELECT page_id, {BITS} AS x FROM pages), f AS (SELECT *, CASE WHEN x & 3 = 3 THEN 'off' WHEN x & 1 <> 0 THEN 'ims_only' ELSE 'full' END AS mode, x & 4 <> 0 OR x & 48 = 48 AS inm, CASE WHEN x & 4 <> 0 THEN x & 8 <> 0 ELSE TRUE END AS hit, x & 64 <> 0 AS ims FROM b),
r AS (SELECT *, CASE WHEN x & 384 = 384 THEN 'bypass_range' WHEN x & 1536 = 1536 THEN 'bypass_no_transform' WHEN mode = 'off' THEN 'no_headers' WHEN mode = 'full' AND inm THEN 'inm_evaluated' WHEN ims THEN 'ims_evaluated' ELSE 'no_headers' END AS reason FROM f)
SELECT page_id, CASE WHEN reason LIKE 'bypass%' THEN 'bypass' WHEN (reason = 'inm_evaluated' AND hit) OR (reason = 'ims_evaluated' AND page_id % 2000 <= 1000) THEN 'not_modified' ELSE 'proceed' END AS outcome, reason,
  CASE reason WHEN 'inm_evaluated' THEN 'if_none_match' WHEN 'ims_evaluated' THEN 'if_modified_since' ELSE 'none' END AS header
FROM r
"""


def spans(spark, sf_dir):
    """Conversion spans as JSON; some traceparents are malformed."""
    d = F.md5("url")
    trace = F.concat(F.when(_bit(0) & _bit(1), "01-").otherwise("00-"), d, F.lit("-"), F.when(_bit(2) & _bit(3), F.repeat(F.lit("0"), 16)).otherwise(F.substring(d, 9, 16)), F.lit("-01"))
    begin = (F.col("page_id") * 1000).cast("long")
    span = C.span_json(trace, F.lit("markdown.convert"), {"url.full": F.col("url"), "input.bytes": F.octet_length("html").cast("long")}, begin, begin + 7)
    return pages(spark, sf_dir).select("page_id", span.alias("span"))


SPANS_SQL = f"""
WITH b AS (SELECT *, {BITS} AS x, md5(url) AS d FROM pages)
SELECT page_id, '{{' || CASE WHEN x & 3 = 3 OR x & 12 = 12 THEN '' ELSE '"traceId":"' || d || '","parentSpanId":"' || substr(d, 9, 16) || '",' END || '"name":"markdown.convert","startTimeUnixNano":' || page_id * 1000 || ',"endTimeUnixNano":' || (page_id * 1000 + 7)
  || ',"attributes":{{"url.full":"' || url || '","input.bytes":' || strlen(html) || '}}}}' AS span
FROM b
"""


def metric_paths(spark, sf_dir):
    """Which of the wanted paths a nested document lacks; documents are built of events."""
    doc = F.to_json(F.struct(F.struct(F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("p50"), F.when(F.col("event_id") % 5 > 0, F.struct(F.col("user_id").alias("id"))).alias("by")).alias("latency"), F.col("event_type").alias("kind")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(C.missing_paths(doc, ("latency.p50", "latency.by.id", "kind", "rss")), ",").alias("missing"))


METRIC_PATHS_SQL = "SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'latency.p50' END, CASE WHEN event_id % 5 = 0 THEN 'latency.by.id' END, 'rss') AS missing FROM events"


def metric_names(spark, sf_dir):
    """First words of documents that no event type or source bears."""
    e, d = spark.read.parquet(f"{sf_dir}/events.parquet"), documents(spark, sf_dir)
    known = e.select(F.col("event_type").alias("name")).union(d.select("source")).distinct()
    used = d.select(F.explode(F.array(F.regexp_extract("text", "([A-Za-z]+)", 1), "source")).alias("name")).union(e.select("event_type"))
    return C.unknown_names(used, known)


METRIC_NAMES_SQL = """SELECT DISTINCT regexp_extract(text, '([A-Za-z]+)', 1) AS name FROM documents WHERE name NOT IN (SELECT event_type FROM events) AND name NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)"""

RULES = [("click", "streaming", "some"), ("view", "fullbuffer", "none"), ("error", "streaming", "all"), ("purchase", "fullbuffer", "all"), ("absent", "streaming", "some")]


def path_coverage(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.groupBy(F.col("event_type").alias("scenario")).agg(F.count_if((F.col("event_type") != "purchase") & (F.col("event_id") % 2 == 0)).alias("streaming_hits"), F.count_if((F.col("event_type") != "error") & (F.col("event_id") % 2 == 1)).alias("fullbuffer_hits"))
    return C.path_coverage(rows, RULES)


PATH_COVERAGE_SQL = f"""
WITH e AS (SELECT event_type AS scenario, count(*) FILTER (WHERE event_type <> 'purchase' AND event_id % 2 = 0) AS s, count(*) FILTER (WHERE event_type <> 'error' AND event_id % 2 = 1) AS f FROM events GROUP BY 1), r(scenario, path, need) AS (VALUES {", ".join(map(str, RULES))}),
x AS (SELECT r.*, s, CASE WHEN path = 'streaming' THEN s ELSE f END AS own, CASE WHEN path = 'streaming' THEN f ELSE s END AS other FROM r LEFT JOIN e USING (scenario))
SELECT scenario, path, need, CASE WHEN s IS NULL THEN 'missing' WHEN (need = 'some' AND own > 0) OR (need = 'none' AND own = 0) OR (need = 'all' AND own > 0 AND other = 0) THEN 'pass' ELSE 'fail' END AS verdict FROM x
"""


def charsets(spark, sf_dir):
    """Charsets of headers and of meta tags in both forms, some after the first 1024 bytes; half of the pages keep their own tag."""
    d = F.md5("url")
    label = F.concat(F.lit("x-"), F.substring(d, 1, 4))
    header = F.when(_bit(0), F.concat(F.lit("text/html; Charset = "), F.when(_bit(1), F.concat(F.lit('"'), label, F.lit('"'))).otherwise(label), F.lit("; a=b"))).when(_bit(2), "text/html")
    http = F.concat(F.lit("<META http-equiv='Content-Type' content='text/html; charset=h"), F.substring(d, 5, 3), F.lit("'>"))
    meta = F.concat(F.when(_bit(3), http).otherwise(""), F.when(_bit(4), F.concat(F.lit('<meta charset="m'), F.substring(d, 5, 3), F.lit('">'))).otherwise(""))
    html = F.concat(F.repeat(F.lit("é"), F.when(_bit(5) & _bit(6), 600).otherwise(3)), meta, F.when(_bit(7), F.replace("html", F.lit("<meta"), F.lit("<mate"))).otherwise(F.col("html")))
    return pages(spark, sf_dir).select("page_id", X.detect_charset(header, html).alias("charset"))


CHARSETS_SQL = f"""
WITH b AS (SELECT page_id, {BITS} AS x, md5(url) AS d FROM pages)
SELECT page_id, upper(CASE WHEN x & 1 <> 0 THEN 'x-' || substr(d, 1, 4) WHEN x & 96 = 96 THEN 'utf-8' WHEN x & 16 <> 0 THEN 'm' || substr(d, 5, 3) WHEN x & 8 <> 0 AND x & 128 <> 0 THEN 'h' || substr(d, 5, 3) ELSE 'utf-8' END) AS charset FROM b
"""



def request_gates(spark, sf_dir):
    """Accept modes, and who is let through: modes, policies, tokens, cookies and Cache-Control come from the url's digest."""
    d = F.md5("url")
    mode = F.when(_bit(0) & _bit(1), "force").when(_bit(0), "wildcard").otherwise("strict")
    accept = F.when(_bit(2), F.concat(F.lit("text/html;q=0."), F.when(_bit(3), "9").otherwise("2"), F.lit(" , TEXT/Markdown; q=0.5"))).when(_bit(4), "image/png, */*;q=0.1")
    cookie = F.concat(F.lit("a=1; "), F.when(_bit(5), "wordpress_logged_in_").otherwise("theme"), F.substring(d, 1, 3), F.lit("=x"))
    cache = F.concat(F.when(_bit(6), "public, No-Transform").otherwise("max-age=5, x-no-transform"), F.lit(" , s-maxage=1"))
    policy = F.when(_bit(7), "deny").otherwise("allow")
    token = F.when(_bit(8) & _bit(9), "Bearer x")
    return pages(spark, sf_dir).select("page_id", D.accept_decision(mode, accept).alias("accept"), D.access(policy, token, cookie, no_transform(cache)).alias("access"))


GATES_SQL = f"""
WITH b AS (SELECT page_id, {BITS} AS x FROM pages)
SELECT page_id, CASE WHEN x & 3 = 3 THEN 'convert' WHEN x & 4 <> 0 THEN CASE WHEN x & 8 <> 0 THEN 'lower_q' ELSE 'convert' END WHEN x & 16 <> 0 AND x & 1 <> 0 THEN 'convert' ELSE 'no_accept' END AS accept,
  CASE WHEN x & 128 <> 0 AND (x & 768 = 768 OR x & 32 <> 0) THEN 'denied' WHEN x & 64 <> 0 THEN 'bypass' ELSE 'eligible' END AS access
FROM b
"""


def trusted_sources(spark, sf_dir):
    """Addresses made of the url's digest against networks of several lengths made of the nations."""
    n = F.col("n_nationkey").cast("string")
    nets = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("10."), n, F.lit(".0.0/16"))).when(F.col("n_nationkey") % 3 == 1, F.concat(n, F.lit(".0.0.0/8"))).otherwise(F.concat(F.lit("2001:db8:"), n, F.lit("::/48"))).alias("net"))
    nets = nets.union(spark.createDataFrame([("bad/8",), ("1.2.3.4/40",), ("200.1.2.3",)], "net string"))
    a, b = (F.conv(F.substring(F.md5("url"), k, 2), 16, 10) for k in (1, 3))
    ip = F.when(F.col("page_id") % 4 == 0, F.concat_ws(".", F.lit("10"), (a.cast("int") % 30).cast("string"), b, F.lit("1"))).when(F.col("page_id") % 4 == 1, F.concat_ws(".", (a.cast("int") % 40).cast("string"), b, F.lit("0.9"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("2001:DB8:"), (a.cast("int") % 30).cast("string"), F.lit("::"), b)).otherwise(F.when(b.cast("int") % 2 == 0, "200.1.2.3").otherwise("no address"))
    return D.in_networks(pages(spark, sf_dir).select("page_id", ip.alias("ip")), nets)


TRUSTED_SQL = """
WITH p AS (SELECT page_id, ('0x' || substr(md5(url), 1, 2))::INT AS a, ('0x' || substr(md5(url), 3, 2))::INT AS b FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '10.' || a % 30 || '.' || b || '.1' WHEN 1 THEN a % 40 || '.' || b || '.0.9' WHEN 2 THEN '2001:DB8:' || a % 30 || '::' || b ELSE CASE WHEN b % 2 = 0 THEN '200.1.2.3' ELSE 'no address' END END AS ip,
  CASE page_id % 4 WHEN 0 THEN (a % 30 < 25 AND a % 30 % 3 = 0) OR EXISTS (FROM nation WHERE n_nationkey % 3 = 1 AND n_nationkey = 10) WHEN 1 THEN (a % 40 < 25 AND a % 40 % 3 = 1) OR (a % 40 = 10 AND b < 25 AND b % 3 = 0) WHEN 2 THEN a % 30 < 25 AND a % 30 % 3 = 2 ELSE b % 2 = 0 END AS trusted
FROM p
"""

_ALL = {
    "trusted_sources": (trusted_sources, TRUSTED_SQL), "request_gates": (request_gates, GATES_SQL),
    "attribute_checks": (attributes, ATTRIBUTES_SQL), "url_checks": (url_checks, URL_SQL), "code_texts": (code_texts, CODE_SQL), "label_words": (label_words, LABEL_WORDS_SQL),
    "flag_decisions": (decisions, DECISIONS_SQL), "reason_counters": (reasons, REASONS_SQL), "failure_reasons": (failures, FAILURES_SQL), "conditional_modes": (conditional_modes, CONDITIONAL_SQL),
    "span_json": (spans, SPANS_SQL), "metric_paths": (metric_paths, METRIC_PATHS_SQL), "metric_names": (metric_names, METRIC_NAMES_SQL), "path_coverage": (path_coverage, PATH_COVERAGE_SQL), "charset_detection": (charsets, CHARSETS_SQL),
}
QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items()}

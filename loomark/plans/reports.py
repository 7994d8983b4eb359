"""Queries of reports, verdicts, networks and page structure over measurements derived from the tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomark.functions import structure as S
from loomark.functions.markdown import html_to_markdown
from loomark.operators import decisions as D
from loomark.operators import reports as R
from loomark.plans import conversion, policies
from loomark.plans.policies import pages
from loomark.streaming.chunks import convert_chunks, slice_bytes


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def pick(key, *values):
    """The key-th value, from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), key.cast("int") + 1)


def fixtures(spark, sf_dir):
    """Conversions as a benchmark would log them."""
    i = F.col("page_id")
    code, out = F.when(i % 13 == 0, 2).when(i % 11 == 0, 1).otherwise(0), F.when(i % 17 == 0, " \n").otherwise(F.col("html"))
    size = F.octet_length("html").cast("long")
    return pages(spark, sf_dir).select(
        F.format_string("f%06d", i).alias("fixture_id"), F.concat(F.lit("type"), (i % 5).cast("string")).alias("page_type"), R.outcome(code, out).alias("result"), size.alias("input_bytes"),
        F.floor(size * 7 / 10).cast("long").alias("output_bytes"), (i * 37 % 101).cast("double").alias("latency_ms"), (i % 23 == 5).alias("failure_corpus"))


FIXTURES_SQL = """SELECT 'f' || lpad(page_id::VARCHAR, 6, '0') AS fixture_id, 'type' || (page_id % 5)::VARCHAR AS page_type,
 CASE WHEN page_id % 13 = 0 THEN 'skipped' WHEN page_id % 11 = 0 OR page_id % 17 = 0 THEN 'failed-open' ELSE 'converted' END AS result, strlen(html) AS input_bytes,
 strlen(html) * 7 // 10 AS output_bytes, (page_id * 37 % 101)::DOUBLE AS latency_ms, page_id % 23 = 5 AS failure_corpus FROM pages"""


def corpus_summary(spark, sf_dir):
    return R.summary(fixtures(spark, sf_dir), "page_type")


SUMMARY_SQL = f"""WITH f AS ({FIXTURES_SQL})
SELECT page_type, count(*) AS fixtures, count(*) FILTER (WHERE result = 'converted') AS converted, count(*) FILTER (WHERE result = 'skipped') AS skipped, count(*) FILTER (WHERE result = 'failed-open') AS failed_open,
 round(count(*) FILTER (WHERE result = 'failed-open') * 100.0::DOUBLE / count(*), 2) AS fallback_rate,
 round(coalesce(sum((input_bytes - output_bytes) * 100.0::DOUBLE) FILTER (WHERE result = 'converted') / sum(input_bytes) FILTER (WHERE result = 'converted'), 0), 2) AS token_reduction,
 sum(input_bytes)::BIGINT AS input_total, sum(output_bytes) FILTER (WHERE result = 'converted')::BIGINT AS output_total,
 round(quantile_cont(latency_ms, 0.5), 2) AS p50, round(quantile_cont(latency_ms, 0.95), 2) AS p95, round(quantile_cont(latency_ms, 0.99), 2) AS p99 FROM f GROUP BY page_type"""


def report_examples(spark, sf_dir):
    return R.examples(fixtures(spark, sf_dir))


EXAMPLES_SQL = f"""WITH f AS ({FIXTURES_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY page_type ORDER BY input_bytes, fixture_id) - 1 AS k, count(*) OVER (PARTITION BY page_type) // 2 AS mid FROM f),
c AS (SELECT * EXCLUDE (k, mid) FROM r WHERE k = mid)
SELECT * FROM c UNION ALL (SELECT * FROM f WHERE failure_corpus AND NOT EXISTS (SELECT 1 FROM c WHERE failure_corpus) ORDER BY fixture_id LIMIT 1)"""

THRESHOLDS = [("linux", "t0", "click", 1.0, 3.0), ("default", "t0", "click", 50.0, 90.0), ("default", "t1", "view", -2.0, -4.0), ("mac", "t2", "view", 0.1, 0.2), ("default", "t3", "purchase", 0.5, 1.0)]
DIRECTIONS = [("click", "lower_is_better"), ("view", "higher_is_better"), ("purchase", "lower_is_better"), ("login", "informational")]


def _means(spark, sf_dir, odd: int, name: str):
    e = events(spark, sf_dir).where(F.col("event_id") % 2 == odd)
    return e.groupBy(F.concat(F.lit("t"), (F.col("user_id") % 6).cast("string")).alias("tier"), F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias(name))


def _tiers(spark, sf_dir):
    t = spark.createDataFrame(THRESHOLDS, "platform string, tier string, metric string, warning_pct double, blocking_pct double")
    d = spark.createDataFrame(DIRECTIONS, "metric string, direction string")
    return R.compare_tiers(_means(spark, sf_dir, 1, "now"), _means(spark, sf_dir, 0, "base"), t, d, "linux")


def threshold_verdicts(spark, sf_dir):
    return _tiers(spark, sf_dir)


_LIST = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in r) + ")" for r in rows)
TIERS_SQL = f"""
WITH m AS (SELECT 't' || (user_id % 6)::VARCHAR AS tier, event_type AS metric, round(avg(value) FILTER (WHERE event_id % 2 = 0), 6) AS base, round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS now FROM events GROUP BY 1, 2),
t(platform, tier, metric, w, b) AS (VALUES {_LIST(THRESHOLDS)}), d(metric, direction) AS (VALUES {_LIST(DIRECTIONS)}),
x AS (SELECT m.*, direction, coalesce(o.w, a.w, CASE WHEN direction = 'higher_is_better' THEN -15 ELSE 15 END) AS w, coalesce(o.b, a.b, CASE WHEN direction = 'higher_is_better' THEN -30 ELSE 30 END) AS b,
  round(CASE WHEN base = 0 THEN sign(now) * 100.0 ELSE (now - base) / base * 100.0 END, 4) AS deviation FROM m LEFT JOIN d USING (metric)
  LEFT JOIN t o ON o.platform = 'linux' AND o.tier = m.tier AND o.metric = m.metric LEFT JOIN t a ON a.platform = 'default' AND a.tier = m.tier AND a.metric = m.metric WHERE base IS NOT NULL AND now IS NOT NULL)
SELECT tier, metric, base, now, deviation, CASE WHEN direction = 'lower_is_better' AND deviation > b OR direction = 'higher_is_better' AND deviation < b THEN 'fail'
 WHEN direction = 'lower_is_better' AND deviation > w OR direction = 'higher_is_better' AND deviation < w THEN 'warn' ELSE 'pass' END AS verdict FROM x"""


def overall_verdicts(spark, sf_dir):
    return _tiers(spark, sf_dir).groupBy("tier").agg(R.worst("verdict").alias("verdict"), F.bool_and(F.col("verdict") != "fail").alias("released"))


OVERALL_SQL = f"""WITH v AS ({TIERS_SQL}) SELECT tier, CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict = 'warn') THEN 'warn' ELSE 'pass' END AS verdict, NOT bool_or(verdict = 'fail') AS released FROM v GROUP BY tier"""


def quality_verdicts(spark, sf_dir):
    m = _means(spark, sf_dir, 1, "now").join(_means(spark, sf_dir, 0, "base"), ["tier", "metric"])
    now, base = F.col("now"), F.col("base")
    low, rate = R.judge_quality(now, base, True, 5, 10, pass_delta=3.0), R.judge_quality(now, base, False, -2, -6, absolute=True)
    ratio = R.ratio_check(now, base, 1.0)
    return m.select("tier", "metric", low["delta"].alias("pct"), low["verdict"].alias("pct_verdict"), rate["delta"].alias("diff"), rate["verdict"].alias("diff_verdict"), ratio["ratio"].alias("ratio"), ratio["passed"].alias("passed"))


QUALITY_SQL = """
WITH m AS (SELECT 't' || (user_id % 6)::VARCHAR AS tier, event_type AS metric, round(avg(value) FILTER (WHERE event_id % 2 = 0), 6) AS base, round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS now FROM events GROUP BY 1, 2),
x AS (SELECT *, now - base AS d, CASE WHEN base = 0 THEN CASE WHEN now = 0 THEN 0.0 ELSE 100.0 END ELSE (now - base) / base * 100.0 END AS p FROM m WHERE base IS NOT NULL AND now IS NOT NULL)
SELECT tier, metric, round(p, 4) AS pct, CASE WHEN abs(d) < 3 THEN 'pass' WHEN p >= 10 THEN 'fail' WHEN p >= 5 THEN 'warn' ELSE 'pass' END AS pct_verdict, round(d, 4) AS diff,
 CASE WHEN d <= -6 THEN 'fail' WHEN d <= -2 THEN 'warn' ELSE 'pass' END AS diff_verdict, round(now / base, 4) AS ratio, now / base <= 1.0 AS passed FROM x"""


def median_runs(spark, sf_dir):
    """Medians over runs per tier and metric, the metrics unpivoted."""
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_returnflag", "tier")
    return R.unpivot(r, ["tier"], ["l_quantity", "l_discount", "l_tax"], "v").transform(lambda m: R.exact_percentiles(m, ["tier", "metric"], "v", {"median": 0.5}, 4))


MEDIAN_SQL = " UNION ALL ".join(f"SELECT l_returnflag AS tier, '{c}' AS metric, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median FROM lineitem GROUP BY 1" for c in ("l_quantity", "l_discount", "l_tax"))


def merged_reports(spark, sf_dir):
    e = events(spark, sf_dir).groupBy(F.format_string("run-%02d.json", F.col("user_id") % 12).alias("path"), "event_type").agg(F.max("event_id").alias("body"))
    tier = F.when((F.col("path") > "run-05.json") & (F.col("event_type") == "click"), "late_click").otherwise(F.col("event_type"))
    return R.merge_reports(e.select("path", "body", tier.alias("tier")))


MERGED_SQL = """WITH e AS (SELECT 'run-' || lpad((user_id % 12)::VARCHAR, 2, '0') || '.json' AS path, CASE WHEN event_type = 'click' AND user_id % 12 > 5 THEN 'late_click' ELSE event_type END AS tier, max(event_id) AS body FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY path DESC) AS k FROM e) SELECT tier, path, body FROM r WHERE k = 1"""


def evidence_coverage(spark, sf_dir):
    """Every page's id, some twice, against every document's."""
    rows = pages(spark, sf_dir).select((F.col("page_id") - F.when(F.col("page_id") % 9 == 0, 1).otherwise(0)).alias("scenario"))
    return R.coverage(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("scenario")), "scenario")


COVERAGE_SQL = """WITH r AS (SELECT page_id - CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END AS scenario, count(*) AS n FROM pages GROUP BY 1), w AS (SELECT DISTINCT doc_id AS scenario, TRUE AS w FROM documents)
SELECT * FROM (SELECT scenario, CASE WHEN n IS NULL THEN 'missing' WHEN w IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' END AS problem FROM r FULL JOIN w USING (scenario)) WHERE problem IS NOT NULL"""


def report_keys(spark, sf_dir):
    """Keys of JSON texts that are not kebab-case, at any depth, and the fields that they lack."""
    k = pick(F.col("event_id") % 4, '{"a-b": [{"cD": "x\\": y"}], "z_1": 2}', '{"k": {"ok-1": "q:"}}', '[{"9a": 1}]', "{props}")
    doc = F.when(F.col("event_id") % 4 == 3, F.col("props")).otherwise(k)
    return events(spark, sf_dir).select("event_id", F.concat_ws(",", R.bad_keys(doc)).alias("bad"), F.concat_ws(";", R.missing_fields(doc, ("k", "a-b"), "top-level")).alias("missing"))


KEYS_SQL = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'cD,z_1' WHEN 2 THEN '9a' ELSE '' END AS bad, CASE WHEN event_id % 4 = 0 THEN 'missing top-level field: k' WHEN event_id % 4 = 2 THEN 'missing top-level field: a-b;missing top-level field: k'
 ELSE 'missing top-level field: a-b' END AS missing FROM events"""


def load_results(spark, sf_dir):
    i = F.col("event_id")
    text = F.concat(
        F.lit("Server: x\nComplete requests:      "), F.when(i % 5 == 0, 90).otherwise(100).cast("string"), F.when(i % 6 == 0, "\n").otherwise(F.concat(F.lit("\nFailed requests:        "), (i % 4).cast("string"), F.lit("\n"))),
        F.when(i % 7 == 0, "Non-2xx responses:      3\n").otherwise(""), F.lit("Requests per second:    "), i.cast("string"), F.lit(".50 [#/sec]\n  50%      9\n  95%     14\n"), F.when(i % 3 > 0, "  99%     16\n").otherwise(""))
    r = R.load_result(text, F.lit(100))
    return events(spark, sf_dir).select("event_id", r["rps"].alias("rps"), r["p99"].alias("p99"), r["verdict"].alias("verdict"), r["reason"].alias("reason"))


LOAD_SQL = """WITH r AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'unparseable' WHEN event_id % 5 = 0 THEN 'request_count_mismatch' WHEN event_id % 4 <> 0 THEN 'failed_requests_nonzero' WHEN event_id % 7 = 0 THEN 'non_2xx_responses_nonzero' ELSE '' END AS reason FROM events)
SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id + 0.5::DOUBLE ELSE 0 END::DOUBLE AS rps, CASE WHEN event_id % 3 > 0 THEN 16 ELSE 0 END::DOUBLE AS p99, CASE WHEN reason = '' THEN 'pass' ELSE 'fail' END AS verdict, reason FROM r"""


def request_logs(spark, sf_dir):
    e, i = events(spark, sf_dir), F.col("event_id")
    rows = e.select((F.col("user_id") % 10).alias("scenario"), F.when(i % 301 == 0, 500).otherwise(200).alias("status_code"), F.when((i % 211 == 0) & (F.col("user_id") % 10 < 3), "timeout").otherwise(" ").alias("error"))
    return R.request_log(rows, 100, "scenario")


LOGS_SQL = """WITH g AS (SELECT user_id % 10 AS scenario, count(*) AS completed, count(*) FILTER (WHERE event_id % 211 = 0 AND user_id % 10 < 3) AS failed, count(*) FILTER (WHERE event_id % 301 = 0) AS non_2xx FROM events GROUP BY 1)
SELECT *, CASE WHEN completed <> 100 THEN 'request_count_mismatch' WHEN failed > 0 THEN 'transport_errors_nonzero' WHEN non_2xx > 0 THEN 'non_2xx_responses_nonzero' ELSE '' END AS reason, CASE WHEN completed <> 100 OR failed > 0 OR non_2xx > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM g"""


def response_checks(spark, sf_dir):
    i = F.col("page_id")
    dump = F.concat(
        F.lit("HTTP/1.1 100 Continue\r\n\r\nHTTP/1.1 "), F.when(i % 7 == 0, "500").otherwise("200"), F.lit(" X\r\nContent-Type:  "), F.when(i % 5 == 0, "text/html").otherwise("Text/Markdown; charset=utf-8"),
        F.lit("\r\nX-A: 1:2\r\n"), F.when(i % 4 == 0, "Content-Encoding: gzip\r\n").otherwise(""), F.lit("\r\n"))
    text = F.when(i % 11 == 0, "").when(i % 3 == 0, "# H\nbody <HTML> END.").when(i % 13 == 1, "# H\nEND. END.").otherwise("# H\nbody END.")
    h = R.response_headers(dump)
    bad = R.response_problem(h["status"], h["headers"], F.encode(text, "UTF-8"), F.lit("# H"), F.lit("END."), 1, True)
    return pages(spark, sf_dir).select("page_id", h["status"].alias("status"), F.element_at(h["headers"], "x-a").alias("x_a"), bad.alias("problem"))


RESPONSES_SQL = """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 500 ELSE 200 END AS status, '1:2' AS x_a, CASE WHEN page_id % 7 = 0 THEN 'http_status' WHEN page_id % 5 = 0 THEN 'content_type' WHEN page_id % 11 = 0 THEN 'body_empty' WHEN page_id % 4 = 0 THEN 'content_encoding'
 WHEN page_id % 3 = 0 THEN 'raw_html_detected' WHEN page_id % 13 = 1 THEN 'tail_token_count' END AS problem FROM pages"""


def known_differences(spark, sf_dir):
    registry = spark.createDataFrame([("D1", None, "blank"), ("D2", ".html", "list"), ("D3", "?page", None)], "id string, fixture_contains string, diff_contains string")
    diffs = pages(spark, sf_dir).select("page_id", F.col("url").alias("fixture"), pick(F.col("page_id") % 3, "blank drift", "list numbers", "blank list").alias("diff"))
    return R.known_differences(diffs, registry).select("page_id", F.concat_ws(",", "known").alias("known"), (F.size("known") == 0).alias("unexplained"))


KNOWN_SQL = """WITH k AS (SELECT page_id, concat_ws(',', CASE WHEN page_id % 3 <> 1 THEN 'D1' END, CASE WHEN page_id % 3 > 0 AND contains(url, '.html') THEN 'D2' END, CASE WHEN contains(url, '?page') THEN 'D3' END) AS known FROM pages) SELECT page_id, known, known = '' AS unexplained FROM k"""


def provider_tokens(spark, sf_dir):
    p = pick(F.col("doc_id") % 6, "openai", "anthropic", "google", "meta", "other", "default")
    ratio = R.provider_ratio(p, F.when(F.col("doc_id") % 7 == 0, F.lit(25)).otherwise(0)).cast("float")
    tokens = F.ceil((F.char_length("text").cast("float") / ratio).cast("float")).cast("long")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens.alias("n_tokens"), R.context_window(p).alias("context_window"))


PROVIDER_SQL = """SELECT doc_id, ceil((length(text)::FLOAT / CASE WHEN doc_id % 7 = 0 THEN 2.5 WHEN doc_id % 6 IN (0, 3) THEN 3.8 WHEN doc_id % 6 = 1 THEN 3.6 WHEN doc_id % 6 = 2 THEN 4.2 ELSE 4.0 END::FLOAT)::FLOAT)::BIGINT AS n_tokens,
 CASE doc_id % 6 WHEN 0 THEN 128000 WHEN 1 THEN 200000 WHEN 2 THEN 1000000 WHEN 3 THEN 128000 ELSE 0 END AS context_window FROM documents"""

ADDRESSES = ("10.1.2.3", "::ffff:10.9.9.9", "2001:db8::1", "fd00:0:0:0:0:0:0:1", "10.1.2.300", "::1", "2001:DB8:1::", "1:2:3:4:5:6:7:8:9", "text", "fe80::1::2")
HOSTS = ("a.example", "a_b:80", "a:0", "a:b:1", "[::1]", "[::1]:8080", "[x]", "a b", "é.example", "a:65536", ":80", "a/b", "a:", "[::1]x", "xn--e1a.example:443")


def ip_networks(spark, sf_dir):
    ip = pick(F.col("page_id") % len(ADDRESSES), *ADDRESSES)
    nets = {"ten": "10.0.0.0/8", "wide": "10.8.0.0/13", "doc": "2001:db8::/33", "any6": "::/0", "unique": "fc00::/7", "host": "::1"}
    return pages(spark, sf_dir).select("page_id", D.ip_hex(ip).alias("hex"), *[D.cidr_contains(ip, n).alias(k) for k, n in nets.items()])


NETWORKS_SQL = """WITH k AS (SELECT page_id, page_id % 10 AS k FROM pages) SELECT page_id, CASE k WHEN 0 THEN repeat('0', 20) || 'ffff0a010203' WHEN 1 THEN repeat('0', 20) || 'ffff0a090909' WHEN 2 THEN '20010db8' || repeat('0', 23) || '1' WHEN 3 THEN 'fd00' || repeat('0', 27) || '1'
 WHEN 5 THEN repeat('0', 31) || '1' WHEN 6 THEN '20010db80001' || repeat('0', 20) END AS hex, k IN (0, 1) AS ten, k = 1 AS wide, k IN (2, 6) AS doc, k IN (1, 2, 3, 5, 6) AS any6, k = 3 AS unique, k = 5 AS host FROM k"""


def valid_hosts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", D.validate_host(pick(F.col("page_id") % len(HOSTS), *HOSTS)).alias("host"))


HOSTS_SQL = "SELECT page_id, CASE page_id % 15 WHEN 0 THEN 'a.example' WHEN 1 THEN 'a_b:80' WHEN 4 THEN '[::1]' WHEN 5 THEN '[::1]:8080' WHEN 14 THEN 'xn--e1a.example:443' END AS host FROM pages"


def digests(spark, sf_dir):
    p, i = pages(spark, sf_dir), F.col("page_id")
    # a name of its own stands for one that the other side lacks
    other = lambda cond, suffix: F.when(cond, F.concat(i.cast("string"), F.lit(suffix))).otherwise(i.cast("string")).alias("name")
    declared = p.select(other(i % 5 == 0, ".d"), F.when(i % 7 == 0, "00").otherwise(F.upper(F.sha2(F.encode("html", "UTF-8"), 256))).alias("sha256"))
    return R.digest_check(p.select(other(i % 6 == 0, ".f"), F.encode("html", "UTF-8").alias("content")), declared)


DIGESTS_SQL = """WITH f AS (SELECT page_id AS i, page_id::VARCHAR || CASE WHEN page_id % 6 = 0 THEN '.f' ELSE '' END AS name FROM pages), d AS (SELECT page_id AS i, page_id::VARCHAR || CASE WHEN page_id % 5 = 0 THEN '.d' ELSE '' END AS name FROM pages)
SELECT name, CASE WHEN f.i IS NULL THEN 'absent' WHEN d.i IS NULL THEN 'undeclared' WHEN f.i % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM f FULL JOIN d USING (name)"""


def page_events(spark, sf_dir):
    e = conversion.pages(spark, sf_dir).select("page_id", F.explode(S.html_events(F.col("html"))).alias("e"))
    n = lambda kind, name: F.count_if((F.col("e.kind") == kind) & (F.col("e.name") == name))
    return e.groupBy("page_id").agg(n("start", "p").alias("p"), n("end", "p").alias("p_end"), n("start", "li").alias("li"), n("start", "b").alias("b"), F.count_if(F.col("e.kind") == "comment").alias("comments"), F.count_if(F.col("e.kind") == "doctype").alias("doctypes"))


_N = "len(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '{}'))"
EVENTS_SQL = "SELECT page_id, " + ", ".join(f"{_N.format(p)} AS {k}" for k, p in {"p": "<p>", "p_end": "</p>", "li": "<li>", "b": "<b>", "comments": "<!--", "doctypes": "<!DOCTYPE"}.items()) + " FROM pages"


def page_tables(spark, sf_dir):
    """Cells of a table of each region's nations."""
    row = F.format_string("<tr><td>%d<td> %s  x", "n_nationkey", "n_name")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("r"))
    html = F.concat(F.lit("<p>a<table><thead><tr><th>key</th><th>name</th></tr></thead>"), "r", F.lit("</table>"))
    return n.select("n_regionkey", F.explode(S.html_tables(html)).alias("c")).select("n_regionkey", F.col("c.row"), F.col("c.col"), F.col("c.header"), F.col("c.text"))


TABLES_SQL = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY '<tr><td>' || n_nationkey::VARCHAR || '<td> ' || n_name)::INT AS k FROM nation), r AS (SELECT DISTINCT n_regionkey FROM nation)
SELECT n_regionkey, 0 AS row, 0 AS col, TRUE AS header, 'key' AS text FROM r UNION ALL SELECT n_regionkey, 0, 1, TRUE, 'name' FROM r UNION ALL SELECT n_regionkey, k, 0, FALSE, n_nationkey::VARCHAR FROM n UNION ALL SELECT n_regionkey, k, 1, FALSE, n_name || ' x' FROM n"""


def page_meta(spark, sf_dir):
    m = conversion.pages(spark, sf_dir).select("page_id", F.explode(S.html_meta(F.col("html"))).alias("m"))
    return m.select("page_id", F.col("m.pos"), F.col("m.kind"), F.col("m.content"))


META_SQL = "SELECT page_id, 0 AS pos, 'title' AS kind, trim(" + conversion.DECODE.format(x="regexp_extract(html, '<title>(.*?)</title>', 1, 's')") + ") AS content FROM pages UNION ALL SELECT page_id, 1, 'charset', 'utf-8' FROM pages"


def decompression_counters(spark, sf_dir):
    d = policies.decompression(spark, sf_dir).withColumn("format", pick(F.col("page_id") % 6, "gzip", "deflate", "gzip", "gzip", "gzip", "br"))
    return d.groupingSets([["format"], ["status"], []], "format", "status").agg(F.coalesce("format", F.lit("*")).alias("f"), F.coalesce("status", F.lit("*")).alias("s"), F.count(F.lit(1)).alias("n")).select("f", "s", "n")


DECOMPRESSION_COUNTERS_SQL = f"""WITH d AS (SELECT *, CASE page_id % 6 WHEN 1 THEN 'deflate' WHEN 5 THEN 'br' ELSE 'gzip' END AS format FROM ({policies.DECOMPRESSION_SQL}))
SELECT coalesce(format, '*') AS f, coalesce(status, '*') AS s, count(*) AS n FROM d GROUP BY GROUPING SETS ((format), (status), ())"""


def path_hits(spark, sf_dir):
    return policies.processing_paths(spark, sf_dir).groupBy("path", "reason").agg(F.count(F.lit(1)).alias("hits"))


PATH_HITS_SQL = f"SELECT path, reason, count(*) AS hits FROM ({policies.PATHS_SQL}) GROUP BY ALL"


def parity(spark, sf_dir):
    """Whole and chunk-fed conversion side by side: both rates must be 1."""
    p = pages(spark, sf_dir)
    whole = p.select("page_id", html_to_markdown(F.col("html"), F.col("url")).alias("a"))
    fed = convert_chunks(slice_bytes(p, 1000)).select("page_id", F.col("markdown").alias("b"), "status")
    both = whole.join(fed, "page_id", "full")
    good = F.col("status") == "converted"
    rates = both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(good, 1.0).otherwise(0.0)).alias("pass_rate"), F.avg(F.when(F.col("a").eqNullSafe(F.col("b")), 1.0).otherwise(0.0)).alias("correctness_rate"))
    return rates.withColumn("passed", (F.col("pass_rate") == 1) & (F.col("correctness_rate") == 1))


PARITY_SQL = "SELECT count(*) AS n, 1.0::DOUBLE AS pass_rate, 1.0::DOUBLE AS correctness_rate, TRUE AS passed FROM pages"

_ALL = {
    "corpus_summary": (corpus_summary, SUMMARY_SQL), "report_examples": (report_examples, EXAMPLES_SQL), "threshold_verdicts": (threshold_verdicts, TIERS_SQL), "overall_verdicts": (overall_verdicts, OVERALL_SQL),
    "quality_verdicts": (quality_verdicts, QUALITY_SQL), "median_runs": (median_runs, MEDIAN_SQL), "merged_reports": (merged_reports, MERGED_SQL), "evidence_coverage": (evidence_coverage, COVERAGE_SQL),
    "report_keys": (report_keys, KEYS_SQL), "load_results": (load_results, LOAD_SQL), "request_logs": (request_logs, LOGS_SQL), "response_checks": (response_checks, RESPONSES_SQL), "known_differences": (known_differences, KNOWN_SQL),
    "provider_tokens": (provider_tokens, PROVIDER_SQL), "ip_networks": (ip_networks, NETWORKS_SQL), "valid_hosts": (valid_hosts, HOSTS_SQL), "digest_check": (digests, DIGESTS_SQL), "page_events": (page_events, EVENTS_SQL),
    "page_tables": (page_tables, TABLES_SQL), "page_meta": (page_meta, META_SQL), "decompression_counters": (decompression_counters, DECOMPRESSION_COUNTERS_SQL), "path_hits": (path_hits, PATH_HITS_SQL), "parity": (parity, PARITY_SQL),
}
QUERIES = {n: q for n, (q, _) in _ALL.items()}
ORACLE_SQL = {n: s for n, (_, s) in _ALL.items()}

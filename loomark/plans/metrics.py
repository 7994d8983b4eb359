"""Aggregates, windows, comparisons and verdicts over measurements (the events table stands for conversions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomark.operators.decisions import capped_paths
from loomark.operators.reports import deviation, exact_percentiles


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def counters(spark, sf_dir):
    """Counters by type: attempted, outcomes, failures, sums, disjoint bands of latency, high watermark."""
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(k % 5 < 3).alias("succeeded"), F.count_if(k % 5 == 3).alias("failed"), F.count_if(k % 5 == 4).alias("bypassed"),
        F.count_if(v <= 10).alias("le_10"), F.count_if((v > 10) & (v <= 100)).alias("le_100"), F.count_if((v > 100) & (v <= 1000)).alias("le_1000"), F.count_if(v > 1000).alias("above"),
        F.sum(F.ceil("value")).cast("long").alias("time_ms"), F.sum(k).alias("bytes"), F.round(F.max(v), 6).alias("high_watermark"),
    )


COUNTERS_SQL = """WITH e AS (SELECT *, (props::JSON ->> '$.k')::BIGINT AS k FROM events)
SELECT event_type, count(*) AS attempted, count(*) FILTER (WHERE k % 5 < 3) AS succeeded, count(*) FILTER (WHERE k % 5 = 3) AS failed, count(*) FILTER (WHERE k % 5 = 4) AS bypassed,
 count(*) FILTER (WHERE value <= 10) AS le_10, count(*) FILTER (WHERE value > 10 AND value <= 100) AS le_100, count(*) FILTER (WHERE value > 100 AND value <= 1000) AS le_1000,
 count(*) FILTER (WHERE value > 1000) AS above, sum(ceil(value))::BIGINT AS time_ms, sum(k)::BIGINT AS bytes, round(max(value), 6) AS high_watermark FROM e GROUP BY event_type"""


def percentiles(spark, sf_dir):
    return exact_percentiles(events(spark, sf_dir), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 2)


PERCENTILES_SQL = "SELECT event_type, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99 FROM events GROUP BY event_type"


def path_metrics(spark, sf_dir):
    hits = events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen"))
    return capped_paths(hits, 100)


PATHS_SQL = """WITH h AS (SELECT user_id::VARCHAR AS path, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY f, path) AS k FROM h)
SELECT CASE WHEN k <= 100 THEN path ELSE '__overflow__' END AS path, sum(n)::BIGINT AS n FROM r GROUP BY 1"""


def hourly(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy(F.date_trunc("hour", "ts").cast("string").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


HOURLY_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"


def slope(spark, sf_dir):
    """Memory against input by flag and line: four points at least, and a slope under the limit, else no pass."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y, x = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    n, of = F.count(F.lit(1)), F.round(F.regr_slope(y, x), 4)
    fitted = F.when(n >= 4, of)
    return li.groupBy("l_returnflag", "l_suppkey").agg(n.alias("n"), fitted.alias("slope"), F.when(n < 4, "too_few_points").when(of < 1500, "pass").otherwise("fail").alias("verdict"))


SLOPE_SQL = """WITH s AS (SELECT l_returnflag, l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 4) AS slope FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_suppkey, n, CASE WHEN n >= 4 AND isfinite(slope) THEN slope END AS slope, CASE WHEN n < 4 THEN 'too_few_points' WHEN slope < 1500 THEN 'pass' ELSE 'fail' END AS verdict FROM s"""


def judge(dev, warn: float, block: float, higher_is_worse: bool = True):
    bad = dev if higher_is_worse else -dev
    return F.when(bad >= block, "fail").when(bad >= warn, "warn").otherwise("pass")


def compare(spark, sf_dir):
    """Full outer comparison of two runs (even and odd events) by fixture, with a verdict each."""
    e = events(spark, sf_dir)
    user = (F.col("user_id") % 20).cast("string")
    # one run's fixtures of user 3 have a name that the other lacks
    key = lambda odd: F.concat_ws(":", "event_type", F.when(user == "3", F.lit(f"3.{odd}")).otherwise(user))
    run = lambda odd, name: e.where(F.col("event_id") % 2 == odd).groupBy(key(odd).alias("fixture")).agg(F.round(F.avg("value"), 6).alias(name))
    both = run(0, "base").join(run(1, "now"), "fixture", "full")
    dev = F.round(deviation(F.col("now"), F.col("base")), 4)
    verdict = F.when(F.col("base").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise(judge(dev, 15, 30))
    return both.select("fixture", "base", "now", dev.alias("deviation"), verdict.alias("verdict"))


COMPARE_SQL = """WITH k AS (SELECT *, event_type || ':' || (user_id % 20)::VARCHAR || CASE WHEN user_id % 20 = 3 THEN '.' || (event_id % 2) ELSE '' END AS fixture FROM events),
a AS (SELECT fixture, round(avg(value), 6) AS base FROM k WHERE event_id % 2 = 0 GROUP BY 1),
b AS (SELECT fixture, round(avg(value), 6) AS now FROM k WHERE event_id % 2 = 1 GROUP BY 1),
d AS (SELECT fixture, base, now, round(CASE WHEN base = 0 THEN sign(now) * 100.0 ELSE (now - base) / base * 100.0 END, 4) AS deviation FROM a FULL JOIN b USING (fixture))
SELECT *, CASE WHEN base IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN deviation >= 30 THEN 'fail' WHEN deviation >= 15 THEN 'warn' ELSE 'pass' END AS verdict FROM d"""


#: Metric, kind, help.
FAMILIES = (("markdown_events_total", "counter", "Events by type."), ("markdown_latency_max_ms", "gauge", "Highest latency."))


def prometheus(spark, sf_dir):
    """Exposition text: HELP and TYPE of each family, then its samples by label, as (family, rank, line)."""
    n = events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("m"))
    (a, *_), (b, *_) = FAMILIES
    one = lambda name, value: F.struct(F.lit(name).alias("family"), F.concat(F.lit(name + '{type="'), F.replace(F.replace("event_type", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"} '), value).alias("line"))
    samples = n.select(F.inline(F.array(one(a, F.col("n").cast("string")), one(b, F.format_string("%.3f", "m"))))).withColumn("rank", F.lit(2))
    head = [(name, f"# {word} {name} {text}", rank) for name, kind, help_ in FAMILIES for rank, (word, text) in enumerate((("HELP", help_), ("TYPE", kind)))]
    return spark.createDataFrame(head, "family string, line string, rank int").unionByName(samples)


PROMETHEUS_SQL = """WITH n AS (SELECT event_type, count(*) AS n, max(value) AS m FROM events GROUP BY 1)
SELECT * FROM (VALUES ('markdown_events_total', '# HELP markdown_events_total Events by type.', 0), ('markdown_events_total', '# TYPE markdown_events_total counter', 1),
 ('markdown_latency_max_ms', '# HELP markdown_latency_max_ms Highest latency.', 0), ('markdown_latency_max_ms', '# TYPE markdown_latency_max_ms gauge', 1)) t(family, line, rank)
UNION ALL SELECT 'markdown_events_total', 'markdown_events_total{type="' || event_type || '"} ' || n::VARCHAR, 2 FROM n
UNION ALL SELECT 'markdown_latency_max_ms', 'markdown_latency_max_ms{type="' || event_type || '"} ' || format('{:.3f}', m), 2 FROM n"""


def metrics_document(spark, sf_dir):
    """All counters as one JSON text: totals, and a list by type in its order."""
    c = counters(spark, sf_dir).groupBy().agg(F.sum("attempted").alias("attempted"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("event_type", "attempted", "failed"))).alias("types"))
    return c.select(F.to_json(F.struct(F.struct("attempted", "bytes").alias("totals"), "types")).alias("document"))


DOCUMENT_SQL = f"""WITH c AS ({COUNTERS_SQL})
SELECT '{{"totals":{{"attempted":' || sum(attempted) || ',"bytes":' || sum(bytes) || '}},"types":[' || string_agg('{{"event_type":"' || event_type || '","attempted":' || attempted || ',"failed":' || failed || '}}', ',' ORDER BY event_type) || ']}}' AS document FROM c"""

QUERIES = {"metrics_counters": counters, "metrics_percentiles": percentiles, "metrics_paths_capped": path_metrics, "metrics_hourly": hourly, "metrics_slope": slope, "report_comparison": compare, "metrics_prometheus": prometheus, "metrics_document": metrics_document}
ORACLE_SQL = {"metrics_counters": COUNTERS_SQL, "metrics_percentiles": PERCENTILES_SQL, "metrics_paths_capped": PATHS_SQL, "metrics_hourly": HOURLY_SQL, "metrics_slope": SLOPE_SQL, "report_comparison": COMPARE_SQL, "metrics_prometheus": PROMETHEUS_SQL, "metrics_document": DOCUMENT_SQL}

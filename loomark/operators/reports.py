"""Measurement reports: outcomes, summaries, thresholds, verdicts, merges and checks. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DEFAULT_WARNING, DEFAULT_BLOCKING = 15.0, 30.0
#: Verdicts by severity.
VERDICTS = ("pass", "warn", "fail")
#: Known differences that one registry holds at most.
RULES = 1000
TOP = {"50": 0.5, "95": 0.95, "99": 0.99}


def outcome(exit_code: Column, output: Column, skip_code: int = 2) -> Column:
    """skipped, converted (exit code 0 and output that is not blank) or failed-open."""
    return F.when(exit_code == skip_code, "skipped").when((exit_code == 0) & F.coalesce(output.rlike(r"\S"), F.lit(False)), "converted").otherwise("failed-open")


def token_reduction(n_in: Column, n_out: Column, factor: float = 1.0) -> Column:
    """Per cent; 0 for empty input."""
    return F.when(n_in <= 0, 0.0).otherwise((1 - n_out / n_in) * 100.0 * factor)


#: Ranges into which a group's values are cut to find a rank.
RANGES = 64


def exact_percentiles(rows: DataFrame, by: list[str], value: str, ps: dict[str, float], digits: int | None = None) -> DataFrame:
    """(by, a column for each of ps): exact percentiles, interpolated between ranks; null values don't count.

    No group ever meets in one task: values are counted where they lie; cuts of about equal shares (approximate ones do) make
    RANGES ranges of each group; sums by range tell which range holds a rank; and only the distinct values of those
    few ranges are put in order."""
    rows = rows.where(F.col(value).isNotNull())
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, c in enumerate(by)] or [F.lit("").alias("_k0")]
    names = [f"_k{i}" for i in range(len(keys))]
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).select(*keys, *by, F.col(value).cast("double").alias("_v"), "_n")
    cuts = rows.select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*names).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_total"))
    ranged = counts.join(cuts, names).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    sums = ranged.groupBy(*names, "_range").agg(F.sum("_n").alias("_sum"), F.first("_total").alias("_total"))
    below = F.coalesce(F.sum("_sum").over(W.partitionBy(*names).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # RANGES rows at most
    at = lambda p: F.lit(p) * (F.col("_total") - 1)
    wanted = F.array_distinct(F.array(*[f(at(p)).cast("long") for p in ps.values() for f in (F.floor, F.ceil)]))
    held = sums.withColumn("_below", below).withColumn("_ranks", F.filter(wanted, lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_sum")))).where(F.size("_ranks") > 0)
    values = ranged.drop("_cuts", "_total").join(held.select(*names, "_range", "_below", "_ranks", "_total"), [*names, "_range"])
    first = F.col("_below") + F.coalesce(F.sum("_n").over(W.partitionBy(*names, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    picked = values.withColumn("_first", first).select(*names, *by, "_total", "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_n")))).alias("_rank"))
    found = []
    for name, p in ps.items():
        low, high = (F.max(F.when(F.col("_rank") == f(at(p)).cast("long"), F.col("_v"))) for f in (F.floor, F.ceil))
        part = F.max(at(p) - F.floor(at(p)))
        got = low + (high - low) * part
        found.append((F.round(got, digits) if digits is not None else got).alias(name))
    return picked.groupBy(*names, *by).agg(*found).select(*by, *ps)


def summary(results: DataFrame, *by: str, factor: float = 1.0) -> DataFrame:
    """results (result, input_bytes, output_bytes, latency_ms) -> one row per group: counts, rates, bytes, percentiles."""
    n, done = F.count(F.lit(1)), F.col("result") == "converted"
    i, o = F.col("input_bytes"), F.col("output_bytes")
    weighted = F.sum(F.when(done & (i > 0), token_reduction(i, o, factor) * i)) / F.sum(F.when(done & (i > 0), i))
    counted = results.groupBy(*by).agg(
        n.alias("fixtures"),
        *[F.count_if(F.col("result") == r).alias(r.replace("-", "_")) for r in ("converted", "skipped", "failed-open")],
        F.round(F.when(n > 0, F.count_if(F.col("result") == "failed-open") / n * 100).otherwise(0.0), 2).alias("fallback_rate"),
        F.round(F.coalesce(weighted, F.lit(0.0)), 2).alias("token_reduction"),
        F.coalesce(F.sum(i), F.lit(0)).alias("input_total"),
        F.coalesce(F.sum(F.when(done, o)), F.lit(0)).alias("output_total"),
    )
    held = exact_percentiles(results, list(by), "latency_ms", {f"p{k}": p for k, p in TOP.items()}, 2)
    names = {c: f"_by{k}" for k, c in enumerate(by)}
    joined = counted.join(held.withColumnsRenamed(names), [F.col(c).eqNullSafe(F.col(x)) for c, x in names.items()] or F.lit(True), "left")
    return joined.select(*counted.columns, *[F.coalesce(f"p{k}", F.lit(0.0)).alias(f"p{k}") for k in TOP])


def examples(results: DataFrame) -> DataFrame:
    """The fixture of median input size of each page type (the upper one of two), ties by id; and, if none of these is of the
    failure corpus, the first one that is."""
    at = W.partitionBy("page_type")
    ranked = results.withColumn("_k", F.row_number().over(at.orderBy("input_bytes", "fixture_id"))).withColumn("_n", F.count(F.lit(1)).over(at))
    chosen = ranked.where(F.col("_k") == F.floor(F.col("_n") / 2) + 1).drop("_k", "_n")
    held = chosen.agg(F.coalesce(F.bool_or("failure_corpus"), F.lit(False)).alias("_held"))
    first = results.where("failure_corpus").orderBy("fixture_id").limit(1)
    # `held` is one row, so is `first`: the join is of one row with one row
    return chosen.unionByName(first.join(F.broadcast(held), F.lit(True)).where("not _held").drop("_held"))


def deviation(now: Column, base: Column) -> Column:
    """Per cent; 0, 100 or -100 where the baseline is zero."""
    return F.when(base == 0, F.signum(now.cast("double")) * 100.0).otherwise((now - base) / base * 100.0)


def judge(dev: Column, direction: Column, warning: Column, blocking: Column) -> Column:
    """Limits are crossed, not reached; those of higher_is_better are negative; other directions always pass."""
    low = F.when(dev > blocking, "fail").when(dev > warning, "warn")
    high = F.when(dev < blocking, "fail").when(dev < warning, "warn")
    return F.coalesce(F.when(direction == "lower_is_better", low).when(direction == "higher_is_better", high), F.lit("pass"))


def judge_quality(now: Column, base: Column, lower_is_better: bool, warning: float, blocking: float, absolute: bool = False, pass_delta: float | None = None) -> Column:
    """struct(delta, verdict): by difference, or by per cent with a floor of difference below which all passes. Reaching a limit counts."""
    diff = now - base
    if absolute:
        # the limits of a rate that should be high are negative differences
        delta, warn, block = diff, warning, blocking
    else:
        delta = F.when(base == 0, F.when(now == 0, 0.0).otherwise(100.0)).otherwise(diff / base * 100.0)
        warn, block = (warning, blocking) if lower_is_better else (-warning, -blocking)
    bad = F.when(delta >= block, "fail").when(delta >= warn, "warn") if lower_is_better else F.when(delta <= block, "fail").when(delta <= warn, "warn")
    verdict = F.coalesce(bad, F.lit("pass"))
    if pass_delta is not None and not absolute:
        verdict = F.when(F.abs(diff) < pass_delta, "pass").otherwise(verdict)
    return F.struct(F.round(delta, 4).alias("delta"), verdict.alias("verdict"))


def worst(verdict: str) -> Column:
    """Aggregate: fail over warn over pass."""
    return F.element_at(F.array(*map(F.lit, VERDICTS)), F.max(F.array_position(F.array(*map(F.lit, VERDICTS)), F.col(verdict))).cast("int"))


def unpivot(report: DataFrame, keys: list[str], metrics: list[str], value: str) -> DataFrame:
    """A row per metric: keys, metric, value."""
    return report.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", value).where(F.col(value).isNotNull())


def compare_tiers(now: DataFrame, base: DataFrame, thresholds: DataFrame, directions: DataFrame, platform: str) -> DataFrame:
    """now, base (tier, metric, now | base); thresholds (platform, tier, metric, warning_pct, blocking_pct), directions (metric,
    direction): each metric's deviation and verdict. Thresholds are the platform's own, else those of `default`, else built in.
    The thresholds and directions are configuration and small; the planner broadcasts them by their size."""
    both = now.join(base, ["tier", "metric"])
    for name, p in (("own", platform), ("any", "default")):
        t = thresholds.where(F.col("platform") == p).select("tier", "metric", F.struct("warning_pct", "blocking_pct").alias(name))
        both = both.join(t, ["tier", "metric"], "left")
    both = both.join(directions, "metric", "left")
    sign = F.when(F.col("direction") == "higher_is_better", -1.0).otherwise(1.0)
    held = F.coalesce("own", "any")
    limit = lambda f, d: F.coalesce(held[f], sign * d)
    dev = F.round(deviation(F.col("now"), F.col("base")), 4)
    return both.select("tier", "metric", "base", "now", dev.alias("deviation"), judge(dev, F.col("direction"), limit("warning_pct", DEFAULT_WARNING), limit("blocking_pct", DEFAULT_BLOCKING)).alias("verdict"))


def ratio_check(part: Column, whole: Column, most: float) -> Column:
    """struct(ratio, passed, reason): missing values fail; over zero a positive part gives infinity, any other 0."""
    ratio = F.when(F.abs(whole) >= 1e-15, part / whole).when(part > 0, float("inf")).otherwise(0.0)
    missing = part.isNull() | whole.isNull()
    return F.struct(F.round(F.when(~missing, ratio), 4).alias("ratio"), F.when(missing, False).otherwise(ratio <= most).alias("passed"), F.when(missing, "missing_data").alias("reason"))


def merge_reports(reports: DataFrame) -> DataFrame:
    """reports (path, tier, body): each tier of the report whose path sorts last."""
    return reports.groupBy("tier").agg(F.max("path").alias("path"), F.max_by("body", "path").alias("body"))


def coverage(rows: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """(key, problem): required keys that no row has are missing, keys of more than one row duplicate, keys not required unknown."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    wanted = required.select(key).distinct().withColumn("w", F.lit(True))
    both = n.join(wanted, key, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def json_keys(doc: Column) -> Column:
    """Every key in a JSON text at any depth, in order: of all its strings those that a colon follows."""
    strings = F.regexp_extract_all(doc, F.lit(r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'), F.lit(0))
    return F.transform(F.filter(strings, lambda s: F.endswith(s, F.lit(":"))), lambda s: F.regexp_extract(s, r'(?s)^"(.*)"\s*:$', 1))


def bad_keys(doc: Column) -> Column:
    """The keys that are not kebab-case."""
    return F.filter(json_keys(doc), lambda k: ~k.rlike(r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)*$"))


def missing_fields(doc: Column, fields: tuple[str, ...], context: str) -> Column:
    """Messages of the top-level fields that a JSON object lacks, in order of name; all of them for other JSON."""
    keys = F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))
    return F.transform(F.filter(F.array(*map(F.lit, sorted(fields))), lambda f: ~F.array_contains(keys, f)), lambda f: F.concat(F.lit(f"missing {context} field: "), f))


def load_result(report: Column, requests: Column) -> Column:
    """Of a load generator's text: struct(completed, failed, non_2xx, rps, p50, p95, p99, verdict, reason)."""
    number = lambda p: F.nullif(F.regexp_extract(report, p, 1), F.lit(""))
    done, failed = (number(rf"(?m)^{n} requests:\s+(\d+)\s*$").cast("long") for n in ("Complete", "Failed"))
    other = F.coalesce(number(r"(?m)^Non-2xx responses:\s+(\d+)\s*$").cast("long"), F.lit(0))
    reason = (
        F.when(done.isNull() | failed.isNull(), "unparseable").when(done != requests, "request_count_mismatch")
        .when(failed != 0, "failed_requests_nonzero").when(other != 0, "non_2xx_responses_nonzero")
    )
    speed = {"rps": number(r"Requests per second:\s+([\d.]+)"), **{f"p{k}": number(rf"\s+{k}%\s+(\d+)") for k in TOP}}
    whole = F.lit(True)
    for x in speed.values():
        whole = whole & x.isNotNull()
    return F.struct(
        done.alias("completed"), failed.alias("failed"), other.alias("non_2xx"), *[F.when(whole, x.cast("double")).otherwise(0.0).alias(k) for k, x in speed.items()],
        F.when(reason.isNull(), "pass").otherwise("fail").alias("verdict"), F.coalesce(reason, F.lit("")).alias("reason"),
    )


def request_log(rows: DataFrame, requests: int, *by: str) -> DataFrame:
    """rows (status_code, error), one a request -> completed, failed, non_2xx, verdict, reason per group."""
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("completed"), F.count_if(F.coalesce(F.trim("error"), F.lit("")) != "").alias("failed"),
        F.count_if(~F.col("status_code").between(200, 299)).alias("non_2xx"), F.count_if(F.col("status_code").isNull()).alias("_bad"),
    )
    reason = (
        F.when(F.col("_bad") > 0, "unparseable").when(F.col("completed") != requests, "request_count_mismatch")
        .when(F.col("failed") > 0, "transport_errors_nonzero").when(F.col("non_2xx") > 0, "non_2xx_responses_nonzero").otherwise("")
    )
    return out.withColumn("verdict", F.when(reason == "", "pass").otherwise("fail")).withColumn("reason", reason).drop("_bad")


def response_headers(dump: Column) -> Column:
    """struct(status, headers) of the last response in a header dump; names lower-cased; null if that has no status line."""
    blocks = F.filter(F.split(F.regexp_replace(dump, "\r\n?", "\n"), "\n\n+"), lambda b: b != "")
    lines = F.filter(F.split(F.get(blocks, F.size(blocks) - 1), "\n"), lambda x: x != "")
    status = F.regexp_extract(F.get(lines, F.lit(0)), r"^HTTP/\d+(?:\.\d+)? (\d{3})(?:[ \t]|$)", 1)
    fields = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.contains(x, F.lit(":")))
    entry = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))
    # of a name that is there twice the first stays
    entries = F.transform(fields, entry)
    names = F.transform(entries, lambda e: e["key"])
    first = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: F.array_position(names, e["key"]) == e["i"] + 1)
    as_map = F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"])))
    return F.when(status != "", F.struct(status.cast("int").alias("status"), as_map.alias("headers")))


def response_problem(status: Column, headers: Column, body: Column, heading: Column, tail: Column, tail_count: int = 1, compressed: bool = False) -> Column:
    """The first reason why a response is no good Markdown page; null if it is one."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(F.get(F.map_values(F.map_filter(headers, lambda k, v: k == "content-type")), F.lit(0)), F.lit("")), ";", 1)))
    coded = F.size(F.map_filter(headers, lambda k, v: (k == "content-encoding") & (v != ""))) > 0
    start = F.substring(F.hex(body), 1, 4)
    packed = start.startswith("1F8B") | start.isin("7801", "785E", "789C", "78DA")
    text = F.make_valid_utf8(body.cast("string"))
    found = (F.char_length(text) - F.char_length(F.replace(text, tail, F.lit("")))) / F.char_length(tail)
    return (
        F.when(status != 200, "http_status").when(kind != "text/markdown", "content_type").when(F.octet_length(body) == 0, "body_empty")
        .when(F.lit(compressed) & coded, "content_encoding").when(F.lit(compressed) & packed, "compressed_payload_detected")
        .when(~F.contains(text, heading), "heading_missing").when(found != tail_count, "tail_token_count")
        .when(F.lower(text).rlike("<html|<!doctype html"), "raw_html_detected")
    )


def known_differences(diffs: DataFrame, registry: DataFrame) -> DataFrame:
    """diffs (fixture, diff) with the ids of the acceptable differences of the registry (id, fixture_contains, diff_contains; null
    matches all) that explain them. The registry is configuration: it is gathered, RULES rows at most, and tested in one expression."""
    rules = registry.limit(RULES + 1).collect()
    if len(rules) > RULES:
        raise ValueError(f"over {RULES} known differences")
    hit = lambda r: (F.lit(True) if r.fixture_contains is None else F.contains("fixture", F.lit(r.fixture_contains))) & (F.lit(True) if r.diff_contains is None else F.contains("diff", F.lit(r.diff_contains)))
    ids = [F.when(hit(r), F.lit(r.id)) for r in sorted(rules, key=lambda r: r.id)]
    found = F.array_compact(F.array(*ids)) if ids else F.array().cast("array<string>")
    return diffs.withColumn("known", found)


def provider_ratio(provider: Column, tenths: Column | None = None) -> Column:
    """Characters a token of a provider's models; a positive number of tenths beats it, held between 1 and 100."""
    # fixed values
    own = F.when(provider == "openai", 3.8).when(provider == "anthropic", 3.6).when(provider == "google", 4.2).when(provider == "meta", 3.8).otherwise(4.0)
    return own if tenths is None else F.when(tenths > 0, F.least(F.greatest(tenths / 10.0, F.lit(1.0)), F.lit(100.0))).otherwise(own)


def context_window(provider: Column) -> Column:
    """Tokens; 0 where unknown."""
    # fixed values
    return F.when(provider == "openai", 128_000).when(provider == "anthropic", 200_000).when(provider == "google", 1_000_000).when(provider == "meta", 128_000).otherwise(0)


def split_budget(total: int) -> dict[str, int]:
    """Caps of a streaming memory budget's stages; 0 is the default. Larger totals scale all but the sniff buffer; of smaller
    ones the stages' caps sum to the total, and what rounding leaves goes round by one byte: output, stack, lookahead, sniff."""
    # fixed values
    parts = {"output": 256 << 10, "stack": 64 << 10, "lookahead": 64 << 10, "sniff": 1 << 10}
    whole = 2 << 20
    if total == 0:
        return parts
    if total >= whole:
        return {k: v if k == "sniff" else v * total // whole for k, v in parts.items()}
    every = sum(parts.values())
    out = {k: v * total // every for k, v in parts.items()}
    for k in list(out)[: total - sum(out.values())]:
        out[k] += 1
    return out


def digest_check(artifacts: DataFrame, declared: DataFrame) -> DataFrame:
    """artifacts (name, content) against declared (name, sha256): ok, mismatch, undeclared or absent."""
    both = artifacts.select("name", F.sha2("content", 256).alias("actual")).join(declared.select("name", F.lower("sha256").alias("expected")), "name", "full")
    status = F.when(F.col("actual").isNull(), "absent").when(F.col("expected").isNull(), "undeclared").when(F.col("actual") == F.col("expected"), "ok").otherwise("mismatch")
    return both.select("name", status.alias("status"))

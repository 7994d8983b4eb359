"""Checks of attributes, URLs, labels and reasons, the flag chain, conditional modes and the log's gate. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.functions.text import is_dangerous_url, sanitize_url

# fixed values
LABELS_ALLOWED = ("reason", "profile", "path_mode", "cache_validation")
LABELS_BLOCKED = ("url", "path", "uri", "host", "ip", "client_ip", "remote_addr", "user_agent", "ua", "request_id", "trace_id", "session_id")
# fixed values: reason codes by the counter that they add to, with the phase and the condition that they are logged at
REASONS = {
    "markdown_conversions_total": {"converted": "body_filter: after successful conversion and downstream NGX_OK"},
    "markdown_skipped_total": {
        "skipped_accept": "header_filter: Accept negotiation determined text/html preferred",
        "skipped_no_accept": "header_filter: no Accept header present",
        "skipped_conditional": "header_filter: conditional request matched (304)",
        "skipped_accept_reject": "header_filter: Accept explicitly rejects text/markdown (q=0)",
        "not_eligible": "header_filter: response not eligible (method/status/content-type)",
        "disabled": "header_filter: module disabled for this location",
        "bypass_no_transform": "header_filter: no-transform bypass",
    },
    "markdown_errors_total": {
        "decompression_error": "body_filter: decompression error",
        "decompression_budget_exceeded": "body_filter: decompression output exceeded budget",
        "decompression_format_error": "body_filter: invalid compression format",
        "decompression_truncated_input": "body_filter: truncated compressed input",
        "decompression_io_error": "body_filter: decompression I/O error",
        "timeout": "body_filter: timeout",
        "budget_exceeded": "body_filter: budget exceeded",
        "replay_error": "body_filter: replay error",
        "ffi_panic": "body_filter: FFI panic",
        "conversion_error": "body_filter: conversion error",
        "memory_budget_exceeded": "body_filter: memory budget exceeded",
        "header_plan_apply_error": "body_filter: header plan apply error",
        "streaming_mid_flight_error": "body_filter: streaming mid-flight error",
        "invalid_dynconf": "header_filter: invalid dynconf",
        "degraded_snapshot": "header_filter: degraded dynconf snapshot",
        "overload": "header_filter: inflight guard overload",
    },
    "markdown_failed_open_total": {"failed_open": "body_filter: fail-open path triggered"},
    "markdown_failed_closed_total": {"failed_closed": "body_filter: fail-closed path triggered"},
}
FAILURE_PREFIXES = ("failed_", "ELIGIBLE_FAILED", "FAIL_", "STREAMING_FAIL_", "STREAMING_PRECOMMIT_", "STREAMING_BUDGET_", "STREAMING_FALLBACK_")
#: Flags of the decision chain in the order in which they are asked, the value that ends it and the reason.
CHAIN = (
    ("enabled", False, "DISABLED"), ("eligible", False, "NOT_ELIGIBLE"), ("accept_present", False, "SKIP_NO_ACCEPT"), ("accept_markdown", False, "SKIP_ACCEPT"),
    ("not_modified", True, "SKIP_CONDITIONAL"), ("decompressed", False, "FAIL_DECOMPRESSION"), ("timed_out", True, "PARSE_TIMEOUT"), ("over_budget", True, "PARSE_BUDGET_EXCEEDED"),
)


def is_event_handler(name: Column) -> Column:
    return F.startswith(name, F.lit("on")) & (F.octet_length(name) > 2)


def attributes_to_remove(attrs: Column) -> Column:
    """Names, in order, of an array of (name, value): event handlers, style, and href and src with dangerous URLs."""
    bad = lambda a: is_event_handler(a["name"]) | (a["name"] == "style") | (a["name"].isin("href", "src") & is_dangerous_url(a["value"]))
    return F.transform(F.filter(attrs, bad), lambda a: a["name"])


def attributes_kept(attrs: Column) -> Column:
    """Names less those to remove."""
    return F.array_except(F.transform(attrs, lambda a: a["name"]), attributes_to_remove(attrs))


def attribute_action(attrs: Column) -> Column:
    """What the first bad attribute asks for: strip_attributes, or strip_url; allow if there is none."""
    first = F.get(attributes_to_remove(attrs), F.lit(0))
    return F.when(first.isNull(), "allow").when(first.isin("href", "src"), "strip_url").otherwise("strip_attributes")


def has_controls(url: Column) -> Column:
    """C0 control characters but tab, newline and carriage return."""
    return url.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def link_has_controls(url: Column) -> Column:
    return url.rlike(r"[\x00-\x1F]")


def host_has_invalid(host: Column) -> Column:
    return host.rlike(r"[\x00-\x20\x7F/\\,]")


def link_error(url: Column) -> Column:
    """The first objection to a link's URL; null for none."""
    return F.when(link_has_controls(url), "URL contains control characters").when(sanitize_url(url).isNull(), "URL has dangerous scheme")


def label_class(name: Column) -> Column:
    """allowed, blocked or unknown, without case."""
    low = F.lower(name)
    return F.when(low.isin(*LABELS_ALLOWED), "allowed").when(low.isin(*LABELS_BLOCKED), "blocked").otherwise("unknown")


def reason_table(spark: SparkSession) -> DataFrame:
    """(reason, metric_key, callsite): a fixed table, small enough for any join to broadcast."""
    return spark.createDataFrame([(r, k, c) for k, rows in REASONS.items() for r, c in rows.items()], "reason string, metric_key string, callsite string")


def with_reasons(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """rows with metric_key and callsite; null for unknown reasons."""
    table = reason_table(rows.sparkSession).withColumnRenamed("reason", "_reason")
    return rows.join(F.broadcast(table), F.col(reason) == F.col("_reason"), "left").drop("_reason")


def decide(flags: dict[str, Column]) -> Column:
    """CONVERT, or the reason of the first flag that ends the chain."""
    out = F.lit("CONVERT")
    for name, ends, reason in reversed(CHAIN):
        out = F.when(flags[name] if ends else ~flags[name], reason).otherwise(out)
    return out


def decide_conditional(mode: Column, has_range: Column, no_transform: Column, if_none_match: Column, etag: Column, if_modified_since: Column, last_modified: Column) -> Column:
    """struct(outcome, reason, header): range and no-transform bypass; off proceeds; ims_only looks at dates alone; full at
    If-None-Match first, and at dates only without it."""
    from loomark.operators.decisions import not_modified

    of = lambda hit, why, header: F.named_struct(F.lit("outcome"), F.when(hit, "not_modified").otherwise("proceed"), F.lit("reason"), F.lit(why), F.lit("header"), F.lit(header))
    fixed = lambda outcome, why: F.named_struct(F.lit("outcome"), F.lit(outcome), F.lit("reason"), F.lit(why), F.lit("header"), F.lit("none"))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("long")
    dates = of(not_modified(none, etag, if_modified_since, last_modified), "ims_evaluated", "if_modified_since")
    tags = of(not_modified(if_none_match, etag, nothing, nothing), "inm_evaluated", "if_none_match")
    return (
        F.when(has_range, fixed("bypass", "bypass_range"))
        .when(no_transform, fixed("bypass", "bypass_no_transform"))
        .when(mode == "off", fixed("proceed", "no_headers"))
        .when((mode == "full") & if_none_match.isNotNull(), tags)
        .when(if_modified_since.isNotNull(), dates)
        .otherwise(fixed("proceed", "no_headers"))
    )


def is_failure(reason: Column) -> Column:
    """Whether a reason is a failure, for the log: by prefix, or an error code."""
    out = reason.isin(*REASONS["markdown_errors_total"])
    for p in FAILURE_PREFIXES:
        out = out | F.startswith(reason, F.lit(p))
    return F.coalesce(out, F.lit(False))


def logged(verbosity: Column, reason: Column) -> Column:
    """info and debug log every decision, warn and error failures only."""
    return F.when(verbosity.isin("info", "debug"), True).otherwise(is_failure(reason))


def span_json(traceparent: Column, name: Column, attributes: dict[str, Column], begin_ns: Column, end_ns: Column) -> Column:
    """A span as JSON text; it belongs to the trace of a valid traceparent, else it has no parent."""
    from loomark.operators.policy import parse_traceparent

    parent = parse_traceparent(traceparent)
    values = F.struct(*[v.alias(k) for k, v in attributes.items()])
    return F.to_json(F.struct(parent["trace_id"].alias("traceId"), parent["parent_id"].alias("parentSpanId"), name.alias("name"), begin_ns.alias("startTimeUnixNano"), end_ns.alias("endTimeUnixNano"), values.alias("attributes")))


def missing_paths(document: Column, paths: tuple[str, ...]) -> Column:
    """Paths (a.b.c) under which a JSON text has no value, in the given order."""
    return F.array_compact(F.array(*[F.when(F.get_json_object(document, f"$.{p}").isNull(), p) for p in paths]))


def unknown_names(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Distinct names that the schema lacks."""
    return names.select(name).distinct().join(known.select(name), name, "left_anti")


def path_coverage(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows (scenario, streaming_hits, fullbuffer_hits) against rules (scenario, path, need): of a path streaming or fullbuffer
    need is `some`, `none` or `all` hits. -> (scenario, path, need, verdict); missing where no row has the scenario."""
    table = rows.sparkSession.createDataFrame(rules, "scenario string, path string, need string")
    s, f = F.col("streaming_hits"), F.col("fullbuffer_hits")
    own, other = F.when(F.col("path") == "streaming", s).otherwise(f), F.when(F.col("path") == "streaming", f).otherwise(s)
    held = F.when(F.col("need") == "some", own > 0).when(F.col("need") == "none", own == 0).otherwise((own > 0) & (other == 0))
    verdict = F.when(s.isNull(), "missing").when(held, "pass").otherwise("fail")
    return F.broadcast(table).join(rows, "scenario", "left").select("scenario", "path", "need", verdict.alias("verdict"))

"""Policies over requests as native expressions: caching, dates, routing, configuration, header plans, commit states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomark.operators.decisions import BLOCKED_STREAMS

# fixed values
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DEFAULTS = {"accept": "strict", "cache": "ims_only", "streaming": "auto", "max_size": 10 << 20, "timeout_ms": 5000}
PROFILES = {
    "strict_cache": {"accept": "strict", "cache": "full", "streaming": "off", "max_size": 8 << 20, "timeout_ms": 2000},
    "balanced": {"accept": "strict", "cache": "ims_only", "streaming": "auto", "max_size": 8 << 20, "timeout_ms": 2000},
    "streaming_first": {"accept": "wildcard", "cache": "off", "streaming": "force", "max_size": 8 << 20, "timeout_ms": 2000},
}
FORCED = {"strict_cache": {"streaming": "off"}, "streaming_first": {"cache": "off", "streaming": "force"}}
ERROR_CLASSES = {"conversion": (1, 2, 5, 7, 12, 13, 14), "timeout": (3, 10), "memory": (4, 6, 9, 11), "mid_flight": (8,)}


def cache_control_private(header: Column) -> Column:
    """Cache-Control of authenticated content: private is added and public goes; private and no-store stay as they are.
    A header with open quotes or a name that is no token becomes `private, no-store`."""
    parts = F.transform(F.split(header, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda p: F.btrim(p))
    names = F.transform(parts, lambda p: F.lower(F.btrim(F.substring_index(p, "=", 1))))
    odd = (F.char_length(header) - F.char_length(F.replace(header, F.lit('"'), F.lit("")))) % 2 == 1
    bad = odd | F.exists(names, lambda n: ~n.rlike(r"^[!#$%&'*+.^_`|~0-9a-z-]+$"))
    others = F.filter(parts, lambda p: F.lower(F.btrim(F.substring_index(p, "=", 1))) != "public")
    return (
        F.when(header.isNull() | (F.btrim(header) == ""), "private")
        .when(bad, "private, no-store")
        .when(F.arrays_overlap(names, F.array(F.lit("private"), F.lit("no-store"))), header)
        .when(F.array_contains(names, "public"), F.concat_ws(", ", others, F.lit("private")))
        .otherwise(F.concat(header, F.lit(", private")))
    )


def no_transform(header: Column) -> Column:
    return F.coalesce(header.rlike(r"(?i)(^|,)\s*no-transform\s*($|,)"), F.lit(False))


def parse_http_date(c: Column) -> Column:
    """Epoch seconds of an IMF-fixdate from 1970 to 2100 (the weekday's name is checked, not its day); else null."""
    shape = rf"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d\d ({'|'.join(MONTHS)}) \d{{4}} ([01]\d|2[0-3]):[0-5]\d:[0-5]\d GMT$"
    part = lambda at, n: F.substring(c, at, n)
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), part(9, 3)).cast("string"), 2, "0")
    day = F.concat_ws("-", part(13, 4), month, part(6, 2)).try_cast("date")
    seconds = F.unix_date(day).cast("long") * 86400 + part(18, 2).try_cast("int") * 3600 + part(21, 2).try_cast("int") * 60 + part(24, 2).try_cast("int")
    return F.when(c.rlike(shape) & part(13, 4).between("1970", "2100"), seconds)


def parse_size(c: Column) -> Column:
    """Bytes of 8m, 256k, 1g or a plain number; null for other text."""
    unit = F.lower(F.regexp_extract(c, r"^\d+([kKmMgG]?)$", 1))
    number = F.regexp_extract(c, r"^(\d+)[kKmMgG]?$", 1).try_cast("long")
    return number * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)


def parse_traceparent(c: Column) -> Column:
    """struct(trace_id, parent_id, sampled) of version 00; null where it is malformed or an id is all zero."""
    shape = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    g = lambda i: F.regexp_extract(c, shape, i)
    ok = c.rlike(shape) & ~g(1).rlike("^0+$") & ~g(2).rlike("^0+$")
    return F.when(ok, F.struct(g(1).alias("trace_id"), g(2).alias("parent_id"), (F.conv(g(3), 16, 10).cast("int") % 2 == 1).alias("sampled")))


def processing_path(policy: Column, method: Column, status: Column, cache: Column, content_type: Column, length: Column, threshold: int, excluded: tuple[str, ...] = ()) -> Column:
    """struct(path, reason): the first rule that applies."""
    main = F.lower(F.btrim(F.substring_index(content_type, ";", 1)))
    full = lambda why: F.struct(F.lit("fullbuffer").alias("path"), F.lit(why).alias("reason"))
    stream = F.struct(F.lit("streaming").alias("path"), F.lit("eligible").alias("reason"))
    return (
        F.when(policy == "off", full("config_disabled"))
        .when((method == "HEAD") | (status == 304) | (cache == "full"), full("not_candidate"))
        .when(main.isin(*BLOCKED_STREAMS, *excluded), full("excluded_content_type"))
        .when(policy == "force", stream)
        .when((length >= 0) & (length < threshold), full("below_threshold"))
        .otherwise(stream)
    )


def error_behaviour(policy: Column, committed: Column) -> Column:
    """terminate after the commit; before it pass, the status of status(n), or 502."""
    n = F.regexp_extract(policy, r"^status\((\d{3})\)$", 1)
    return F.when(committed, "terminate").when(policy == "pass", "pass").when(n != "", n).otherwise("502")


def error_class(code: Column) -> Column:
    out = F.lit("panic")
    for name, codes in ERROR_CLASSES.items():
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def effective(field: str, explicit: Column, profile: Column) -> Column:
    """The explicit value, else the profile's, else the default."""
    of_profile = F.lit(None)
    for name, values in PROFILES.items():
        of_profile = F.when(profile == name, F.lit(values[field])).otherwise(of_profile)
    return F.coalesce(explicit, of_profile, F.lit(DEFAULTS[field]))


def conflicts(profile: Column, streaming: Column, cache: Column, on_error: Column) -> Column:
    """Array of error:… and warning:… of explicit streaming and cache under a profile."""
    found = []
    for name, fields in FORCED.items():
        for field, value in fields.items():
            given = {"streaming": streaming, "cache": cache}[field]
            found.append(F.when((profile == name) & (given != value), f"error:{name}_forces_{field}"))
    s, c = effective("streaming", streaming, profile), effective("cache", cache, profile)
    found.append(F.when((c == "full") & (s == "force"), "error:full_with_force"))
    found.append(F.when((c == "full") & (s == "auto"), "warning:full_with_auto"))
    found.append(F.when((on_error == "fail_closed") & (s == "force"), "warning:fail_closed_with_force"))
    return F.array_compact(F.array(*found))


def header_plan(kind: Column, content_type: Column, has_etag: Column) -> Column:
    """Array of (op, name, value) for convert, head, error, not_modified, no_body; empty for bypass and pass_through."""
    op = lambda o, n, v=None: F.struct(F.lit(o).alias("op"), F.lit(n).alias("name"), (v if v is not None else F.lit(None).cast("string")).alias("value"))
    drop = lambda *names: [op("delete", n) for n in names]
    typed = op("set", "Content-Type", content_type)
    body = F.array(typed, *drop("Content-Encoding", "Content-Length"))
    none = F.filter(body, lambda _: F.lit(False))
    return (
        F.when(kind.isin("convert", "head"), F.when(has_etag, F.concat(body, F.array(op("etag", "ETag")))).otherwise(body))
        .when(kind == "error", F.array(typed, *drop("Content-Length", "ETag", "Content-Encoding")))
        .when(kind == "not_modified", F.array(*drop("Content-Length", "Content-Encoding")))
        .when(kind == "no_body", F.array(*drop("Content-Length")))
        .otherwise(none)
    )


def apply_headers(headers: Column, plan: Column, etag: Column) -> Column:
    """Map of headers after a plan; names compare without case. The plan is applied whole."""
    touched = F.transform(plan, lambda p: F.lower(p["name"]))
    kept = F.map_filter(headers, lambda k, _: ~F.array_contains(touched, F.lower(k)))
    new = F.filter(plan, lambda p: p["op"].isin("set", "etag"))
    return F.map_concat(kept, F.map_from_arrays(F.transform(new, lambda p: p["name"]), F.transform(new, lambda p: F.when(p["op"] == "etag", etag).otherwise(p["value"]))))


TO_FULL = ("strict_etag", "look_behind_overflow", "auto_risk", "full_doc_feature")


def next_state(state: Column, event: Column, within_limits: Column, on_error: Column) -> Column:
    """The commit machine's next state; states without a rule for the event stay."""
    full = F.when(within_limits, "full_buffer_fallback").otherwise("passthrough")
    return (
        F.when(state == "not_eligible", F.when(event == "eligible", "streaming_candidate").otherwise("passthrough"))
        .when(state == "streaming_candidate", F.when(event == "streaming_start", "pre_commit").when(event.isin(*TO_FULL), full).otherwise("passthrough"))
        .when(state == "pre_commit", F.when(event == "commit", "committed").when(event.isin(*TO_FULL), full).when(event.isin("parser_unsuitable", "hard_excluded", "budget_init_failure", "on_error_pass", "on_error_reject", "resource_limit"), "passthrough").otherwise(state))
        .when(state == "committed", F.when(event == "error", F.when(on_error == "pass", "post_commit_safe_finish").otherwise("post_commit_abort")).otherwise(state))
        .when(state == "full_buffer_fallback", F.when(event == "resource_limit", "passthrough").otherwise(state))
        .otherwise(state)
    )


def commit_state(events: Column, within_limits: Column, on_error: Column) -> Column:
    """State after an array of events, from not_eligible."""
    return F.aggregate(events, F.lit("not_eligible"), lambda s, e: next_state(s, e, within_limits, on_error))

"""The decision chain over requests, as native expressions that sit below any Python in a plan."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
MAX_ENTRIES, MAX_MIME, MAX_HEADER = 64, 128, 4096
BLOCKED_STREAMS = ("text/event-stream", "application/x-ndjson", "application/stream+json")
AUTH_COOKIES = ("session*", "auth*", "PHPSESSID", "wordpress_logged_in_*")


def q_value(params: Column) -> Column:
    """Thousandths of the entry's q parameter; 1000 where there is none or it is not a number from 0 to 1."""
    raw = F.regexp_extract(params, r";\s*[qQ]=([^;]*)", 1)
    q = F.btrim(raw).try_cast("double")
    return F.when(q.between(0, 1), F.round(q * 1000).cast("int")).otherwise(F.lit(1000))


def accept_entries(header: Column) -> Column:
    """Array of (mime, q) of an Accept header."""
    parts = F.filter(F.slice(F.split(header, ","), 1, MAX_ENTRIES), lambda e: F.btrim(e) != "")
    each = F.transform(parts, lambda e: F.named_struct(F.lit("mime"), F.lower(F.btrim(F.substring_index(e, ";", 1))), F.lit("q"), q_value(e)))
    return F.filter(each, lambda e: F.char_length(e["mime"]) <= MAX_MIME)


def best_q(entries: Column, mime: str) -> Column:
    return F.array_max(F.transform(F.filter(entries, lambda e: e["mime"] == mime), lambda e: e["q"]))


def negotiate_accept(header: Column, wildcard: bool = False) -> Column:
    """convert, or why not: no_accept, malformed, explicit_reject, lower_q."""
    entries = accept_entries(header)
    md, html = best_q(entries, "text/markdown"), F.coalesce(best_q(entries, "text/html"), F.lit(0))
    if wildcard:
        md = F.coalesce(md, best_q(entries, "text/*"), best_q(entries, "*/*"))
    return (
        F.when(header.isNull() | (F.btrim(header) == ""), "no_accept")
        .when(F.octet_length(header) > MAX_HEADER, "malformed")
        .when(md.isNull(), "no_accept")
        .when(md == 0, "explicit_reject")
        .when(md >= html, "convert")
        .otherwise("lower_q")
    )


def accept_decision(mode: Column, header: Column) -> Column:
    """The decision under a mode: strict, wildcard (*/* and text/* stand for Markdown), or force, which doesn't look at the header."""
    return F.when(mode == "force", "convert").when(mode == "wildcard", negotiate_accept(header, True)).otherwise(negotiate_accept(header))


def content_type_matches(content_type: Column, allowed: tuple[str, ...] = ("text/html",)) -> Column:
    out = F.lit(False)
    for a in allowed:
        out = out | content_type.rlike(rf"(?i)^{a}($|[; \t])")
    return F.coalesce(out, F.lit(False))


def eligibility(enabled: Column, method: Column, status: Column, range_: Column, content_type: Column, length: Column, limit: Column) -> Column:
    """The first reason that applies: config, method, status, range, streaming, content_type, size; else eligible."""
    main = F.lower(F.btrim(F.substring_index(content_type, ";", 1)))
    return (
        F.when(~enabled, "ineligible_config")
        .when(~method.isin("GET", "HEAD"), "ineligible_method")
        .when(status == 206, "ineligible_range")
        .when(status != 200, "ineligible_status")
        .when(range_.isNotNull(), "ineligible_range")
        .when(main.isin(*BLOCKED_STREAMS), "ineligible_streaming")
        .when(~content_type_matches(content_type), "ineligible_content_type")
        .when((limit > 0) & (length >= 0) & (length > limit), "ineligible_size")
        .otherwise("eligible")
    )


def cookie_names(header: Column) -> Column:
    return F.transform(F.split(F.coalesce(header, F.lit("")), ";"), lambda c: F.btrim(F.substring_index(c, "=", 1)))


def is_authenticated(authorization: Column, cookie: Column, patterns: tuple[str, ...] = AUTH_COOKIES) -> Column:
    def hit(name: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | (name.startswith(p[:-1]) if p.endswith("*") else name.endswith(p[1:]) if p.startswith("*") else name == p)
        return out

    return authorization.isNotNull() | F.exists(cookie_names(cookie), hit)


def access(policy: Column, authorization: Column, cookie: Column, no_transform: Column) -> Column:
    """eligible; denied for authenticated requests under the policy deny; bypass where the response must not be transformed."""
    return F.when((policy == "deny") & is_authenticated(authorization, cookie), "denied").when(F.coalesce(no_transform, F.lit(False)), "bypass").otherwise("eligible")


def not_modified(if_none_match: Column, etag: Column, if_modified_since: Column, last_modified: Column) -> Column:
    """Whether 304 is right: If-None-Match (weak comparison, *) beats If-Modified-Since (seconds)."""
    bare = lambda c: F.regexp_replace(F.btrim(c), "^W/", "")
    match = F.exists(F.split(if_none_match, ","), lambda t: (F.btrim(t) == "*") | (bare(t) == bare(etag)))
    return F.coalesce(F.when(if_none_match.isNotNull(), match).otherwise(last_modified <= if_modified_since), F.lit(False))


def ip_hex(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address, or of an IPv4 address mapped into IPv6; null for other text."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    dotted = rf"{octet}\.{octet}\.{octet}\.{octet}$"
    pair = lambda c, p, i: F.lpad(F.lower(F.hex(F.regexp_extract(c, p, i).try_cast("bigint"))), 2, "0")
    four = F.concat(F.lit("0" * 20 + "ffff"), *[pair(ip, "^" + dotted, i) for i in range(1, 5)])
    tail = lambda i: pair(ip, "(?<=:)" + dotted, i)
    plain = F.lower(F.when(F.contains(ip, F.lit(".")), F.concat(F.regexp_replace(ip, "[0-9.]*$", ""), tail(1), tail(2), F.lit(":"), tail(3), tail(4))).otherwise(ip))
    halves = F.split(plain, "::", -1)
    groups = lambda c: F.filter(F.split(c, ":", -1), lambda g: c != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    n, cuts = F.size(left) + F.size(right), F.size(halves)
    fits = ((cuts == 1) & (n == 8)) | ((cuts == 2) & (n < 8))
    good = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    padded = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")
    six = F.concat(padded(left), F.repeat(F.lit("0000"), F.greatest(8 - n, F.lit(0))), padded(right))
    return F.when(ip.rlike("^" + dotted), four).when(F.contains(ip, F.lit(":")) & fits & good, six)


def cidr_contains(ip: Column, net: str) -> Column:
    """Whether an address lies in net: a.b.c.d/p or IPv6/p; a bare address is a net of itself. Mapped IPv6 addresses lie in
    IPv4 nets, IPv4 addresses in no IPv6 net. Text that is no address lies in none; a net that is none is an error."""
    base, _, prefix = net.strip().partition("/")
    address = ipaddress.ip_address(base)
    whole = address.max_prefixlen
    bits = int(prefix) if prefix else whole
    if (prefix and not re.fullmatch("[0-9]+", prefix)) or bits > whole:
        raise ValueError(f"no network: {net}")
    digits = address.packed.hex().rjust(32, "0") if whole == 128 else "0" * 20 + "ffff" + address.packed.hex()
    bits += 128 - whole
    full, part = divmod(bits, 4)
    h = ip_hex(ip)
    found = F.startswith(h, F.lit(digits[:full]))
    if part:
        low = int(digits[full], 16) >> (4 - part) << (4 - part)
        found = found & F.substring(h, full + 1, 1).isin([f"{x:x}" for x in range(low, low + (1 << (4 - part)))])
    if whole == 128:
        found = found & F.contains(ip, F.lit(":"))
    return F.coalesce(found, F.lit(False))


def prefix_bits(ip: Column) -> Column:
    """The 128 bits of an address as text; null for text that is none."""
    nibbles = F.transform(F.split(ip_hex(ip), "(?<=.)(?=.)"), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0"))
    return F.array_join(nibbles, "")


def in_networks(rows: DataFrame, nets: DataFrame, ip: str = "ip", net: str = "net") -> DataFrame:
    """rows with the column trusted: whether the address lies in any of the table's networks (a.b.c.d/p or IPv6/p; without /p an
    address of its own). A range join as a join by equality: an address has one prefix of each length that the networks have
    (129 at most), and each meets its own networks only. Networks that are none match nothing; IPv4 addresses lie in no IPv6 net."""
    base, given = F.substring_index(F.btrim(net), "/", 1), F.regexp_extract(F.btrim(net), r"/([0-9]{1,3})$", 1)
    six = ~base.rlike(r"^[0-9.]+$")
    length = F.when(F.contains(F.btrim(net), F.lit("/")), given.try_cast("int")).otherwise(F.when(six, 128).otherwise(32))
    bits = F.when(six, length).otherwise(length + 96)
    known = nets.select(prefix_bits(base).alias("_b"), bits.alias("_n"), six.alias("_six"), (length <= F.when(six, 128).otherwise(32)).alias("_ok")).where("_ok and _b is not null")
    known = known.select("_n", F.substring("_b", F.lit(1), F.col("_n")).alias("_prefix"), "_six").distinct()
    lengths = sorted(r._n for r in known.select("_n").distinct().collect())  # 129 rows at most
    own = rows.select(F.col(ip).alias("_ip"), prefix_bits(F.col(ip)).alias("_bits")).where("_bits is not null").distinct()
    each = own.select("_ip", F.explode(F.array(*[F.struct(F.lit(n).alias("_n"), F.substring("_bits", F.lit(1), F.lit(n)).alias("_prefix")) for n in lengths])).alias("x")).select("_ip", "x.*") if lengths else own.select("_ip", F.lit(0).alias("_n"), F.lit("").alias("_prefix")).limit(0)
    hits = each.join(known, ["_n", "_prefix"]).where(~F.col("_six") | F.contains("_ip", F.lit(":"))).select("_ip").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hits, F.col(ip) == F.col("_ip"), "left").withColumn("trusted", F.coalesce("_hit", F.lit(False))).drop("_ip", "_hit")


def validate_host(host: Column) -> Column:
    """The host, with its port if any, or null: ASCII only; no blanks, control characters or , @ / ? \\ #; IPv6 in brackets."""
    port = F.regexp_extract(host, r":([0-9]+)$", 1)
    port_ok = F.when(host.rlike(r"[^:\]]*:[0-9]+$"), F.coalesce(port.try_cast("bigint").between(1, 65535), F.lit(False))).otherwise(True)
    clean = host.rlike(r"^[!-~]+$") & ~host.rlike(r"[,@/?\\#]")
    inner = F.regexp_extract(host, r"^\[([^\]]*)\](?::[0-9]+)?$", 1)
    six = F.contains(inner, F.lit(":")) & ip_hex(inner).isNotNull()
    named = host.rlike(r"^[^:\[\]]+(?::[0-9]+)?$")
    ok = F.when(F.startswith(host, F.lit("[")), six & F.when(F.endswith(host, F.lit("]")), True).otherwise(port_ok)).otherwise(named & port_ok)
    return F.when(clean & ok, host)


def base_url(trusted: Column, forwarded: Column, x_host: Column, x_proto: Column, host: Column, scheme: Column) -> Column:
    """struct(base_url, source): Forwarded's right-most element, X-Forwarded-*, Host, or the default."""
    last = F.element_at(F.filter(F.split(forwarded, ","), lambda e: F.btrim(e) != ""), -1)
    part = lambda k: F.nullif(F.regexp_extract(last, rf'(?i)(?:^|;)\s*{k}="?([^";]+)"?', 1), F.lit(""))
    valid = lambda h: validate_host(h).isNotNull()
    proto = lambda p: F.when(F.lower(F.btrim(p)).isin("http", "https"), F.lower(F.btrim(p)))
    join = lambda p, h, s: F.named_struct(F.lit("base_url"), F.concat(p, F.lit("://"), h), F.lit("source"), F.lit(s))
    return (
        F.when(trusted & valid(part("host")) & proto(part("proto")).isNotNull(), join(proto(part("proto")), part("host"), "forwarded"))
        .when(trusted & valid(x_host) & proto(x_proto).isNotNull(), join(proto(x_proto), x_host, "x_forwarded"))
        .when(valid(host), join(F.coalesce(scheme, F.lit("http")), host, "host"))
        .otherwise(join(F.lit("http"), F.lit("localhost"), "default"))
    )


def capped_paths(hits: DataFrame, cap: int, path: str = "path", first: str = "first_seen") -> DataFrame:
    """hits (path, n, first_seen), one row a path: the first `cap` paths stay, the others are one row __overflow__.
    The cap keeps a bounded list; its members are found by an ordered limit, not by one window over all rows."""
    kept = hits.orderBy(first, path).limit(cap).select(F.col(path).alias("_p"), F.lit(True).alias("_in"))
    named = hits.join(kept, F.col(path) == F.col("_p"), "left")
    return named.groupBy(F.when(F.col("_in"), F.col(path)).otherwise("__overflow__").alias(path)).agg(F.sum("n").alias("n"))

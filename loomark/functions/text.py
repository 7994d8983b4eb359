"""Text, URL and hash functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, as a class for regular expressions.
SPACES = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# fixed values
DANGEROUS_SCHEMES = ("javascript", "data", "vbscript", "file", "about")


def normalize_text(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.btrim(F.regexp_replace(c, f"{SPACES}+", " "))


def longest_backtick_run(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))


def code_fence(c: Column) -> Column:
    """Three backticks, or one more than the longest run in the code (three at least) if it has any."""
    n = longest_backtick_run(c)
    return F.repeat(F.lit("`"), F.when(n == 0, 3).otherwise(F.greatest(n, F.lit(3)) + 1))


def escape_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([\[\]\\])", r"\\$1"), r"[\r\n]", " ")


def escape_destination(c: Column) -> Column:
    inner = F.replace(F.replace(c, F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))
    return F.when(c.rlike(r"[ ()<>]"), F.concat(F.lit("<"), inner, F.lit(">"))).otherwise(c)


def yaml_escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_dangerous_url(c: Column) -> Column:
    t = F.btrim(c, F.lit(" \t\n\x0b\f\r"))
    return t.rlike(r"\p{Cc}") | t.rlike("(?i)%(0[0-9a-f]|1[0-9a-f]|7f)") | t.rlike(f"(?i)^({'|'.join(DANGEROUS_SCHEMES)}):")


def sanitize_url(c: Column) -> Column:
    return F.when(~is_dangerous_url(c), c)


def origin(base: Column) -> Column:
    return F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def resolve_url(url: Column, base: Column) -> Column:
    """Absolute and protocol-relative urls stay; /x goes to the origin, others to the base's directory."""
    path = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(path.rlike("^[^:]+://[^/]+$"), F.concat(path, F.lit("/"))).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(base.isNull() | url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | url.startswith("//"), url)
        .when(url.startswith("/"), F.concat(origin(base), url))
        .otherwise(F.concat(folder, url))
    )


def chars_per_token(ratio: Column) -> Column:
    return F.when(ratio <= 0, F.lit(4.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(100.0), ratio)))


def estimate_tokens(text: Column, ratio: float = 4.0) -> Column:
    """Characters by ratio, rounded up, in single precision."""
    return F.ceil((F.char_length(text).cast("float") / F.lit(ratio).cast("float")).cast("float")).cast("long")


def token_savings(html: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, F.greatest(F.lit(0), (F.floor(F.octet_length(html) / 4)).cast("long") - tokens)).otherwise(F.lit(0)).cast("long")


def parser_working_set(html: Column) -> Column:
    tags = F.length(html) - F.length(F.replace(html, F.lit("<"), F.lit("")))
    return (F.octet_length(html).cast("long") * 7 + tags * 512 + 1024).cast("long")


def normalize_label(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.translate(c, "- ", "__")), "[^a-z0-9_]+", "")
    return F.btrim(F.regexp_replace(s, "__+", "_"), F.lit("_"))


#: Bytes of a page in which a charset is looked for.
SNIFFED = 1024


def detect_charset(content_type: Column, html: Column) -> Column:
    """Content-Type's charset, else that of a meta tag in the first 1024 bytes, <meta charset> before the http-equiv form, else
    UTF-8; upper case."""
    # bytes as Latin-1 characters: markup and labels are ASCII
    head = F.decode(F.substring(F.encode(html, "UTF-8"), 1, SNIFFED), "ISO-8859-1")
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.upper(F.coalesce(
        found(content_type, r'(?i)charset\s*=\s*"?([^";,\s]+)"?'),
        found(head, r"(?i)<meta\s+charset\s*=\s*[\"']?([^\"'>;\s/]+)"),
        found(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([^\"'>;\s/]+)"),
        F.lit("UTF-8"),
    ))


def format_bytes(c: Column) -> Column:
    one = lambda d, unit: F.concat(F.replace(F.format_number(c / d, 1), F.lit(","), F.lit("")), F.lit(unit))
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1048576, one(1024.0, " KB")).otherwise(one(1048576.0, " MB"))

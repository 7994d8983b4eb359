"""Personal data in whole texts: spans by regular expression, confirmed by checksums, scored by context words.

DataFrame functions only. For each kind the matches and the gaps between them come from the same pattern
(regexp_extract_all and split), so that positions are running sums of their lengths in code points.

The patterns are written with possessive quantifiers and boundaries that leave their matches as they are but
need one pass and no recursion over long runs. Kinds and validators: email; ip (parts at most 255); card (12 to 19
digits, Luhn); phone (9 to 15 digits); iban (ISO 13616: the country's length, mod-97 equal to 1; what follows it in the match is
not part of the span); secret (an assigned key, password or token of 16 characters or more, or one of a known form). Matches
that fail are dropped.

Positions are running sums in pieces of PIECE matches, so that the work is linear in the text and its matches.

A span's score starts at its kind's base and rises where a context word of its kind stands within CONTEXT code
points before or after it. Scores never drop spans here; callers choose a threshold.

Defined cases: a null text is empty; empty texts and tables give no spans; null ids and repeated rows are kept row by
row; other columns are untouched, but one named _spans gives way to the new one. Two kinds may overlap; within a kind matches are leftmost and don't overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.llm.common import aside, spread, table

CONTEXT = 40
#: Kind -> pattern, in the order of equal starts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?:(?i:api[_-]?key|secret|token|passw(?:or)?d)\x20?[:=]\x20?[\"']?[A-Za-z0-9_/+.=-]{16,}+|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,16}PRIVATE KEY-----)",
}
BASE = ("email", "ip", "card", "phone")
#: A character that every match of the kind holds: texts without it are not searched.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
SCORES = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "secret": 0.7}
WORDS = {
    "email": "e-?mail|contact|mail|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|mobile|call|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "secret": "secret|private|credentials?|auth|login|password",
}
#: ISO 13616 lengths by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
PIECE = 256
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?+"


def _mod97(m: Column) -> Column:
    """Whether the first four characters, moved to the end, and letters as 10 to 35, leave 1 modulo 97."""
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    digits = F.transform(F.split(turned, "(?<=.)(?=.)"), lambda c: F.ascii(c))
    value = lambda a: F.when(a < 58, a - 48).otherwise(a - 55)
    rest = F.aggregate(digits, F.lit(0), lambda acc, a: (acc * F.when(a < 58, 10).otherwise(100) + value(a)) % 97)
    return F.char_length(s).between(15, 34) & (rest == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.when(F.char_length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


def _iban(m: Column) -> Column:
    """The beginning of the match that has its country's length, if a blank or nothing follows; null for none."""
    length = F.coalesce(*[F.when(F.left(m, F.lit(2)).isin(names.split()), n) for n, names in IBAN_LENGTHS.items()])
    pattern = F.concat(F.lit("^(?:[A-Z0-9] ?){"), (length - 1).cast("string"), F.lit("}[A-Z0-9](?= |$)"))
    own = F.call_function("regexp_extract", m, pattern, F.lit(0))
    return F.when(own != "", own)


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def spans_of(text: Column, kind: str) -> Column:
    """Array of struct(start, rank, end, kind, score): the confirmed matches in order; end is exclusive."""
    rank = list(PATTERNS).index(kind)
    none = F.array().cast(f"array<{SPAN}>")
    pattern = PATTERNS[kind]

    def step(acc: Column, x: Column) -> Column:
        """x: a match, the gap before it and the gap after it."""
        begin = acc["at"] + F.char_length(x["g"])
        own = _iban(x["m"]) if kind == "iban" else x["m"]
        near = F.concat_ws(" ", F.right(x["g"], F.lit(CONTEXT)), F.left(x["n"], F.lit(CONTEXT)))
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(F.lower(near).rlike(rf"\b(?:{WORDS[kind]})\b"), 0.2).otherwise(0.0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + F.char_length(own)).alias("end"), F.lit(kind).alias("kind"), score.alias("score"))
        ok = F.coalesce(own.isNotNull() & _valid(kind, own), F.lit(False))
        return F.struct((begin + F.char_length(x["m"])).alias("at"), F.when(ok, F.concat(acc["out"], F.array(span.cast(SPAN)))).otherwise(acc["out"]).alias("out"))

    def place(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), part["out"].alias("out")))).alias("out"))

    def moved(part: Column) -> Column:
        put = lambda s: F.struct((s["start"] + part["at"]).alias("start"), s["rank"].alias("rank"), (s["end"] + part["at"]).alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))
        return F.transform(part["out"], put)

    def found(rows: Column) -> Column:
        """rows: structs of a match and the gaps around it, in order."""
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / PIECE).cast("int")), lambda k: F.aggregate(F.slice(rows, k * PIECE + 1, F.lit(PIECE)), zero, step))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,out:array<{SPAN}>>>").alias("out"))
        return F.flatten(F.transform(F.aggregate(pieces, first, place)["out"], moved))

    def zipped(m: Column) -> Column:
        return _let(F.split(text, pattern, -1), lambda g: found(F.arrays_zip(m.alias("m"), F.slice(g, F.lit(1), F.size(m)).alias("g"), F.slice(g, F.lit(2), F.size(m)).alias("n"))))

    matched = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, zipped(m)).otherwise(none))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), matched).otherwise(none) if kind in NEEDS else matched


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs with the column _spans: array of struct(start, rank, end, kind, score), by start, then kind."""
    docs, back = aside(docs, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return back(docs.withColumn("_spans", F.array_sort(F.concat(*[spans_of(text, k) for k in kinds]))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
        F.array_join(F.transform("_spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )

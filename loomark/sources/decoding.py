"""Bodies as bytes: bounded decompression with its error classes, and strict decoding of charsets."""

from __future__ import annotations

import codecs
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
CODES = {"ok": 0, "budget_exceeded": 101, "format": 102, "truncated": 103, "io": 104}


def content_encoding(header: Column) -> Column:
    """gzip, deflate, br or identity; null for any other Content-Encoding."""
    name = F.lower(F.btrim(header))
    return F.when(header.isNull() | name.isin("", "identity"), "identity").when(name.isin("gzip", "x-gzip"), "gzip").when(name.isin("deflate", "br"), name)


def inflate(data: bytes, encoding: str | None, budget: int) -> tuple[str, bytes | None]:
    """(status, body). gzip may have several members, which share the budget; deflate is raw; empty input is truncated."""
    if encoding not in ("gzip", "deflate"):
        return ("ok", data) if encoding == "identity" else ("unsupported", None)
    out: list[bytes] = []
    while True:
        d = zlib.decompressobj(31 if encoding == "gzip" else -15)
        try:
            part = d.decompress(data, budget + 1)
        except zlib.error:
            return "format", None
        if len(part) > budget:
            return "budget_exceeded", None
        if not d.eof:
            return "truncated", None
        out.append(part)
        budget -= len(part)
        data = d.unused_data
        if encoding == "deflate" or not data:
            return "ok", b"".join(out)


def decompress_bounded(content: Column, encoding: Column, budget: int) -> Column:
    """struct(status, code, body); no body beyond `budget` bytes is ever built. Null content is null."""

    @F.pandas_udf("struct<status:string,code:int,body:binary>")
    def run(c: pd.Series, e: pd.Series) -> pd.DataFrame:
        got = [(None, None) if x is None else inflate(bytes(x), y, budget) for x, y in zip(c, e)]
        return pd.DataFrame({"status": [s for s, _ in got], "code": pd.array([CODES.get(s) for s, _ in got], "Int32"), "body": [b for _, b in got]})

    return run(content, encoding)


# fixed values: encodings by the codec that decodes them, with their labels
LABELS = {
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "utf-16-le": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
    "utf-16-be": "unicodefffe utf-16be",
    "cp866": "866 cp866 csibm866 ibm866",
    "koi8-r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8-u": "koi8-ru koi8-u",
    "mac-roman": "csmacintosh mac macintosh x-mac-roman",
    "mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "cp874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "cp1252": "ansi_x3.4-1968 ascii cp819 ibm819 iso-ir-100 us-ascii",
    "gb18030": "chinese csgb2312 csiso58gb231280 gb18030 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "big5hkscs": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "euc-jp": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "iso2022-jp": "csiso2022jp iso-2022-jp",
    "cp932": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "cp949": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "iso-8859-8": "csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso-8859-8-i csiso88598i logical visual iso-ir-138",
}
#: Of ISO 8859's parts: the year of the long label, and short labels.
PARTS = {1: "1987 latin1 l1 csisolatin1", 2: "1987 latin2 l2 csisolatin2 iso-ir-101", 3: "1988 latin3 l3 csisolatin3 iso-ir-109", 4: "1988 latin4 l4 csisolatin4 iso-ir-110", 5: "1988 csisolatincyrillic cyrillic iso-ir-144",
    6: "1987 arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127", 7: "1987 csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 sun_eu_greek", 8: "1988", 9: "1989 latin5 l5 csisolatin5 iso-ir-148",
    10: "- csisolatin6 iso-ir-157 l6 latin6", 13: "-", 14: "-", 15: "- csisolatin9 l9", 16: "-"}


@lru_cache
def codec_labels() -> dict[str, str]:
    """Codec by label. Parts 1 and 9 of ISO 8859 stand for the Windows code pages that contain them."""
    out = {label: codec for codec, labels in LABELS.items() for label in labels.split()}
    for n, more in PARTS.items():
        year, *short = more.split()
        codec = {1: "cp1252", 9: "cp1254"}.get(n, f"iso8859-{n}")
        out |= dict.fromkeys([f"iso-8859-{n}", f"iso8859-{n}", f"iso8859{n}", f"iso_8859-{n}", *short, *([f"iso_8859-{n}:{year}"] if year != "-" else [])], codec)
    for n in range(1250, 1259):
        out |= dict.fromkeys([f"windows-{n}", f"cp{n}", f"x-cp{n}"], f"cp{n}")
    return out


@lru_cache
def single_byte(codec: str) -> str | None:
    """The characters of a single-byte code page: bytes 80 to 9F that it leaves open are control characters, others U+FFFE,
    which a character map takes for none."""
    if not codec.startswith(("cp125", "cp874", "iso8859", "iso-8859")):
        return None
    one = lambda b: bytes([b]).decode(codec, "ignore") or (chr(b) if b < 0xA0 else "\ufffe")
    return "".join(map(one, range(256)))


def decode_bytes(data: bytes, label: str) -> str | None:
    """Strict; null for unknown labels and for bytes that the encoding lacks. A byte order mark is a character."""
    codec = codec_labels().get(label.strip(" \t\n\f\r").lower())
    if codec is None:
        return None
    table = single_byte(codec)
    try:
        return data.decode(codec, "strict") if table is None else codecs.charmap_decode(data, "strict", table)[0]
    except UnicodeDecodeError:
        return None


def decode_text(content: Column, charset: Column) -> Column:
    """Text of bytes in a charset, UTF-8 where none is given; null for bytes that are not of it and for unknown names. Only labels
    of the table name an encoding; UTF-8 is decoded natively."""

    @F.pandas_udf("string")
    def other(c: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else decode_bytes(bytes(x), y) for x, y in zip(c, e)], dtype=object)

    utf8 = charset.isNull() | F.lower(charset).isin("utf-8", "utf8")
    native = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.when(utf8, native).otherwise(other(F.when(~utf8, content), charset))

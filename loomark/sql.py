"""SQL names of the functions: register(spark) makes them known to a session.

Native expressions become SQL functions, which the engine inlines; what needs Python becomes an Arrow function or a table function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomark.functions import blake3, markdown, structure, text
from loomark.operators import checks, decisions
from loomark.sources import decoding

#: Name -> types of its arguments, and the expression over them.
NATIVE: dict[str, tuple[str, Callable[..., Column]]] = {
    "detect_charset": ("content_type string, html string", text.detect_charset),
    "sanitize_url": ("url string", text.sanitize_url),
    "resolve_url": ("url string, base string", text.resolve_url),
    "estimate_tokens": ("body string", lambda body: text.estimate_tokens(body)),
    "normalize_text": ("body string", text.normalize_text),
    "negotiate_accept": ("accept string", lambda accept: decisions.negotiate_accept(accept)),
    "decide_eligibility": ("enabled boolean, method string, status int, range_header string, content_type string, content_length bigint, size_limit bigint", decisions.eligibility),
    "decide_conditional": ("mode string, has_range boolean, no_transform boolean, if_none_match string, etag string, if_modified_since bigint, last_modified bigint", checks.decide_conditional),
    "decide_base_url": ("trusted boolean, forwarded string, x_host string, x_proto string, host string, scheme string", decisions.base_url),
}


def expression_sql(spark: SparkSession, arguments: str, build: Callable[..., Column]) -> str:
    """The expression as SQL text over its arguments' names."""
    names = [a.split()[0] for a in arguments.split(", ")]
    one = spark.createDataFrame([], arguments).select(build(*map(F.col, names)).alias("out"))
    plan = one._jdf.queryExecution().analyzed()
    return _lambdas(plan.projectList().head().child().sql())


LAMBDA, VARIABLE = "lambdafunction(", "namedlambdavariable()"


def _lambdas(sql: str) -> str:
    """The engine writes lambdas of one variable as lambdafunction(body, variable); as SQL they are v -> body. Inner ones go first;
    their bodies must not use outer variables."""
    n = 0
    while (at := sql.rfind(LAMBDA)) >= 0:
        depth, end = 1, at + len(LAMBDA)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        body, _, last = sql[at + len(LAMBDA) : end - 1].rpartition(", ")
        if last != VARIABLE or body.endswith(VARIABLE):
            raise ValueError("a lambda of several variables")
        n += 1
        sql = f"{sql[:at]}(v{n} -> {body.replace(VARIABLE, f'v{n}')}){sql[end:]}"
    return sql


def tables() -> dict[str, type]:
    """Table functions: events, links, tables and meta tags of a page, entries of an Accept header."""
    from loomark.functions.html5 import parse

    class Events:
        def eval(self, html: str) -> Iterator[tuple]:
            from loomark.functions.html5 import tokens

            for pos, (kind, name, attrs) in enumerate(tokens(html or "")):
                yield pos, kind, name, dict(attrs) if attrs else None

    class Links:
        def eval(self, html: str, base: str) -> Iterator[tuple]:
            pos = 0
            for a in markdown.find(parse(html or ""), "a"):
                label = markdown.squeeze(markdown.plain(a))
                if label and "href" in a.attrs and not markdown.dangerous(a.attrs["href"]):
                    pos += 1
                    yield pos, label, markdown.resolve(a.attrs["href"], base)

    class Meta:
        def eval(self, html: str) -> Iterator[tuple]:
            for pos, m in enumerate(markdown.find(parse(html or ""), "meta")):
                yield pos, m.attrs.get("property") or m.attrs.get("name"), m.attrs.get("content")

    class Cells:
        def eval(self, html: str) -> Iterator[tuple]:
            for t, table in enumerate(markdown.find(parse(html or ""), "table")):
                for r, row in enumerate(markdown.find(table, "tr")):
                    for c, cell in enumerate(x for x in row.children if not isinstance(x, str) and x.tag in ("td", "th")):
                        yield t, r, c, markdown.squeeze(markdown.plain(cell))

    class Accept:
        def eval(self, header: str) -> Iterator[tuple]:
            for pos, entry in enumerate((header or "").split(",")):
                mime, *rest = (x.strip() for x in entry.split(";"))
                q = next((x[2:] for x in rest if x[:2] in ("q=", "Q=")), None)
                yield pos, mime.lower(), q

    return {
        "html_events": F.udtf(Events, returnType="pos int, kind string, name string, attrs map<string,string>"),
        "html_links": F.udtf(Links, returnType="pos int, label string, url string"),
        "html_meta": F.udtf(Meta, returnType="pos int, name string, content string"),
        "html_tables": F.udtf(Cells, returnType="tab int, r int, c int, cell string"),
        "accept_entries": F.udtf(Accept, returnType="pos int, mime string, q string"),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes all names known to the session; returns them."""
    for name, (arguments, build) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURN {expression_sql(spark, arguments, build)}")
    @F.pandas_udf("string")
    def to_markdown(html: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([markdown.convert(x, y) for x, y in zip(html, base)], dtype=object)

    @F.pandas_udf(markdown.META)
    def to_metadata(html: pd.Series, base: pd.Series) -> pd.DataFrame:
        keys = ["title", "description", "url", "image", "author", "published"]
        return pd.DataFrame([markdown.metadata(markdown.parse(x or ""), y) for x, y in zip(html, base)], columns=keys)

    @F.pandas_udf("string")
    def to_normal(body: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else markdown.normalise(x) for x in body], dtype=object)

    @F.pandas_udf("string")
    def to_etag(body: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f'"{d.hex()[:32]}"' for x, d in zip(body, blake3.digests([(x or "").encode() for x in body]))], dtype=object)

    @F.pandas_udf("struct<status:string,code:int,body:binary>")
    def to_bytes(content: pd.Series, encoding: pd.Series, budget: pd.Series) -> pd.DataFrame:
        got = [(None, None) if x is None else decoding.inflate(bytes(x), y, int(n)) for x, y, n in zip(content, encoding, budget)]
        return pd.DataFrame({"status": [s for s, _ in got], "code": pd.array([decoding.CODES.get(s) for s, _ in got], "Int32"), "body": [b for _, b in got]})

    arrow = {"html_to_markdown": to_markdown, "html_metadata": to_metadata, "normalize_markdown": to_normal, "markdown_etag": to_etag, "decompress_bounded": to_bytes}
    for name, f in arrow.items():
        spark.udf.register(name, f)
    found = tables()
    for name, t in found.items():
        spark.udtf.register(name, t)
    return [*NATIVE, *arrow, *found]

"""Table functions of pages: a row per event, table cell or meta tag. Each is an array column for explode()."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomark.functions.html5 import Node, parse, tokens
from loomark.functions.markdown import WS, find, plain, squeeze

EVENTS = "array<struct<pos:int,kind:string,name:string,text:string,attrs:map<string,string>>>"
CELLS = "array<struct<tab:int,row:int,col:int,header:boolean,text:string>>"
METAS = "array<struct<pos:int,kind:string,name:string,content:string>>"


def _each(one, schema: str):
    def column(html: Column) -> Column:
        @F.pandas_udf(schema)
        def run(pages: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else one(x) for x in pages], dtype=object)

        return run(html)

    return column


def _events(html: str) -> list[dict]:
    return [
        dict(pos=i, kind=kind, name=data if kind in ("start", "end") else None, text=None if kind in ("start", "end") else data, attrs=attrs)
        for i, (kind, data, attrs) in enumerate(tokens(html))
    ]


def rows_of(table: Node):
    for x in table.children:
        if isinstance(x, Node):
            if x.tag == "tr":
                yield x
            elif x.tag in ("thead", "tbody", "tfoot"):
                yield from rows_of(x)


def _cells(html: str) -> list[dict]:
    out = []
    for t, table in enumerate(find(parse(html), "table")):
        for r, row in enumerate(rows_of(table)):
            cells = [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
            out += [dict(tab=t, row=r, col=i, header=c.tag == "th", text=squeeze(plain(c))) for i, c in enumerate(cells)]
    return out


def _metas(html: str) -> list[dict]:
    tree, out = parse(html), []
    for x in find(tree, "title"):
        out.append(("title", None, plain(x, frozenset()).strip(WS)))
    for x in find(tree, "meta"):
        kind = next((k for k in ("property", "name", "http-equiv", "charset") if k in x.attrs), None)
        if kind:
            out.append((kind, None if kind == "charset" else x.attrs[kind], x.attrs.get("charset" if kind == "charset" else "content")))
    for x in find(tree, "link"):
        out.append(("link", x.attrs.get("rel"), x.attrs.get("href")))
    return [dict(pos=i, kind=k, name=n, content=c) for i, (k, n, c) in enumerate(out)]


#: The tokenizer's events: text, start, end, comment, doctype.
html_events = _each(_events, EVENTS)
#: Cells of all tables, nested ones too, with their text.
html_tables = _each(_cells, CELLS)
#: Titles, meta tags and links, in this order, each in the page's order.
html_meta = _each(_metas, METAS)

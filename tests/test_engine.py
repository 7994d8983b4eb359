"""Every query against its SQL, and the converter's rules one by one."""

from __future__ import annotations

import glob
import hashlib
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomark.functions.markdown import Options, convert, normalise
from loomark.functions.blake3 import digests
from loomark.plans import checks, conversion, markup, metrics, policies, reports, requests, streams
from loomark.sources.decoding import inflate
from loomark.streaming.chunks import convert_chunks, slice_bytes

SF = "/root/testdata/sf0.001"
PLANS = [(n, q, p.ORACLE_SQL[n]) for p in (conversion, markup, requests, checks, metrics, policies, reports, streams) for n, q in p.QUERIES.items() if n in p.ORACLE_SQL]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name,query,sql", PLANS, ids=[p[0] for p in PLANS])
def test_query_equals_sql(spark, db, name, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    r = db.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    round_ = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted(repr([round_(row[c]) for c in cols]) for row in df.collect())
    want = sorted(repr([round_(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    assert got == want


def test_whole_texts_and_tables(spark, tmp_path):
    texts = ["x" * 40 + " One", "x" * 40 + " two", "A-b  c_"]
    spark.createDataFrame(list(enumerate(texts, 7)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "u", "h") for i in (4, 7, 8, 9)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    labels = ["x" * 40 + "_one", "x" * 40 + "_two", "a_b_c"]
    got = {r.doc_id: r.label_sha256 for r in requests.QUERIES["text_functions"](spark, str(tmp_path)).collect()}
    assert got == {i: sha(t) for i, t in enumerate(labels, 7)}
    got = {r.scenario: r.problem for r in reports.QUERIES["evidence_coverage"](spark, str(tmp_path)).collect()}
    assert got == {4: "unknown", 8: "duplicate", 9: "missing"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(
    "html,md",
    [
        ("<p>a  b<p>c", "a b\n\nc\n"),
        ("<h2>x <i>y</i></h2>z", "## x *y*\n\nz\n"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n\n  - c\n"),
        ("<ol><li>a</li><li>b</li></ol>", "1. a\n1. b\n"),
        ("<p><b>x<p>y", "**x**\n\n**y**\n"),
        ("<p>a<template><p>in<table></template>b", "ab\n"),
        ("<table><b>x</b><tr><td>1</td></tr>y</table>z", "**x**y1z\n"),
        ("<div>" * 990 + "x", "x\n"),
        ("<p>a</p> b", "a\n\n b\n"),
        ("a<pre><code class='x language-c++'>i  \n\n\nj</code></pre>b", "a\n\n```c++\ni  \n\n\nj\n```\n\nb\n"),
        ("<ul><li><ul><li>a</ul></ul>", "-\n  - a\n"),
        ("<ol><li>a<p>b</p>c</ol>", "1. a\n\n   b\n\n   c\n"),
        ("<a href=''>t</a><a href='data:x'>[u]</a>", "[t]()\\[u\\]\n"),
        ("<img alt=' a[ ' src='data:x'>", "a\\[\n"),
        ("<video src=' v.mp4 ' title=' ' poster='p'></video>", "[http://h/v.mp4](http://h/v.mp4)\n![](http://h/p)\n"),
        ("<audio poster='p'></audio>x", "x\n"),
        ("<input aria-label='' placeholder='p'>x", "x\n"),
        ("<code>a  b</code>  c  `d  e", "`a  b` c `d e\n"),
        ('<a href="/q">t [x]</a>', "[t \\[x\\]](http://h/q)\n"),
        ('<a href="javascript:x">t</a>', "t\n"),
        ("<nav>n</nav><main>m</main>", "m\n"),
        ('<pre><code class="language-py">a\n  b</code></pre>', "```py\na\n  b\n```\n"),
        ("<code>a`b</code>", "``a`b``\n"),
        ('<img src="i.png" alt=" a " title="t">', '![ a ](http://h/i.png "t")\n'),
        ("<blockquote>q</blockquote>", "q\n"),
        ("<script>x</script>", "\n"),
        ("", ""),
        ("<p>a<br>b</p>", "ab\n"),
        ("<p>&amp;&copy", "&©\n"),
    ],
)
def test_convert(html, md):
    assert convert(html, "http://h/") == md


def test_gfm_table():
    html = "<table><tr><th align=right>a<th>b<tr><td>1<td>x|y<tr><td>2</table>"
    assert convert(html, None, Options(gfm=True)) == "| a | b |\n| ---: | --- |\n| 1 | x\\|y |\n| 2 | |\n"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/pbauli hdiv1=\"'&;\n`", max_size=80))
def test_convert_is_total_and_normal(html):
    md = convert(html, "http://h/")
    assert md == convert(html, "http://h/")
    assert normalise(md) == md if html else md == ""


def test_blake3_known_values():
    got = [x.hex() for x in digests([b"", b"abc"])]
    assert got == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"]


def test_blake3_batches_agree_with_single_inputs():
    inputs = [bytes(i % 251 for i in range(n)) for n in (0, 1, 64, 65, 1023, 1024, 1025, 2048, 3072, 3073, 5121, 8192, 31744)]
    assert digests(inputs) == [digests([x])[0] for x in inputs]
    assert len(set(digests(inputs))) == len(inputs)


def test_inflate():
    assert inflate(b"", "gzip", 9) == ("truncated", None)
    assert inflate(b"x", "br", 9) == ("unsupported", None)
    assert inflate(b"x", "identity", 9) == ("ok", b"x")


def test_charset_labels():
    from loomark.sources.decoding import codec_labels, decode_bytes

    for label, codec in codec_labels().items():
        assert "a".encode(codec) and decode_bytes("a".encode(codec), label.upper()) == "a", label
    assert decode_bytes(b"\x80\x81", "latin1") == "€\x81" and decode_bytes(b"\xd0", "iso-8859-9") == "Ğ"
    assert decode_bytes(b"\xaa", "windows-1253") is None and decode_bytes(b"\xff", "windows-874") is None
    assert decode_bytes("日本".encode("cp932"), "shift_jis") == "日本" and decode_bytes(b"\x81", "sjis") is None
    for name in ("rot13", "zlib", "hex", "base64", "bz2", "idna", "punycode", "unicode_escape", "", "utf-7"):
        assert decode_bytes(b"abc", name) is None


def test_chunks_as_a_stream(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 6")
    chunks = slice_bytes(pages, 700)
    # later chunks first: a page's state waits for the others
    chunks.where("seq % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    chunks.where("seq % 2 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = convert_chunks(stream).writeStream.format("memory").queryName("chunked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.page_id: r.markdown for r in spark.table("chunked").collect()}
    assert got == {r.page_id: r.markdown for r in convert_chunks(chunks).collect()}
    assert len(got) == pages.count()


def test_files(spark, tmp_path):
    from loomark.operators import reports as R
    from loomark.sources import files

    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "d" / "a.html").write_text("<p>a")
    (tmp_path / "c" / "d" / "a.meta.json").write_text('{"fixture-id": "a", "page-type": "docs", "failure-corpus": true}')
    (tmp_path / "c" / "alone.html").write_text("<p>b")
    (row,) = files.corpus(spark, str(tmp_path / "c")).collect()
    assert (row["fixture-id"], row["failure-corpus"], bytes(row.content)) == ("a", True, b"<p>a")
    (tmp_path / "conf").write_text("# c\n\n a = 1=2 \nbad line\nb=\n")
    assert sorted((r.key or "", r.value, r.error) for r in files.settings(spark, str(tmp_path / "conf")).collect()) == [("", None, "no setting: bad line"), ("a", "1=2", None), ("b", "", None)]
    (tmp_path / "r.json").write_text('{"schema-version": "1",\n "fixtures": [{"fixture-id": "x", "conversion-result": "converted", "input-bytes": 10, "output-bytes": 5, "latency-ms": 2.0}]}')
    rows = files.fixtures(files.reports(spark, str(tmp_path / "r.json")))
    s = R.summary(rows).first()
    assert (s.converted, s.token_reduction, s.p95) == (1, 50.0, 2.0)
    assert R.summary(rows.limit(0)).first().asDict()["fixtures"] == 0
    files.write_report(R.summary(rows), str(tmp_path / "out"))
    assert "fallback-rate" in spark.read.json(str(tmp_path / "out")).columns
    files.write_markdown(spark.createDataFrame([("HEAD", "x"), ("GET", "y")], "method string, markdown string"), str(tmp_path / "md"), "method")
    assert {(r.method, r.markdown) for r in spark.read.parquet(str(tmp_path / "md")).collect()} == {("HEAD", None), ("GET", "y")}


@pytest.mark.parametrize("total,caps", [(0, (262144, 65536, 65536, 1024)), (4 << 20, (524288, 131072, 131072, 1024)), (10, (7, 2, 1, 0))])
def test_split_budget(total, caps):
    from loomark.operators.reports import split_budget

    out = split_budget(total)
    assert tuple(out[k] for k in ("output", "stack", "lookahead", "sniff")) == caps


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4 << 20))
def test_small_budgets_are_dealt_whole(total):
    from loomark.operators.reports import split_budget

    assert 0 == total or total >= 2 << 20 or sum(split_budget(total).values()) == total


def test_addresses(spark):
    import ipaddress

    from pyspark.sql import functions as F

    from loomark.operators.decisions import cidr_contains, ip_hex

    ips = ["::", "1::", "::1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "a:b::c:d", "256.1.1.1", "1.2.3", "", ":::", "1:::2", "g::1", "12345::", "0.0.0.0", "::ffff:0:0", None, "01.2.3.4", "1:2:3:4:5:6:7::", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:"]

    def want(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return None
        return (b"\0" * 10 + b"\xff\xff" + a.packed if a.version == 4 else a.packed).hex()

    rows = spark.createDataFrame([(x,) for x in ips], "ip string")
    got = rows.select("ip", ip_hex(F.col("ip")).alias("h"), cidr_contains(F.col("ip"), "0.0.0.0/0").alias("c")).collect()
    assert [(r.ip, r.h) for r in got] == [(x, want(x)) for x in ips]
    assert {r.ip for r in got if r.c} == {"0.0.0.0", "::ffff:0:0"}
    with pytest.raises(ValueError):
        cidr_contains(F.col("ip"), "10.0.0.0/33")


@pytest.mark.parametrize(
    "html,md",
    [
        ("<table><tr><th align=LEFT>a<th style='x:y; Text-Align : center'>b<tr><td>1|2<tr></table>", "| a | b |\n| --- | :---: |\n| 1\\|2 | |\n| | |\n"),
        ("<table><colgroup><col span=2 align=right><col></colgroup><thead><tr><td>a<td>b<td>c</thead><tbody><tr><td>1<br>2<td>p</table>x", "| a | b | c |\n| ---: | ---: | --- |\n| 12 | p | |\n\nx\n"),
        ("<table><tr></table>x", "x\n"),
        ("<table><tr><td><p>a</p><p>b</p></table>", "| a<br><br>b |\n| --- |\n"),
    ],
)
def test_tables(html, md):
    assert convert(html, None, Options(gfm=True)) == md


def test_large_texts_lose_blank_lines_in_code():
    html = "<pre>a  \n\n\nb</pre>" + "<p>word</p>" * 50_000
    assert convert(html).startswith("```\na\n\nb\n```\n\nword\n\n")

"""The incremental converter: cuts, limits, state, and streams."""

from __future__ import annotations

import gzip
import pickle

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomark.functions.markdown import Options
from loomark.streaming.chunks import slice_bytes
from loomark.streaming.incremental import Fallback, Feed, Limits, Stopped, convert_stream

SF = "/root/testdata/sf0.001"


def run(html: str | bytes, n: int = 1 << 30, **args) -> str:
    raw, feed, out = html if isinstance(html, bytes) else html.encode(), Feed(**args), ""
    for i in range(0, max(1, len(raw)), n):
        out += feed.feed(raw[i : i + n])
        feed = pickle.loads(pickle.dumps(feed))
    return out + feed.finish()


@pytest.mark.parametrize(
    "html,md",
    [
        ("", ""),
        ("<h1>T  x</h1><p>a <b>b</b> c</p>", "# T x\n\na **b** c\n"),
        ("<p>a<p>b", "a\n\nb\n"),
        ("<ul><li>x<li>y</ul><ol start=3><li>z<li>w</ol>", "- x\n- y\n\n3. z\n4. w\n"),
        ("<blockquote><p>q</p></blockquote><p>e", "> q\n>\ne\n"),
        ("<pre><code class='x language-py'>a `` b\nc</code></pre><p>t", "```py\na `` b\nc\n```\n\nt\n"),
        ("<p><a href='/u v'>x <i>y</i> [</a> <a href='javascript:1'>bad</a> <a>no</a><a href=x> </a>", "[x *y* \\[](</u v>) bad no\n"),
        ("<p><img src='a(b)' alt='A ]'><img onclick=x src='data:1'>", "![A \\]](<a(b)>)![]()\n"),
        ("<title>t &amp; u</title><script>a<b</script><style>p</style><p>x", "t & u" + "x\n"),
        ("<nav><ul><li>n</li></ul></nav><p>m<footer>f</footer>", "m\n"),
        ("<form><label>L <input value=1></label><iframe src='/f'>in</iframe></form>", "L [iframe](/f)in\n"),
        ("a &copy b &am", "a © b &am\n"),
        ("<p>x <!-- c --> y<br>z", "x  yz\n"),
    ],
)
def test_feed(html, md):
    assert run(html) == md
    for n in (1, 2, 5):
        assert run(html, n) == md


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/pbauli hdiv1=\"'&;\n\r`é", max_size=80), st.integers(1, 9))
def test_cuts_change_nothing(html, n):
    def outcome(size):
        try:
            return run(html, size, threshold=1 << 18)
        except (Fallback, Stopped) as e:
            return repr(e)

    assert outcome(n) == outcome(1 << 30)


def test_limits_and_errors():
    with pytest.raises(Fallback, match="table"):
        run("<p>a</p><table>")
    with pytest.raises(Stopped, match="table_after_commit"):
        run("<p>a</p>   <table>", 8)
    with pytest.raises(Fallback, match="math"):
        run("<math>")
    with pytest.raises(Stopped, match="encoding_error"):
        run(b"<p>\xff")
    with pytest.raises(Stopped, match="encoding_error"):
        run("é".encode()[:1])
    with pytest.raises(Stopped, match="budget_exceeded"):
        run("x" * 100, limits=Limits(total=50))
    with pytest.raises(Stopped, match="budget_exceeded"):
        run("<ul><li>" * 60, limits=Limits(stack=640))
    with pytest.raises(Stopped, match="budget_exceeded"):
        run("<pre>" + "x" * 3000, limits=Limits(output=1000))
    with pytest.raises(Fallback, match="lookahead"):
        run("<p " + "x" * 3000, 100, limits=Limits(lookahead=1000))
    assert run("word " * 2000, 100, limits=Limits(lookahead=1000)) == ("word " * 2000).rstrip() + "\n"
    assert run("<a href=u>" + "x" * 90 + "</a>", limits=Limits(output=40)) != ""


def test_memory_is_bounded():
    feed = Feed()
    for _ in range(2000):
        feed.feed(b"<p>" + b"some words here " * 40 + b"</p>")
    assert feed.stats.peak < 8000 and feed.stats.flushes == 2000


def test_abort_closes_what_is_open():
    feed = Feed()
    out = feed.feed(b"<p>a</p><ul><li>b <b>c")
    assert out == "a\n" and feed.abort() == "**\n"


def test_metadata():
    feed = Feed(base="http://h/d/p")
    feed.feed(b"<head><title> A &amp; B </title><link rel='x canonical' href='c'></head><body><title>no</title>")
    assert feed.metadata() == ("A & B", "http://h/d/c")


def test_inflation():
    raw = gzip.compress(b"<p>one</p><p>two</p>" * 50)
    assert run(raw, 7, encoding="gzip") == run(b"<p>one</p><p>two</p>" * 50)
    with pytest.raises(Stopped, match="truncated"):
        run(raw[:-9], 7, encoding="gzip")
    with pytest.raises(Stopped, match="format"):
        run(b"no gzip", 7, encoding="gzip")


def test_stream_and_batch_agree(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 6")
    chunks = slice_bytes(pages, 700)
    # later chunks first, and a page that never ends
    chunks.where("seq % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    chunks.where("seq % 2 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = convert_stream(stream, Options()).writeStream.format("memory").queryName("fed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.page_id: (r.markdown, r.status, r.n_chunks) for r in spark.table("fed").collect()}
    assert got == {r.page_id: (r.markdown, r.status, r.n_chunks) for r in convert_stream(chunks).collect()}
    assert len(got) == pages.count()


def test_incomplete_pages_are_told(spark):
    rows = [(1, None, 0, b"<p>a</p>", False), (1, None, 2, b"<p>c</p>", True), (2, None, 0, b"<table><tr><td>x</table>", True), (None, None, 0, b"", True)]
    got = {r.page_id: (r.status, r.markdown) for r in convert_stream(spark.createDataFrame(rows, "page_id long, url string, seq int, chunk binary, is_last boolean")).collect()}
    assert got == {1: ("abandoned", "a\n"), 2: ("fallback", "x\n"), None: ("converted", "")}

"""The training-data operators against plain versions, on sf0.001 and on a table of odd rows."""

from __future__ import annotations

import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomark.llm import audio, bpe, decontaminate, langid, line_dedup, pii, queries, sharding, simhash, substrings
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    d = str(tmp_path_factory.mktemp("odd"))
    long = "word " * 30_000 + "x" * 5000
    rows = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, None, None), (None, "hello there", "en"), (None, None, "fr"), (3, "", "en"), (4, " \n\t ", "fr"), (5, long, "en"), (6, long, "en"), (7, "é" * 300 + "\n" + "Same line\n" * 12, "fr"), *[(20 + i, f" same LINE \nown {i}", "fr") for i in range(12)]]
    docs = spark.createDataFrame([(*r, "s", None, 1, "x", 0.5, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int, fp string, score double, rejected boolean")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "u", "<p>x" * 50), (2, "u", "<p>x" * 50), (None, None, None), (3, "v\r\n", ""), (3, "v", "y" * 200_000), (3, None, "<p>x" * 50), (None, "n", "<p>x" * 50), (1, "again", "<p>x" * 50), (None, "n", "z" * 120)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, None), (None, "tiny"), (2, "a passage that is certainly long enough to be looked for in texts")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, odd, empty, name):
    n = {"op7_warc": 9, "op10_decontamination": 0}.get(name, 22)
    assert len(queries.QUERIES[name](spark, odd).collect()) == n
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("which", ["sf", "odd"])
def test_sql(spark, odd, name, which):
    sf = SF if which == "sf" else odd
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    df = queries.QUERIES[name](spark, sf)
    r = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(x) for x in df.collect()))) == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_op1(spark, odd, which):
    """Rows, sizes and checksums by value; gapless slots; the law: sizes differ by no more than the largest row allows."""
    sf = SF if which == "sf" else odd
    rows = queries.QUERIES["op1_sharding"](spark, sf).collect()
    want, words = Counter(), {}
    for r in table(spark, sf):
        b = (r.text or "").encode()
        want[(r.doc_id, len(b) + 16, zlib.crc32(b), len(re.findall("[^ \t-\r]+", r.text or "")))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.tokens) for r in rows) == want
    slots, load = defaultdict(list), Counter({i: 0 for i in range(40)})
    for r in rows:
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    size = [r.size for r in rows]
    assert which == "odd" or max(load.values()) <= max(sum(size) / 40 + sorted(size)[len(size) // 2], max(size) * 1.01)


def test_sharding_splits_hot_groups(spark):
    """A third of all rows share a text; a table in many runs; bytes near equal, all rows once."""
    rows = [(i, "hot text " * 50 if i % 3 == 0 else f"own {i} " * (i % 90)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old, sharding.RUN_ROWS = sharding.RUN_ROWS, 1
    try:
        got = sharding.assign(docs, 8).collect()
    finally:
        sharding.RUN_ROWS = old
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in got) == list(range(6000))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load.values()) < 1.02 * min(load.values())


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_op2(spark, odd, which):
    sf = SF if which == "sf" else odd
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.QUERIES["op2_pii"](spark, sf).collect())
    want = Counter((r.doc_id, *(n := brute.pii(r.text))[0].values(), n[1]) for r in table(spark, sf))
    assert got == want


def test_pii_spans(spark):
    texts = ["GB82 WEST 1234 5698 7654 32", "a@b.c_x@d.e", "9" * 30_000, "1.2.3.4.5.6.7.8 256.1.1.1", "é a@b.co call +1 (212) 555-0100."]
    df = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r._spans] for r in df.collect()}
    assert got == {0: [("iban", 0, 27)], 1: [("email", 0, 5), ("email", 5, 11)], 2: [], 3: [("ip", 0, 7), ("ip", 8, 15)], 4: [("email", 2, 8), ("phone", 14, 31)]}


def test_pii_kinds(spark):
    """IBANs end at their country's length; secrets; scores rise near context words; a column _spans gives way."""
    texts = ["ES91 2100 0418 4502 0005 1332 EUR 500", "BE68 5390 0754 7034 EUR 20", "BE68539007547034EUR", "NO93 8601 1117 947", 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "token = short", "bank iban GB82WEST12345698765432", "call 4111 1111 1111 1111", "card 4111 1111 1111 1111"]
    df = pii.find_pii(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _spans int"))
    got = {r.doc_id: [(s.kind, s.start, s.end, round(s.score, 2)) for s in r._spans if s.kind != "phone"] for r in df.collect()}
    assert got == {0: [("iban", 0, 29, 0.8)], 1: [("iban", 0, 19, 0.8)], 2: [], 3: [("iban", 0, 18, 0.8)], 4: [("secret", 2, 51, 0.7)], 5: [], 6: [("iban", 10, 32, 1.0)], 7: [("card", 5, 24, 0.7)], 8: [("card", 5, 24, 0.9)]}


def test_pii_linear(spark):
    """20,000 addresses in one text, within seconds, by value."""
    import time

    text = " ".join(f"user{i}@mail{i}.example.org é" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (r,) = pii.find_pii(df, kinds=("email", "ip")).collect()
    assert time.time() - began < 20
    assert [(s.start, s.end) for s in r._spans] == [m.span() for m in brute.PII[0][1].finditer(text)]


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_op3(spark, odd, which):
    import public_tokenizers as P
    import tiktoken

    sf = SF if which == "sf" else odd
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in table(spark, sf):
        text = r.text or ""
        ids = enc.encode_ordinary(text)
        # of each token: the character of its first and of its last byte
        owner = [i for i, c in enumerate(text) for _ in c.encode()]
        at = np.cumsum([0, *[len(enc.decode_single_token_bytes(i)) for i in ids]])
        starts, ends = [owner[a] for a in at[:-1]], [owner[b - 1] + 1 for b in at[1:]]
        want[(r.doc_id, len(ids), *[sha(np.array(x, "<u4").tobytes()) for x in (ids,)], sha(text.encode()), sha(np.array(starts + ends, "<u4").tobytes()))] += 1
    assert Counter(tuple(r) for r in queries.QUERIES["op3_bpe"](spark, sf).collect()) == want


def test_bpe_offsets(spark):
    text = "naïve 😀 test"
    r = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_offsets=True).first()
    starts, ends = np.frombuffer(r.starts, "<u4"), np.frombuffer(r.ends, "<u4")
    assert starts[0] == 0 and ends[-1] == len(text) and (starts < ends).all() and (starts[1:] < ends[:-1]).any()


def test_bpe_one_worker_a_task(spark):
    """Encoding and decoding are one Python node: two would keep two workers a task, each with the vocabulary."""
    docs = spark.createDataFrame([(1, "naïve 😀 test"), (2, None), (None, ""), (3, "word " * 30_000)], "doc_id long, text string")
    plan = bpe.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = lambda df: Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in df.collect())
    assert rows(bpe.encode(docs, with_decoded=True)) == rows(bpe.decode(bpe.encode(docs)))


def test_byte_table():
    chars, inverse = bpe.byte_table(), bpe.inverse_table()
    assert len(set(chars)) == 256 and all(inverse[ord(c)] == b for b, c in enumerate(chars))


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_op5(spark, odd, which):
    """All columns but the feature's own against plain code; the feature against brute.audio()."""
    sf = SF if which == "sf" else odd
    rows = queries.QUERIES["op5_audio"](spark, sf).collect()
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows)
    want, features = Counter(), {}
    for r in table(spark, sf):
        b = (r.text or "").encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        head = b"RIFF" + (len(p) + 36).to_bytes(4, "little") + b"WAVEfmt \x10\0\0\0\x01\0\x01\0\x40\x1f\0\0\x40\x1f\0\0\x01\0\x08\0data" + len(p).to_bytes(4, "little")
        want[(r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(p) + 44, hashlib.sha256(head + p).hexdigest())] += 1
        features[hashlib.sha256(p).hexdigest()] = p
    assert got == want
    for digest, p in list(features.items())[:20]:
        n, segments, energies = brute.audio(p)
        own = {(r.feature, r.segments) for r in rows if r.payload_sha256 == digest}
        assert len(own) == 1
        feature, spans = own.pop()
        count, _, _, mels = feature.split(":")
        assert int(count) == n and spans == ",".join(f"{round(a * 128 / 6)}:{round(b * 128 / 6)}" for a, b in segments)
        assert np.allclose([float(x) for x in mels.split(",")], energies, atol=0.011)


def test_audio_tensors(spark):
    docs = spark.createDataFrame([(1, "a long text " * 1000), (2, "short"), (3, "a long text " * 1000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in audio.features(audio.store(docs)[0]).collect()}
    t = audio.tensor_table(rows[1].tensors)
    assert isinstance(t.schema.field("log_mel").type, pa.FixedShapeTensorType) and t.schema.field("log_mel").type.shape == [audio.PATCH, audio.MELS]
    frames = np.concatenate(list(audio.log_mel(audio.samples_of(audio_bytes(b"a long text " * 1000)))))[:, : audio.MELS]
    flat = t.column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
    assert np.allclose(flat[: len(frames)], frames, atol=0.02) and not flat[len(frames) :].any()
    starts, ends = t.column("start_ms").to_pylist(), t.column("end_ms").to_pylist()
    assert starts[0] == 0 and starts[1:] == ends[:-1] and ends[-1] == audio.millis(len(frames))
    assert rows[1].tensors == rows[3].tensors and audio.tensor_table(rows[2].tensors).num_rows == 1


def audio_bytes(b):
    p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
    return b"RIFF" + (len(p) + 36).to_bytes(4, "little") + b"WAVEdata" + len(p).to_bytes(4, "little") + p


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_op6(spark, odd, which):
    """Fingerprints by brute.simhash(), components by comparing all."""
    docs = table(spark, SF if which == "sf" else odd)
    codes = np.array([brute.simhash(r.text) for r in docs], np.uint64)
    group = list(range(len(docs)))
    name = lambda i: (docs[i].doc_id is None, docs[i].doc_id or 0)
    while True:
        new = [min((group[j] for j in np.flatnonzero(np.bitwise_count(codes ^ c) <= 4)), key=name) for c in codes]
        if new == group:
            break
        group = new
    want = Counter((docs[i].doc_id, f"{int(codes[i]):016x}", docs[group[i]].doc_id) for i in range(len(docs)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.QUERIES["op6_simhash"](spark, SF if which == "sf" else odd).collect()) == want


@pytest.mark.parametrize("large", [16, 1 << 16])
def test_simhash_links(spark, large):
    """Components of clusters and of scattered codes, whole shards and shards cut into shells, against all pairs."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flip = lambda c: c ^ (np.uint64(1) << rng.integers(0, 64, len(c), dtype=np.uint64))
    codes = [base, rng.integers(0, 1 << 63, 300, dtype=np.uint64), *[flip(base) for _ in range(30)], *[flip(flip(flip(flip(flip(base))))) for _ in range(10)]]
    codes = np.unique(np.concatenate(codes))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    edges = simhash.links(df, len(codes), large=large)
    assert all(((e.a ^ e.b) & ((1 << 64) - 1)).bit_count() <= 4 for e in edges.collect())
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    group = np.arange(len(codes))
    while (new := np.array([group[row].min() for row in near])).tolist() != group.tolist():
        group = new
    own = codes.view(np.int64).tolist()
    parts = defaultdict(set)
    for c, g in zip(own, group.tolist()):
        parts[g].add(c)
    mine = defaultdict(set)
    for c in own:
        mine[got.get(c, c)].add(c)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, mine.values()))


def test_vantage_point_tree():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    tree = simhash.VPTree(codes)
    depth = lambda node: 0 if isinstance(node, np.ndarray) else 1 + max(depth(node[3]), depth(node[4]))
    assert depth(tree.root) > 5
    for c in codes[:50]:
        near = c ^ np.uint64(0b1010101)
        tree.free[:] = True
        assert sorted(tree.take(near, 12).tolist()) == np.flatnonzero(np.bitwise_count(codes ^ near) <= 12).tolist()


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_op8(spark, odd, which):
    sf = SF if which == "sf" else odd
    docs = [(r.doc_id, (r.text or "").encode()) for r in table(spark, sf)]
    seen = Counter(b[k : k + 200] for _, b in docs for k in range(len(b) - 199))
    want = Counter()
    for i, b in docs:
        m = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                m[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, m) if not y)
        want[(i, len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1])), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r) for r in queries.QUERIES["op8_substrings"](spark, sf).collect()) == want


def test_op8_match_with_settled_members(spark, tmp_path):
    """X shares a string only with Y and Z, which settle each other and are not its neighbours: its neighbours in the two
    orders are W and V. The anchor's hash is low enough for it to be that of every string around it."""
    rng = np.random.default_rng(3)
    alphabet = np.frombuffer(b"bcdefghijklmnopqrstuvwxyz", np.uint8)
    some = lambda n: rng.choice(alphabet, n).tobytes()
    raw = rng.choice(alphabet, 400_000)
    at = np.arange(len(raw) - substrings.Q + 1)
    best = int(substrings._ids(substrings._sums(raw), at, at + substrings.Q).argmin())
    anchor, a, b, y, y2 = raw[best : best + substrings.Q].tobytes(), some(100), some(100), some(25), some(25)
    around = {  # bytes before the anchor, nearest first, and after it
        "X": (a + b"m" + some(60), b + b"m" + some(60)), "W": (a + b"p" + some(60), some(160)), "V": (some(160), b + b"p" + some(60)),
        "Y": (a + b"y" + y + b"1" + some(40), b + b"y" + y2 + b"1" + some(40)), "Z": (a + b"y" + y + b"2" + some(40), b + b"y" + y2 + b"2" + some(40)),
    }
    texts = [left[::-1] + anchor + right for left, right in around.values()]
    for _ in range(40):  # other buckets, on both sides of this one
        same = some(500)
        texts += [some(50) + same + some(50), some(60) + same + some(40)]
    spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute.repeats(texts)
    assert all(want[i][0] for i in (0, 3, 4)) and not want[1][0] and not want[2][0]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op8_substrings"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want))


def test_op9(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.QUERIES["op9_langid"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_op9_values(spark, odd, which):
    """Predictions by plain compression with the fitted dictionaries."""
    sf = SF if which == "sf" else odd
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    want = Counter((r.doc_id, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2, brute.language(r.text, model)) for r in docs.collect())
    rows = queries.QUERIES["op9_langid"](spark, sf).collect()
    assert Counter((r.doc_id, r.held_out, r.lang_pred) for r in rows) == want
    assert all(r.score == 0 and r.rejected for r in rows if r.lang_pred == "und")


def test_language_sample(spark):
    """Rows of one id, or none, are drawn by their texts; the sample is bounded; noise and mixtures are rejected more often."""
    rows = [(None if i % 2 else 5, f"some words of text {i} " * 20, "en") for i in range(4000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=1 << 15)
    assert 1 << 14 < len(model["en"]) <= (1 << 15) + 100
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and length(text) > 600")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    own = docs.where(langid.held_out(F.col("doc_id"))).select("text").collect()
    rng = np.random.default_rng(1)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(100)) for _ in range(40)]
    share = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string").transform(lambda d: langid.classify(d, model)).where("rejected").count() / len(texts)
    assert share([r.text for r in own]) < 0.03 and share(noise) > 0.5


def test_op10(spark, tmp_path):
    """Against all windows of all items by edit distance, with quotes at all phases, edits, short items and null ids."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    items = [(1, prose(60)), (None, prose(50)), (3, prose(5)), (4, "ab\ncd"), (5, "  "), (6, None), (7, prose(30).upper())]
    texts = []
    for i in range(24):
        item = " ".join((items[i % 7][1] or "x").lower().split())
        begin = int(rng.integers(0, max(1, len(item) - 119)))
        quote = list(item[begin : begin + int(rng.integers(90, 260))])
        for _ in range(int(rng.integers(0, 16))):
            at = int(rng.integers(0, max(1, len(quote))))
            quote[at : at + 1] = list(str(rng.choice(["", "z", "yz"])))
        texts.append(prose(40) + " " + "".join(quote) + "\n " + prose(40))
    texts += [None, "", prose(80), "x ab cd.", "xab cd"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name = lambda x: (x is None, x or 0)
    want = {i: sorted((k for k, item in items if brute.contaminated(t, item)), key=name) for i, t in enumerate(texts)}
    want = {i: x for i, x in want.items() if x}
    assert 8 < len(want) < len(texts) - 4
    rows = queries.QUERIES["op10_decontamination"](spark, str(tmp_path)).collect()
    assert {r.doc_id: sorted(r.item_ids, key=name) for r in rows} == want
    # many blocks, few postings at a time
    docs, bench = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    again = decontaminate.find(docs, bench, block_chars=400).where(F.size("_hits") > 0).collect()
    assert {r.doc_id: sorted({h.item_id for h in r._hits}, key=name) for r in again} == want
    old, decontaminate.POSTINGS = decontaminate.POSTINGS, 7
    try:
        index = decontaminate.Index([x for x in items if x[1]])
        assert {i: sorted({h[0] for h in hits}, key=name) for i, hits in enumerate(index.search(texts)) if hits} == want
    finally:
        decontaminate.POSTINGS = old


def test_op10_whole_items(spark):
    bench = {r.item_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {r.doc_id: sorted(i for i, b in bench.items() if b in decontaminate.normal(r.text)) for r in table(spark, SF)}
    got = {r.doc_id: r.item_ids for r in queries.QUERIES["op10_decontamination"](spark, SF).collect()}
    assert got == {d: i for d, i in want.items() if i}


def test_verbatim_quotes_are_found():
    """Every quote of WINDOW + STRIDE - 1 characters, at each phase."""
    rng = np.random.default_rng(6)
    item = "".join(rng.choice(list("abcdefg hij"), 400))
    own = decontaminate.normal(item)
    index = decontaminate.Index([(1, item)])
    n = decontaminate.WINDOW + decontaminate.STRIDE - 1
    assert all(index.search([f"zz {own[i : i + n]} zz" for i in range(len(own) - n)]))


def test_decontamination_edits():
    item = "The quick brown fox jumps over the lazy dog while seven wizards box quietly in the dim and dusty attic of the old mill."
    near = item.replace("brown", "red").replace("seven", "eight").replace("  ", " ")
    index = decontaminate.Index([(7, item)])
    (hits, none) = index.search(["intro words here.\n\n" + near.upper() + " outro", "nothing of the kind " * 20])
    assert [h[0] for h in hits] == [7] and none == []


def test_warc_records(spark, tmp_path):
    """Any id type; the joined chunks are WARC/1.1 records with unique identifiers and the bytes of the payload."""
    from loomark.llm import warc

    rows = [("a\r\nb %é", "http://x/", "ü" * 5000), ("c", None, "ü" * 5000), ("d", "http://y/", ""), (None, "u", None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    chunks = warc.write_records(pages, f"{tmp_path}/w", chunk_bytes=777)
    records = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.record_id, r.chunk_no)):
        assert len(r.data) <= 2000
        records[r.record_id] = records.get(r.record_id, b"") + bytes(r.data)
    heads = [x.split(b"\r\n\r\n")[0].decode() for x in records.values()]
    assert all(h.startswith("WARC/1.1\r\n") and "\r\nWARC-Date: 20" in h for h in heads)
    assert len({h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads}) == 4
    for x in records.values():
        head, block = x.split(b"\r\n\r\n", 1)
        n = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert block[n:] == b"\r\n\r\n"
    back = warc.read_chunks(chunks, keep_data=True).collect()
    parts = {}
    for r in sorted(back, key=lambda r: (r.record_id, r.chunk_no)):
        parts[r.source_id] = parts.get(r.source_id, b"") + bytes(r.data)
    assert parts == {"a\r\nb %é": ("ü" * 5000).encode(), "c": b"", "d": b"", None: b""}
    assert {r.source_id: (r.record_type, r.refers_to) for r in back if r.is_last}["c"] == ("revisit", "a\r\nb %é")


def test_line_runs(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batch = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    for part in (batch("a\nb", "a"), batch("A \nc"), batch("b\nb"), batch("z")):
        runs.add(part)
    assert sorted(r.n for r in runs.counts().collect()) == [1, 1, 2, 3]
    assert runs.new_lines(batch("a\nnew")).count() == 1
    # a key is fresh in one run only; a merge join with a run shuffles nothing of it
    tables = [spark.read.table(name) for name, _ in runs._runs()]
    fresh = Counter(r.h for t in tables for r in t.where("fresh").collect())
    assert set(fresh.values()) == {1} and len(fresh) == 4
    plan = runs.fresh(tables[0]).drop("n")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan
    runs.remove()


@pytest.mark.parametrize("few_lines", [line_dedup.FEW_LINES, 0])
def test_line_runs_of_few_lines(spark, odd, monkeypatch, few_lines):
    """A session of many partitions doesn't cut a small table's runs into as many files; the result is the same either way."""
    want = Counter(tuple(r) for r in line_dedup.op4(spark, odd).collect())
    files, write, before = [], line_dedup.LineRuns._write, spark.conf.get("spark.sql.shuffle.partitions")

    def written(self, rows):
        name, path = write(self, rows)
        files.append(len(glob.glob(f"{path.removeprefix('file:')}/part-*")))
        return name, path

    monkeypatch.setattr(line_dedup.LineRuns, "_write", written)
    monkeypatch.setattr(line_dedup, "FEW_LINES", few_lines)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert Counter(tuple(r) for r in line_dedup.op4(spark, odd).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(files) == 8 and (max(files) == 1 if few_lines else max(files) > 8)


@pytest.mark.parametrize("lines", [5, 300_000])
def test_line_runs_of_few_lines_shuffle_nothing(spark, lines):
    runs = line_dedup.LineRuns(spark, fanout=2, lines=lines)
    assert runs.buckets == (1 if lines == 5 else 3)
    batch = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    for part in (batch("a\nb", "a"), batch("A \nc"), batch("b\nb"), batch("z"), batch("q\na")):
        runs.add(part)
    assert sorted(r.n for r in runs.counts().collect()) == [1, 1, 1, 2, 4]
    plan = runs.fresh(spark.read.table(runs._runs()[0][0])).drop("n")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan
    runs.remove()


def test_line_dedup_linear(spark):
    """Ten documents of 20,000 lines that all go, within seconds."""
    import time

    text = "\n".join(f"line {i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, f"{text}\nown {i}\nline 5") for i in range(10)], "doc_id long, text string")
    began = time.time()
    rows = line_dedup.dedup_lines(docs).collect()
    assert time.time() - began < 60
    assert {(r._n_lines, r._n_dropped, r._kept == f"own {r.doc_id}") for r in rows} == {(20_002, 20_001, True)}


def test_pipeline_values(spark):
    """The whole pipeline on sf0.001 against plain code."""
    import corpus_pipeline as c
    import public_tokenizers as P
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = langid.classify(docs, model).collect()
    kept = {r.doc_id: r.text for r in rows if not r.rejected}
    assert all(brute.language(r.text, model) != "und" for r in rows if r.doc_id in kept)
    strip = "\x20\t\n\x0b\f\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    seen = Counter(k for t in kept.values() for k in {key(x) for x in t.split("\n")})
    kept = {i: "\n".join(x for x in t.split("\n") if not (key(x) and seen[key(x)] >= 10)) for i, t in kept.items()}
    ids = sorted(kept)
    codes = np.array([brute.simhash(kept[i]) for i in ids], np.uint64)
    group = np.arange(len(ids))
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    while (new := np.array([group[row].min() for row in near])).tolist() != group.tolist():
        group = new
    kept = {i: kept[i] for k, i in enumerate(ids) if group[k] == k}
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(b in decontaminate.normal(t) for b in bench)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})
    want = {(i, len(x := enc.encode_ordinary(t)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept.items()}
    assert {tuple(r)[:4] for r in c.run(spark, SF).collect()} == want


def test_pipeline(spark, odd, empty):
    import corpus_pipeline as c

    for sf in (SF, odd):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in c.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            rows = out.collect()
            docs = spark.createDataFrame(rows, docs.schema)
        last = c.STAGES[-1][1](spark, docs, sf)
        assert last.count() == len(rows)
        assert sorted(map(repr, c.run(spark, sf).collect())) == sorted(map(repr, last.collect()))
    assert c.run(spark, empty).collect() == []
    stay = c.simhash_stage(spark, spark.read.parquet(f"{odd}/documents.parquet"), odd).groupBy("doc_id", "text").count()
    assert stay.where(F.col("count") > 1).count() == 0


CLASHING = ("_row", "_r", "_drop", "_kept_lines", "_kept", "_hits", "_key", "_n", "_aside_3", "lang_pred", "_lid_rejected", "h", "k", "a.b", "Text")


def clashing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in CLASHING])


@pytest.mark.parametrize("which", ["lines", "language", "decontamination"])
def test_clashing_columns(spark, which):
    docs, bench = clashing(spark), spark.createDataFrame([(1, "x" * 40)], "item_id long, text string")
    out, added = {
        "lines": lambda: (line_dedup.dedup_lines(docs), {"_n_lines", "_n_dropped", "_kept"}),
        "language": lambda: (langid.classify(docs, {"en": b"the cat", "fr": b"le chat"}), {"lang_pred", "score", "margin", "rejected"}),
        "decontamination": lambda: (decontaminate.find(docs, bench), {"_hits"}),
    }[which]()
    assert sorted(out.columns) == sorted({*docs.columns} | added)
    rows = out.collect()
    assert len(rows) == 60
    for n in set(CLASHING) - added:
        assert {r[n] for r in rows} == {f"own {n}"}


def test_clashing_columns_in_stages(spark):
    import corpus_pipeline as c

    docs = clashing(spark)
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in CLASHING), name

"""WARC records as a chunked table.

write_records() turns a table of payloads into the bytes of WARC/1.1 records and stores them as rows
(record_id, chunk_no, is_last, data): chunk 0 holds the record's headers, the others `chunk_bytes` of the block at most,
so that no task ever holds a serialised record as a whole. read_chunks() reads the rows of each record in order,
parses the headers and carries the payload's length and SHA-256 on from chunk to chunk; the last row of a record
has those of the full payload. Joining the data of a record's rows in order gives the bytes of a .warc file.
A record's identifier is a UUID made of the archive's own (random) and the record's number in it.

Equal payloads of at least `min_bytes` are written once: the record with the smallest id is a response, the
others are revisits that refer to it and carry no payload. Smaller ones are all responses.

Defined cases: a null payload is empty; null urls are written as an empty target; ids may be of any type that casts to a
string; a null id is never the smallest, so such a row revisits the smallest that there is; rows that repeat the smallest id
are all responses; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.llm.common import cut, fresh_path, small, table

CHUNK_BYTES = 1 << 16
MIN_BYTES = 100
BROADCAST_ROWS = 200_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def write_records(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES, date: datetime | None = None,
) -> DataFrame:
    """Writes a record per row to `path`; returns the stored chunk rows (record_id, chunk_no, is_last, data).

    date: the WARC-Date of all records, now where not given."""
    archive = uuid.uuid4().hex
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"), payload.alias("_p"))
    rows = rows.withColumn("_n", F.octet_length("_p").cast("long")).withColumn("_dg", F.sha2("_p", 256))
    groups = (
        rows.where(F.col("_n") >= min_bytes).groupBy("_dg").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
        .where("_c > 1 and _first is not null").select(F.col("_dg").alias("_gd"), "_first")
    )
    groups, _ = cut(groups, "payload_groups")
    if small(groups, BROADCAST_ROWS):  # under 20 MB; beyond that a shuffled join
        groups = F.broadcast(groups)
    rows = rows.join(groups, F.col("_dg") == F.col("_gd"), "left")
    rows = rows.withColumn("_revisit", F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")))
    rows = rows.withColumn("record_id", F.monotonically_increasing_id())
    name = F.md5(F.concat(F.lit(archive), F.col("record_id").cast("string")))
    own = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    source = lambda c: F.url_encode(F.col(c).cast("string"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.lit(HTTP)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("_revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), own, F.lit(">"))),
        line("WARC-Date", F.lit(stamp)),
        F.coalesce(line("WARC-Source-ID", source("_id")), F.lit("")),
        line("WARC-Target-URI", F.regexp_replace("_url", "[\\r\\n]", " ")),
        F.when(F.col("_revisit"), line("WARC-Refers-To-Source-ID", source("_first"))).otherwise(""),
        F.when(F.col("_revisit"), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_dg"))),
        line("WARC-Payload-Length", F.col("_n").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.lit(len(HTTP)) + F.when(F.col("_revisit"), 0).otherwise(F.col("_n"))).cast("string")),
        F.lit("\r\n"), http,
    )
    end = F.when(F.col("_revisit"), 0).otherwise(F.ceil(F.col("_n") / chunk_bytes)).cast("int")
    rows = rows.withColumn("_last", end).select("*", F.explode(F.sequence(F.lit(0), end)).alias("chunk_no"))
    tail = F.when(F.col("chunk_no") == F.col("_last"), F.lit("\r\n\r\n")).otherwise("")
    data = F.when(F.col("chunk_no") == 0, F.encode(head, "UTF-8")).otherwise(
        F.substring(F.col("_p"), (F.col("chunk_no") - 1) * chunk_bytes + 1, F.lit(chunk_bytes))
    )
    last = F.col("chunk_no") == F.col("_last")
    chunks = rows.select("record_id", "chunk_no", last.alias("is_last"), F.concat(data, F.encode(tail, "UTF-8")).alias("data"))
    return cut(chunks, "warc_chunks", path)[0]


READ_SCHEMA = (
    "record_id long, chunk_no int, is_last boolean, source_id string, url string, record_type string, refers_to string, "
    "payload_bytes long, sha256_so_far string, declared_digest string, declared_bytes long, data binary"
)


class _Record:
    """The state carried from chunk to chunk of one record."""

    def __init__(self, record_id: int):
        self.id, self.head, self.left, self.n, self.sha, self.fields, self.http = record_id, b"", None, 0, hashlib.sha256(), {}, b""
        self.in_http = True

    def feed(self, data: bytes) -> bytes:
        """Takes the record's next bytes; returns those that belong to the payload."""
        if self.left is None:
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                return b""
            lines = self.head[:at].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"record {self.id} doesn't begin with a WARC version")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            self.left = int(self.fields["content-length"])
            data, self.head = self.head[at + 4 :], b""
        data = data[: self.left]
        self.left -= len(data)
        if self.in_http:
            self.http += data
            at = self.http.find(b"\r\n\r\n")
            if at < 0:
                return b""
            self.in_http, data, self.http = False, self.http[at + 4 :], b""
        self.n += len(data)
        self.sha.update(data)
        return data


def _parse(keep_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec: _Record | None = None
        schema = pa.schema([("record_id", pa.int64()), ("chunk_no", pa.int32()), ("is_last", pa.bool_()), ("source_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("sha256_so_far", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("data", pa.binary())])
        num = lambda x: int(x) if x else None
        name = lambda x: None if x is None else unquote_plus(x)
        for batch in batches:
            out: list[tuple] = []
            data = batch.column("data")
            for i, (rid, no, last) in enumerate(zip(batch.column("record_id").to_pylist(), batch.column("chunk_no").to_pylist(), batch.column("is_last").to_pylist())):
                if no == 0:
                    rec = _Record(rid)
                part = rec.feed(data[i].as_py())
                if keep_data or last:
                    f = rec.fields
                    if last and rec.left:
                        raise ValueError(f"record {rid} lacks {rec.left} bytes")
                    out.append((rid, no, last, name(f.get("warc-source-id")), f.get("warc-target-uri"), f.get("warc-type"), name(f.get("warc-refers-to-source-id")), rec.n, rec.sha.hexdigest(), f.get("warc-payload-digest", "").removeprefix("sha256:"), num(f.get("warc-payload-length")), part if keep_data else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def read_chunks(chunks: DataFrame, keep_data: bool = True) -> DataFrame:
    """Chunk rows -> READ_SCHEMA rows: every chunk with keep_data, else the last of each record."""
    rows = chunks.select("record_id", "chunk_no", "is_last", "data")
    return rows.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_parse(keep_data), READ_SCHEMA)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    archive = write_records(pages, fresh_path(spark, "archive"))
    back = read_chunks(archive, keep_data=False).where("is_last")
    revisit = F.col("record_type") == "revisit"
    return back.select(
        F.col("source_id").cast(kind).alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("sha256_so_far")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
             min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""

"""Media columns: audio as 8-bit PCM WAV, and features of it.

store() wraps payload bytes as a mono WAV of 8-bit samples, in DataFrame functions, and writes the column. features()
reads the stored bytes back and computes, block by block: polyphase resampling (UP/DOWN), overlapped frames (FRAME samples,
HOP apart), log-mel energies of MELS bands, and speech-like segments by hysteresis over the frames' energy (begin above
HIGH, end below LOW, in dB around the mean). Memory is that of a recording (its samples, one energy a frame, the patches).

The log-mel frames are stored as fixed-shape tensors of PATCH x MELS half-precision numbers with the time span of each: the
column `tensors` holds an Arrow IPC stream of (start_ms, end_ms, log_mel), log_mel being of the fixed_shape_tensor type;
tensor_table() reads it.

Defined cases: a null text is empty; every payload is padded with blanks to a positive multiple of ALIGN bytes; the last
patch is padded with zeros; equal payloads give equal values (double precision, fixed block borders); null ids, repeated
rows and empty tables are kept as they are; other columns are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomark.llm.common import cut, remove, table

ALIGN = 192
RATE, UP, DOWN, TAPS = 8000, 3, 4, 24
FRAME, HOP, MELS, PATCH = 256, 128, 20, 64
BLOCK = 192 * 256
HIGH, LOW = 1.0, -1.0


def _le(n: Column, size: int) -> Column:
    """n as a little-endian unsigned integer of so many bytes."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def wav(payload: Column, rate: int = RATE) -> Column:
    """The bytes of a mono 8-bit PCM WAV file whose samples are the payload's bytes (an even number)."""
    n = F.octet_length(payload)
    fmt = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data"
    return F.concat(F.lit(b"RIFF"), _le(n + 36, 4), F.lit(fmt), _le(n, 4), payload)


def samples_of(media: bytes) -> memoryview:
    """The data chunk of a RIFF file."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(view):
        size = struct.unpack_from("<I", view, at + 4)[0]
        if view[at : at + 4] == b"data":
            return view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(id, n_bytes, media), written to the shared folder and read back, and its path."""
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    pad = F.greatest(F.lit(ALIGN), F.ceil(n / ALIGN) * ALIGN) - n
    payload = F.concat(raw, F.encode(F.repeat(F.lit(" "), pad.cast("int")), "UTF-8"))
    return cut(docs.select(F.col(id_col), n.cast("long").alias("n_bytes"), wav(payload).alias("media")), "media", compression="zstd")


@lru_cache(1)
def _bank() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase filters (UP, TAPS), window (FRAME), mel filters (FRAME/2+1, MELS)."""
    t = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut_at = 1 / max(UP, DOWN)
    h = np.sinc(t * cut_at) * cut_at * np.hamming(UP * TAPS) * UP
    phases = np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1])
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise, fall = (freq - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - freq) / (edges[2:] - edges[1:-1])
    return phases, np.hanning(FRAME + 1)[:-1], np.maximum(0, np.minimum(rise, fall))


def resample(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Polyphase resampling by UP/DOWN; each block's length is a multiple of DOWN."""
    phases = _bank()[0]
    past = np.zeros(TAPS - 1)
    for x in blocks:
        x = np.concatenate([past, x])
        past = x[len(x) - TAPS + 1 :]
        windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
        out = np.empty((len(windows) // DOWN, UP))
        for r in range(UP):
            out[:, r] = windows[DOWN * r // UP :: DOWN][: len(out)] @ phases[DOWN * r % UP]
        yield out.ravel()


def log_mel(samples: memoryview) -> Iterator[np.ndarray]:
    """Frames of MELS log energies and, last, the frame's energy in dB."""
    _, window, bank = _bank()
    raw = np.frombuffer(samples, np.uint8)
    blocks = ((raw[i : i + BLOCK].astype(float) - 128) / 128 for i in range(0, len(raw), BLOCK))
    rest = np.zeros(0)
    for x in resample(blocks):
        x = np.concatenate([rest, x])
        n = max(0, (len(x) - FRAME) // HOP + 1)
        rest = x[n * HOP :]
        if n:
            frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[: n * HOP : HOP] * window
            power = np.abs(np.fft.rfft(frames)) ** 2
            yield np.hstack([np.log(power @ bank + 1e-6), 10 * np.log10(power.sum(1, keepdims=True) + 1e-6)])
    if len(rest):
        power = np.abs(np.fft.rfft(np.pad(rest[:FRAME], (0, max(0, FRAME - len(rest)))) * window)) ** 2
        yield np.hstack([np.log(power @ bank + 1e-6), 10 * np.log10(power.sum() + 1e-6)])[None]


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that begin above mean + HIGH dB and last until below mean + LOW dB."""
    mean = energy.mean()
    sign = np.where(energy > mean + HIGH, 1, np.where(energy < mean + LOW, 0, -1))
    at = np.maximum.accumulate(np.where(sign >= 0, np.arange(len(sign)), 0))
    on = np.concatenate([[0], np.maximum(sign[at], 0), [0]])
    edge = np.flatnonzero(np.diff(on))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def millis(frame: int) -> int:
    return round(frame * HOP * 1000 * DOWN / (RATE * UP))


@lru_cache(1)
def _tensor_schema() -> pa.Schema:
    kind = pa.fixed_shape_tensor(pa.float16(), (PATCH, MELS))
    return pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("log_mel", kind)])


def tensor_stream(frames: np.ndarray) -> bytes:
    """Frames (n, MELS) as an Arrow IPC stream of patches with their time spans; the last patch is padded with zeros."""
    n, schema = len(frames), _tensor_schema()
    first = np.arange(0, n, PATCH)
    flat = np.zeros((len(first) * PATCH, MELS), np.float16)
    flat[:n] = frames
    held = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), PATCH * MELS)
    spans = [pa.array([millis(int(f)) for f in at], pa.int64()) for at in (first, np.minimum(first + PATCH, n))]
    batch = pa.record_batch([*spans, pa.ExtensionArray.from_storage(schema.field(2).type, held)], schema=schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensor_table(stream: bytes) -> pa.Table:
    """A stored stream as a table (start_ms, end_ms, log_mel)."""
    return pa.ipc.open_stream(stream).read_all()


def analyse(media: bytes) -> tuple[bytes, str, bytes, list[tuple[int, int]]]:
    """Payload, feature string, tensor stream, segments [(start_ms, end_ms)]."""
    payload = samples_of(media)
    parts = list(log_mel(payload))
    n = sum(map(len, parts))
    total = np.zeros(MELS)
    for part in parts:
        total += part[:, :MELS].sum(0)
    found = segments(np.concatenate([part[:, MELS] for part in parts]))
    feature = f"{n}:{len(found)}:{sum(b - a for a, b in found)}:" + ",".join(f"{x:.2f}" for x in np.round(total / n, 2) + 0.0)
    frames = np.concatenate([part[:, :MELS] for part in parts])
    return bytes(payload), feature, tensor_stream(frames), [(millis(a), millis(b)) for a, b in found]


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media_bytes, media_sha256, payload, feature, segments, tensors) of the stored bytes."""
    # the digest is of the stored column itself
    rows = media.select(id_col, "n_bytes", "media", F.sha2("media", 256).alias("media_sha256"))
    span = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media_bytes long, media_sha256 string, payload binary, feature string, segments array<struct<start_ms:long,end_ms:long>>, tensors binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                size = [len(x.as_buffer()) for x in part.column(2)]
                got = [analyse(x.as_buffer()) for x in part.column(2)]
                found = [[dict(start_ms=a, end_ms=b) for a, b in g[3]] for g in got]
                columns = [part.column(0), part.column(1), pa.array(size, pa.int64()), part.column(3), *[pa.array([g[k] for g in got], t) for k, t in ((0, pa.binary()), (1, pa.string()))], pa.array(found, pa.list_(span)), pa.array([g[2] for g in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "media_bytes", "media_sha256", "payload", "feature", "segments", "tensors"])

    return rows.mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    media, media_path = store(table(spark, sf_dir, "documents"))
    found = features(media)
    payload = F.col("payload")
    digests = found.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, F.octet_length(payload) - 15, F.lit(16))).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "segments",
        "tensors",
    )
    # the tensor column is stored, and what the query says of it is read from there
    stored, _ = cut(digests, "tensors", compression="zstd")
    remove(spark, media_path)
    spans = F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["start_ms"], s["end_ms"])), ",")
    return stored.select(
        *digests.columns[:-2], spans.alias("segments"), F.octet_length("tensors").cast("long").alias("tensor_bytes"), F.sha2("tensors", 256).alias("tensors_sha256")
    )

"""BLAKE3 of many inputs at once, after its published specification, and entity tags from it.

All chunks of a batch go through the compression function together, block by block; parents are merged level by level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
START, END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
BATCH = 4 << 20


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, words: np.ndarray, counter, length, flags) -> np.ndarray:
    n = len(words)
    a, b = cv.T[:4].copy(), cv.T[4:].copy()
    c = np.repeat(IV[:4, None], n, axis=1)
    d = np.empty((4, n), np.uint32)
    counter = np.broadcast_to(np.asarray(counter, np.uint64), n)
    d[0], d[1], d[2], d[3] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32), length, flags
    m = words.T
    for _ in range(7):
        for half in (0, 8):
            x, y = m[half : half + 8 : 2], m[half + 1 : half + 8 : 2]
            if half:
                b, c, d = np.roll(b, -1, 0), np.roll(c, -2, 0), np.roll(d, -3, 0)
            a = a + b + x
            d = _rot(d ^ a, 16)
            c = c + d
            b = _rot(b ^ c, 12)
            a = a + b + y
            d = _rot(d ^ a, 8)
            c = c + d
            b = _rot(b ^ c, 7)
        b, c, d = np.roll(b, 1, 0), np.roll(c, 2, 0), np.roll(d, 3, 0)
        m = m[ORDER]
    return np.concatenate([a ^ c, b ^ d]).T


def digests(inputs: list[bytes]) -> list[bytes]:
    """The 32-byte digest of each input."""
    if not inputs:
        return []
    size = np.array([len(x) for x in inputs])
    count = np.maximum(1, -(-size // CHUNK))
    owner = np.repeat(np.arange(len(inputs)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    raw = b"".join(x.ljust(c * CHUNK, b"\0") for x, c in zip(inputs, count.tolist()))
    words = np.frombuffer(raw, "<u4").reshape(len(owner), CHUNK // BLOCK, 16)
    left = np.minimum(size[owner] - at * CHUNK, CHUNK)
    blocks = np.maximum(1, -(-left // BLOCK))
    cv = np.repeat(IV[None], len(owner), axis=0)
    for i in range(CHUNK // BLOCK):
        on = np.flatnonzero(blocks > i)
        last = blocks[on] == i + 1
        flags = START * (i == 0) + END * last + ROOT * (last & (count[owner[on]] == 1))
        cv[on] = _compress(cv[on], words[on, i], at[on], np.clip(left[on] - i * BLOCK, 0, BLOCK), flags)
    while len(cv) > len(inputs):
        n = np.bincount(owner)[owner]
        i = np.arange(len(owner)) - np.searchsorted(owner, owner)
        even = np.flatnonzero(i % 2 == 0)
        pair = even[i[even] + 1 < n[even]]
        cv[pair] = _compress(np.repeat(IV[None], len(pair), axis=0), np.concatenate([cv[pair], cv[pair + 1]], axis=1), 0, BLOCK, PARENT + ROOT * (n[pair] == 2))
        cv, owner = cv[even], owner[even]
    return [x.tobytes() for x in cv.astype("<u4")]


def etag(text: Column, weak: bool = False) -> Column:
    """Quoted hex of the digest's first 16 bytes; W/ before it if weak. Null for null."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(column)
        held: list[tuple[int, bytes]] = []
        size = 0

        def settle() -> None:
            for (i, _), d in zip(held, digests([x for _, x in held])):
                out[i] = ("W/" if weak else "") + f'"{d[:16].hex()}"'

        for i, x in enumerate(column):
            if x is not None:
                held.append((i, x.encode()))
                size += len(held[-1][1])
                if size > BATCH:
                    settle()
                    held, size = [], 0
        settle()
        return pd.Series(out, dtype=object)

    return run(text)

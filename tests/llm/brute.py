"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii_valid(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def pii(text: str | None) -> tuple[dict[str, int], str]:
    """Counts by kind and the base spans' digest."""
    spans, n = [], {}
    for rank, (kind, pattern) in enumerate(PII):
        found = [m for m in pattern.finditer(text or "") if pii_valid(kind, m[0])]
        n[kind] = len(found)
        spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in found]
    return n, hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()


def repeats(texts: list[bytes], length: int = 200) -> list[tuple[int, int, str]]:
    """Bytes removed, spans of them and the digest of what is kept, for each text."""
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                m[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, m) if not y)
        out.append((sum(m), sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def audio(payload: bytes) -> tuple[int, list[tuple[int, int]], list[float]]:
    """Frames, segments and mean log-mel energies of 8-bit samples at 8 kHz, resampled to 6 kHz: whole-signal convolution,
    frame by frame. Only the constants are the operator's."""
    import numpy as np

    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    t = np.arange(72) - 35.5
    h = np.sinc(t / 4) / 4 * np.hamming(72) * 3
    up = np.zeros(len(x) * 3)
    up[::3] = x
    y = np.convolve(up, h)[: len(up)][::4]
    window = np.hanning(257)[:-1]
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 3000 / 700), 22) / 2595) - 1)
    freq = np.arange(129) * 6000 / 256
    starts = list(range(0, len(y) - 255, 128))
    if not starts or starts[-1] + 128 < len(y):
        starts.append(starts[-1] + 128 if starts else 0)
    logs, energy = [], []
    for s in starts:
        frame = y[s : s + 256]
        frame = np.pad(frame, (0, 256 - len(frame))) * window
        power = [abs(z) ** 2 for z in np.fft.rfft(frame)]
        row = []
        for a, b, c in zip(edges, edges[1:], edges[2:]):
            row.append(np.log(sum(p * max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for p, f in zip(power, freq)) + 1e-6))
        logs.append(row)
        energy.append(10 * np.log10(sum(power) + 1e-6))
    mean, on, begin, segments = sum(energy) / len(energy), False, 0, []
    for i, e in enumerate(energy):
        if not on and e > mean + 1:
            on, begin = True, i
        elif on and e < mean - 1:
            on = False
            segments.append((begin, i))
    if on:
        segments.append((begin, len(energy)))
    return len(energy), segments, list(np.mean(logs, axis=0))


def simhash(text: str | None) -> int:
    """Fingerprint of 4-word shingles, bit by bit."""
    from xxhash import xxh64

    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hs = [xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def language(text: str | None, model: dict[str, bytes]) -> str:
    """The language whose dictionary compresses the text's blocks of 4,096 bytes to the least, the first of equals."""
    import zstandard

    if not text or not model or not any(c.isalpha() for c in text):
        return "und"
    how = zstandard.ZstdCompressionParameters.from_level(
        5, strategy=zstandard.STRATEGY_GREEDY, min_match=3, window_log=18, hash_log=17, chain_log=17, search_log=4, write_content_size=0
    )
    raw, best = text.encode(), None
    for lang in sorted(model):
        d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096))
        if best is None or size < best[0]:
            best = (size, lang)
    return best[1]


def edits(window: str, text: str) -> int:
    """Least edits between the window and any part of the text."""
    import numpy as np

    w = np.frombuffer(window.encode("utf-32-le"), "<u4")
    step = np.arange(len(w) + 1)
    row, least = step.copy(), len(w)
    for ch in text:
        new = np.minimum(row + 1, np.concatenate([[0], row[:-1] + (w != ord(ch))]))
        new[0] = 0
        row = np.minimum.accumulate(new - step) + step
        least = min(least, int(row[-1]))
    return least


def contaminated(text: str | None, item: str | None) -> bool:
    """Whether a window of the item (100 characters, every 20 and the last) occurs in the text with a tenth of edits at most;
    items under 8 characters as whole words."""
    text, item = (" ".join((x or "").lower().split()) for x in (text, item))
    if not item:
        return False
    if len(item) < 8:
        return re.search((r"(?<![^\W_])" if item[0].isalnum() else "") + re.escape(item) + (r"(?![^\W_])" if item[-1].isalnum() else ""), text) is not None
    starts = {*range(0, max(1, len(item) - 99), 20), max(0, len(item) - 100)}
    return any(edits(w, text) <= min(len(w) // 10, (len(w) - 8) // 8) for w in (item[s : s + 100] for s in starts))

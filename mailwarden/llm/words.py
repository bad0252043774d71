"""Words of UTF-8 texts as 64-bit hashes, in numpy: one pass over the bytes, no Python object per word."""
from __future__ import annotations

import numpy as np

U = np.uint64
#: The bytes between words: space, tab, newline, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240607)
#: A random number for each byte and each place in a word (places repeat after 65,536).
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACE = np.cumprod(np.full(1 << 16, 0xD1342543DE82EF95, dtype=np.uint64))
_STEP = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def bounds(data: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words."""
    inside = ~blank[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = (edge[1::2], edge[::2]) if len(data) and inside[0] else (edge[::2], edge[1::2])
    if len(data) and inside[0]:
        starts = np.concatenate(([0], starts))
    if len(data) and inside[-1]:
        ends = np.concatenate((ends, [len(data)]))
    return starts, ends


def _hashes(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = bounds(data, blank)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    letters = data[~blank[data]]
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    h = np.add.reduceat(_BYTE[letters] * _PLACE[place & 0xFFFF], first)
    return mix(h + sizes.astype(np.uint64) * _STEP[0]), starts, ends


def hash_texts(texts: list[bytes], blank: np.ndarray = BLANK, limit: int = 1 << 20, spans: bool = False):
    """(hashes, ptr[, starts, ends]): the words of text i are ``ptr[i]:ptr[i+1]``; spans are bytes within the text.

    Works on at most ``limit`` bytes at once (more only for a longer single word).
    """
    parts, counts, at, to = [], np.zeros(len(texts), np.int64), [], []

    def flush(group):
        joined = b"\n".join(t for _, t, _ in group)
        h, s, e = _hashes(np.frombuffer(joined, np.uint8), blank)
        base = np.cumsum([0] + [len(t) + 1 for _, t, _ in group])
        cut = np.searchsorted(s, base)
        for k, (i, _, offset) in enumerate(group):
            counts[i] += cut[k + 1] - cut[k]
            if spans:
                at.append(s[cut[k]:cut[k + 1]] - base[k] + offset)
                to.append(e[cut[k]:cut[k + 1]] - base[k] + offset)
        parts.append(h)

    group, held = [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text) or (start == 0 and not text):
            end = min(len(text), start + limit)
            while end < len(text) and not blank[text[end]]:
                end += 1
            group.append((i, text[start:end], start))
            held += end - start + 1
            start = max(end, start + 1)
            if held >= limit:
                flush(group)
                group, held = [], 0
            if not text:
                break
    if group:
        flush(group)
    none = np.zeros(0, np.int64)
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    ptr = np.concatenate(([0], np.cumsum(counts)))
    if spans:
        return hashes, ptr, np.concatenate(at or [none]), np.concatenate(to or [none])
    return hashes, ptr


def windows(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; ``which`` chooses one of two independent hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = _STEP[which] | U(1)
    # doubling: the hash of 2^k words from two hashes of 2^(k-1) words
    out, done, span, power, level = None, 0, 1, step, h
    while True:
        if size & span:
            shifted = level[done:done + n]
            if out is None:
                out = shifted.copy()
            else:
                out = out * power_of(step, span) + shifted
            done += span
        span *= 2
        if span > size:
            break
        level = level[:len(level) - span // 2] * power + level[span // 2:]
        power = power_of(step, span)
    return mix(out + U(which))


def power_of(base, n: int):
    return U(pow(int(base), n, 1 << 64))


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    """Least value of each run of ``size`` values."""
    n = len(h) - size + 1
    if n <= 0:
        return h[:0]
    span = 1
    while span * 2 <= size:
        h = np.minimum(h[:len(h) - span], h[span:])
        span *= 2
    return np.minimum(h[:n], h[size - span:size - span + n])

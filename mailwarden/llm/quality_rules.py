"""Quality rules: word and line statistics, and compression bands over whole documents and fixed chunks.

The bands: a text is repetitive when zstandard shrinks it, or any chunk of it, below a limit, and incompressible when it or
a chunk stays above one. Short texts compress badly and long ones well whatever their quality, so limits belong to length
classes. A chunk is ``chunk_bytes`` of the UTF-8 text, judged by the chunk limits of the text's class; the last one, where
it is shorter, is judged as a text of its own length.
"""
from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from mailwarden.llm.common import map_texts
from mailwarden.llm.words import BLANK, hash_texts, windows

#: (bytes from which the class begins, least and greatest ratio of the whole text, the same of its chunks).
BANDS = (
    (0, 0.0, math.inf, 0.0, math.inf),
    (200, 0.20, 1.05, 0.20, 1.05),
    (600, 0.16, 0.95, 0.16, 0.95),
    (2000, 0.12, 0.85, 0.14, 0.85),
    (8000, 0.08, 0.75, 0.14, 0.75),
    (50000, 0.04, 0.70, 0.14, 0.70),
)
CHUNK_BYTES, LEVEL, WINDOW = 4096, 3, 8
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, n_bytes long, ratio double, least_chunk_ratio double, greatest_chunk_ratio double, band string, kept boolean")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(h: np.ndarray, size: int = WINDOW) -> int:
    """Words in runs of ``size`` words that occur at least twice in the text, the first occurrence included."""
    w = windows(h, size)
    if len(w) < 2:
        return 0
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def limits(n_bytes: int, bands=BANDS) -> tuple[float, ...]:
    """Least and greatest ratio of a text of ``n_bytes``, and of its chunks."""
    return [b[1:] for b in bands if n_bytes >= b[0]][-1]


def verdict(n_bytes: int, ratio: float | None, chunks: list[tuple[int, float]], chunk_bytes: int = CHUNK_BYTES, bands=BANDS) -> str:
    """"ok", "repetitive" or "incompressible". ``chunks`` has the bytes and the ratio of every chunk."""
    if ratio is None:
        return "ok"
    low, high, *whole = limits(n_bytes, bands)
    judged = [(ratio, low, high)]
    for n, r in chunks:
        judged.append((r, *(whole if n == chunk_bytes or len(chunks) == 1 else limits(n, bands)[:2])))
    if any(r < low for r, low, _ in judged):
        return "repetitive"
    return "incompressible" if any(r > high for r, _, high in judged) else "ok"


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS,
                  chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """One row per row of ``df``, without a shuffle.

    A null or empty text has no words: counts 0, ratios null, it fails the base rule. Null ids and repeated rows are
    judged like any other. Other columns of ``df`` are not read.
    """
    def work(rows):
        z = zstandard.ZstdCompressor(level=level)
        texts = [t or b"" for _, t in rows]
        hashes, ptr = hash_texts(texts)
        out = []
        for i, text in enumerate(texts):
            h = hashes[ptr[i]:ptr[i + 1]]
            raw = np.frombuffer(text, np.uint8)
            kinds = np.bincount(raw, minlength=256)
            continued = int(kinds[0x80:0xC0].sum())
            chars = len(raw) - continued - int(kinds[BLANK].sum())
            repeats = repeated_words(h)
            failed = len(h) < 20 or 100 * repeats > 30 * len(h)
            ratio, chunks = None, []
            if text:
                ratio = len(z.compress(text)) / len(text)
                chunks = [(len(p), ratio if len(p) == len(text) else len(z.compress(p)) / len(p))
                          for p in (text[k:k + chunk_bytes] for k in range(0, len(text), chunk_bytes))]
            band = verdict(len(text), ratio, chunks, chunk_bytes, bands)
            ratios = [r for _, r in chunks]
            out.append((rows[i][0], len(h), chars, int(kinds[_SYMBOL].sum()), duplicate_lines(text), repeats, failed,
                        len(text), ratio, min(ratios, default=None), max(ratios, default=None), band, not failed and band == "ok"))
        return out

    return map_texts(df, [df[id_col].alias("doc_id"), df[text_col].alias("text")], SCHEMA, work)

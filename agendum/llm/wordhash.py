"""Vectorised words and word n-grams of Arrow string columns.

Words are maximal runs of bytes that are not separators; UTF-8 bytes of
non-ASCII characters are never separators. A word is known by a 64-bit hash of
its (A-Z lower-cased) bytes. All functions work on whole texts; callers feed
them pieces of a batch through ``slices`` so that memory stays bounded by the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_NGRAM = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


WHITE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    lo, hi = off[0], off[-1]
    data = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return data, off - lo


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets): runs of whole texts of about
    ``limit`` bytes, a longer text alone."""
    data, off = utf8(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, text number) of every word."""
    n_texts = len(off) - 1
    if not len(data):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    folded = LOWER[data]
    inside = ~separators[folded]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    last = inside
    last = last & np.append(~inside[1:] | edge[1:-1], True)
    ends = np.flatnonzero(last) + 1
    width = ends - starts
    # One entry per byte of a word, separators left out.
    at = np.arange(int(width.sum()), dtype=np.int64)
    cum = np.concatenate(([0], np.cumsum(width)))[:-1]
    place = at - np.repeat(cum, width)
    power = np.full(int(width.max()), _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = _BYTE[folded[inside]] * power[place]
    h = mix(np.add.reduceat(value, cum) + width.astype(np.uint64))
    text = np.searchsorted(off, starts, "right") - 1
    return h, starts, ends, text.astype(np.int64) if n_texts else text


def shingles(h: np.ndarray, text: np.ndarray, n_texts: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct ``width``-word shingles of each text,
    sorted by text and hash. A text with fewer words, but at least one, has its
    whole word sequence as its one shingle."""
    if not len(h):
        return h, text
    out_h, out_t = [], []
    if len(h) >= width:
        ok = text[:-width + 1] == text[width - 1:]
        g = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            g += h[k:len(h) - width + 1 + k] * _NGRAM[k]
        out_h.append(mix(g[ok]))
        out_t.append(text[:-width + 1][ok])
    count = np.bincount(text, minlength=n_texts)
    short = (count > 0) & (count < width)
    pick = short[text]
    if pick.any():
        hs, ts = h[pick], text[pick]
        head = np.flatnonzero(np.append(True, ts[1:] != ts[:-1]))
        place = np.arange(len(hs)) - np.repeat(head, np.diff(np.append(head, len(hs))))
        g = np.add.reduceat(hs * _NGRAM[place], head) + count[ts[head]].astype(np.uint64) * _NGRAM[15]
        out_h.append(mix(g))
        out_t.append(ts[head])
    h, t = np.concatenate(out_h), np.concatenate(out_t)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))
    return h[new], t[new]

"""Vectorised tokenisation of Arrow string columns.

A *token* is a maximal run of bytes that holds no ASCII white space (9-13,
28-32); a character from U+3000 up to the surrogates, or above U+FFFF, is a token of its own, so
that scripts written without spaces are split too.  Work is done on the UTF-8
buffers with numpy; no Python object is made for a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Of so many bytes, the arrays of 64 bits that tokenisation makes stay in a core's cache.
CACHED_BYTES = 1 << 18
_PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_POWERS: dict[str, np.ndarray] = {}

#: ASCII letters fold to lower case; ASCII punctuation and NUL become 0 and are dropped.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _lo, _hi in ((0, 1), (33, 48), (58, 65), (91, 97), (123, 127)):
    _FOLD[_lo:_hi] = 0


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, _PIECE + 1)
        for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["p"], _POWERS["q"]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _lower(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case of all of Unicode; texts that aren't UTF-8 are left as they are."""
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    try:
        return buffers(pc.utf8_lower(texts))
    except pa.ArrowInvalid:
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            raw = data[a:b].tobytes()
            try:
                raw = pc.utf8_lower(raw.decode()).as_py().encode()
            except UnicodeDecodeError:
                pass
            out.append(raw)
        return np.frombuffer(b"".join(out), np.uint8), np.cumsum([0] + [len(x) for x in out])


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, without ASCII punctuation."""
    if np.any(data >= 0xC4):  # letters beyond Latin-1, or other characters
        data, offsets = _lower(data, offsets)
    out = _FOLD[data]
    if len(out):
        upper = np.flatnonzero(data[:-1] == 0xC3) + 1
        c = data[upper]
        upper = upper[(c >= 0x80) & (c <= 0x9E) & (c != 0x97)]
        out[upper] += 0x20
    keep = out != 0
    count = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    return out[keep], count[offsets]


@dataclass
class Tokens:
    """Tokens of some rows: byte ranges, the row of each, the first token of each row (n + 1), and the rows' own byte offsets."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    base: np.ndarray


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the tokens."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    lead = np.flatnonzero((data >= 0xE3) & (data != 0xEE) & (data != 0xEF))
    if len(lead):
        cut[lead] = True
        cut[np.minimum(lead + np.where(data[lead] >= 0xF0, 4, 3), n)] = True
    before = np.zeros(n + 1, bool)
    before[1:] = word
    here = np.zeros(n + 1, bool)
    here[:-1] = word
    return np.flatnonzero(here & (cut | ~before)), np.flatnonzero(before & (cut | ~here))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, which are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + _PIECE, "right")))
        stop = int(end[j - 1])
        p, q = _powers(stop - base + 1)
        h = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_BYTE[data[base:stop]] * p[: stop - base], out=h[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = mix64((h[e] - h[s]) * q[s] + (e - s).astype(np.uint64))
        i = j
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """All tokens of the rows, hashed."""
    start, end = spans(data, offsets)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Tokens(start, end, row, first, hash_spans(data, start, end), offsets)


def shingles(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's n-token shingles; a row of 1 to n - 1 tokens has one, of all its tokens."""
    count = np.diff(t.first)
    if not len(t.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = np.maximum(count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + t.first[row]
    last = t.first[row + 1]
    h = np.zeros(len(row), np.uint64)
    for k in range(n):
        i = at + k
        inside = i < last
        h = np.where(inside, mix64(h * np.uint64(_BASE) + t.hash[np.minimum(i, len(t.hash) - 1)]), h)
    return row, h

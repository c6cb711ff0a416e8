"""Vectorised text helpers shared by the operators' tasks.

Texts come as Arrow string arrays and are cut into chunks of a few megabytes, so
that a task's memory doesn't grow with its input. Nulls count as empty texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE = 5
_RADIX = np.uint64(0x9E3779B97F4A7C13)  # odd, so that its powers have inverses modulo 2**64
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers_of(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = np.uint64(pow(int(_RADIX), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, r, np.uint64))]) for r in (_RADIX, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse, n of each at least."""
    return _powers_of(max(19, (int(n) - 1).bit_length()))


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes, and offsets of each run of rows with about `size` bytes (one row at least)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_BYTE[_SPACE] = 0


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and the number of words before each text (one entry more), or before each of breaks.

    A word never spans texts; long chunks are hashed in pieces cut at word starts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets if breaks is None else breaks), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, offsets if breaks is None else breaks)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    hashes, edges = np.empty(len(starts), np.uint64), np.append(starts, n)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + CHUNK_BYTES // 2, "right")) - 1)
        lo, hi = edges[a], edges[b]
        up, down = powers(hi - lo)
        value = _BYTE[data[lo:hi]]
        value *= up[: hi - lo]
        hashes[a:b] = np.add.reduceat(value, starts[a:b] - lo) * down[starts[a:b] - lo]
        a = b
    return mix(hashes), before


def shingles(hashes: np.ndarray, before: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; of fewer words the whole sequence as one; none without words."""
    n = len(hashes)
    out = []
    rolled = np.zeros(0, np.uint64)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled *= _RADIX
            rolled += hashes[k : n - width + 1 + k]
        rolled = mix(rolled)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * _RADIX + h
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(rolled[:0])
    return out


# Classes of code points, as the pre-token pattern tells them apart.
OTHER, LETTER, NUMBER, BLANK = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    # fixed values: Unicode's White_Space
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = BLANK
    return out


@lru_cache(1)
def digits() -> np.ndarray:
    """A 64-bit number for each code point."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk, and the offset of each text in them."""
    points = np.frombuffer(str(data, "utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, leads[offsets]


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokens begin:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # texts begin here
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= edge[:n]
    blank = kind == BLANK
    start = change & ~blank
    # A white-space run: one token but for its last character, if something follows in the text.
    last = blank.copy()
    last[:-1] &= ~blank[1:] & ~edge[1:n]
    last[n - 1] = False
    start |= change & blank
    start |= last
    # A last blank U+0020 goes with what follows.
    joined = np.flatnonzero(last & (points == 32)) + 1
    start[joined] = False
    # Contractions: an apostrophe alone at a token's start, then one of the endings.
    quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = padded[quote + 1], np.where(edge[np.minimum(quote + 2, n)], 0, padded[quote + 2])
        ending = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
        for x, y in ("re", "ve", "ll"):
            ending[(one == ord(x)) & (two == ord(y))] = 2
        quote, ending = quote[ending > 0], ending[ending > 0]
        start[quote + 1] = False
        rest = quote + 1 + ending
        rest = rest[rest < n]
        start[rest] |= kind[rest] == LETTER
    return np.flatnonzero(start)


def span_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each span from one start to the next."""
    hashes, edges = np.empty(len(starts), np.uint64), np.append(starts, len(points))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + CHUNK_BYTES // 2, "right")) - 1)
        lo, hi = edges[a], edges[b]
        up, down = powers(hi - lo)
        value = digits()[points[lo:hi]]
        value *= up[: hi - lo]
        hashes[a:b] = np.add.reduceat(value, starts[a:b] - lo) * down[starts[a:b] - lo]
        a = b
    return mix(hashes)


def gather(table: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of a table that begin at `at`, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return table[:0]
    return table[np.repeat(at - (ends - lengths), lengths) + np.arange(ends[-1])]

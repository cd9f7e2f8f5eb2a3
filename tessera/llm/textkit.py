"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

Spans hashes byte spans by mixing eight bytes after eight, so the result depends on every byte and its place in no
algebraic way; Rolling hashes all strings of one width cheaply by a polynomial modulo 2**64. Two long regular strings
(such as Thue-Morse words) can agree under Rolling, so it only chooses places and never says that two strings are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that a kernel works on at once; a longer text is a piece of its own.
PIECE = 1 << 20
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 1 << 11
U = np.uint64
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)
_R = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=U)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow = np.ones(1, U)
_inv = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, PIECE + 1)
        full = lambda base: np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, base & (1 << 64) - 1, dtype=U)]), dtype=U)
        p, q = full(_B), full(_BINV)
        if size > 8 * PIECE:
            return p, q
        _pow, _inv = p, q
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on as one little-endian number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


class Spans:
    """Hashes of byte spans of one buffer."""

    def __init__(self, buf: np.ndarray):
        self._buf, self._at = buf, eights(buf)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(size.astype(U) + U(_B))
        out = mix(out * U(_B) + (self._at[start] & _KEEP[np.minimum(size, 8)]))
        live = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
        at, left, h = start[live] + 8, size[live] - 8, out[live]
        while len(live):
            h = mix(h * U(_B) + (self._at[at] & _KEEP[np.minimum(left, 8)]))
            on = left > 8
            if on.all():
                at, left = at + 8, left - 8
                continue
            out[live[~on]] = h[~on]
            live, at, left, h = live[on], at[on] + 8, left[on] - 8, h[on]
        for k in np.flatnonzero(size > LONG_SPAN):
            out[k] = xxhash.xxh3_64_intdigest(self._buf[start[k] : end[k]].tobytes())
        return out


class Rolling:
    """Keys of byte strings of one buffer from one prefix sum: P[i] = sum of R[byte_j] * B**j for j < i, modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        p, self._q = _powers(len(buf) + 1)
        self._p = np.zeros(len(buf) + 1, U)
        np.cumsum(_R[buf] * p[: len(buf)], dtype=U, out=self._p[1:])

    def __call__(self, width: int) -> np.ndarray:
        """The keys of all strings of width bytes, by first place."""
        n = len(self._p) - width
        return mix((self._p[width:] - self._p[:n]) * self._q[:n])


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of at most `limit` bytes, or of one longer row.

    A null counts as an empty text.
    """
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each run of bytes that are not white space, and the first word of each row (rows + 1)."""
    inside = ~space[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[:-1] = inside
    edge[-1] = False
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside
    cut = offsets[1:-1]
    cut = cut[cut < len(buf)]
    before_start = before.copy()
    before_start[cut] = False
    start = np.flatnonzero(edge & ~before_start)
    after = edge.copy()
    after[cut] = False
    end = np.flatnonzero(before & ~after)
    return start, end, np.searchsorted(start, offsets)


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]

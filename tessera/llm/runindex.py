"""A run-length index of a collection of byte strings: run-compressed BWT with sampled run ends.

Only the runs are kept: where each begins, its symbol, the text places of its first and last suffix (samples) and the
longest common prefix across each run border. These determine, for every place, how far it matches elsewhere in the
collection: stepping one place to the right inside a run loses exactly one symbol of the match, so matches change
by samples alone (the permuted longest-common-prefix array is linear between samples).
"""

from __future__ import annotations

import numpy as np

from .textkit import U, eights

#: Symbols of an index, ends of texts included, stay below 2**PLACE_BITS.
PLACE_BITS = 21


#: Symbols that the first sort of a suffix array looks at, nine bits each.
FIRST = 7


def suffix_array(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, by prefix doubling from FIRST bytes on.

    buf has fewer than 2**PLACE_BITS bytes. The byte at each of the ends, of which the last closes buf, counts as a
    symbol of its own below all bytes, and earlier ends are less.
    """
    n = len(buf)
    place = np.arange(n, dtype=U)
    bits = U(PLACE_BITS)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    symbols = np.concatenate([buf.astype(U) + U(1), np.zeros(FIRST, U)])
    keys = np.zeros(n, U)
    for j in range(FIRST):
        keys |= np.where(room > j, symbols[j : j + n], U(0)) << U(9 * (FIRST - 1 - j))
    # of suffixes that end alike the one of the earlier text comes first
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    fresh = np.concatenate([[0], (sorted_keys[1:] != sorted_keys[:-1]) | (room[order[1:]] < FIRST)]).astype(np.int64)
    rank, count, h = np.empty(n, np.int64), int(fresh.sum()) + 1, FIRST
    rank[order] = np.cumsum(fresh)
    while count < n:
        # past the end counts as least, which the last end, a symbol of its own, makes harmless
        low = np.concatenate([rank[h:], np.zeros(min(h, n), np.int64)])[:n]
        keys = np.sort((rank.astype(U) << (bits + bits)) | (low.astype(U) << bits) | place)
        order = (keys & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        pair = keys >> bits
        fresh = np.concatenate([[0], (pair[1:] != pair[:-1]).astype(np.int64)])
        rank[order] = np.cumsum(fresh)
        count, h = int(fresh.sum()) + 1, 2 * h
    return order


class RunLengthIndex:
    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.n_texts, self.size = len(texts), int(lengths.sum()) + len(texts)
        if self.size >= 1 << PLACE_BITS or len(texts) >= (1 << PLACE_BITS) - 256:
            raise ValueError("too many symbols for one index")
        self.ends = np.cumsum(lengths + 1) - 1
        buf = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8) if texts else np.zeros(0, np.uint8)
        symbols = buf.astype(np.int64) + self.n_texts
        # every end is a symbol of its own, so no match runs past it
        symbols[self.ends] = np.arange(self.n_texts)
        order = suffix_array(buf, self.ends) if self.size else np.zeros(0, np.int64)
        bwt = symbols[order - 1]
        border = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.run_start = np.concatenate([[0], border]) if self.size else border
        self.run_symbol = bwt[self.run_start]
        self.first = order[self.run_start]
        self.last = order[np.concatenate([border - 1, [self.size - 1]])] if self.size else self.first
        self.common = self._extend(buf, self.last[:-1], self.first[1:])

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def _extend(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of the pairs of places, up to the ends of their texts."""
        room = np.minimum(self.ends[np.searchsorted(self.ends, a)] - a, self.ends[np.searchsorted(self.ends, b)] - b)
        at, out = eights(buf), np.zeros(len(a), np.int64)
        live = np.flatnonzero(room > 0)
        while len(live):
            differ = at[a[live] + out[live]] ^ at[b[live] + out[live]]
            # the lowest differing bit names the first differing byte
            agree = np.where(differ == 0, 8, np.log2(np.maximum(differ & (~differ + U(1)), U(1)).astype(np.float64)).astype(np.int64) // 8)
            out[live] = np.minimum(out[live] + agree, room[live])
            live = live[(agree == 8) & (out[live] < room[live])]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every place, ends of texts included, the length of its longest match that begins at another place."""
        out = np.zeros(self.size, np.int64)
        places = np.arange(self.size)
        for at, value in ((self.first, np.concatenate([[0], self.common])), (self.last, np.concatenate([self.common, [0]]))):
            sample = np.zeros(self.size, np.int64)
            held = np.zeros(self.size, np.int64)
            sample[at], held[at] = at, value
            nearest = np.maximum.accumulate(sample)
            out = np.maximum(out, held[nearest] - (places - nearest))
        return out

    def repeated_starts(self, length: int) -> list[list[int]]:
        """For each text the runs [a, b) of places where a string of `length` bytes begins that begins elsewhere too."""
        long = self.matching_statistics() >= length
        out = []
        begin = 0
        for end in self.ends:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], long[begin:end].astype(np.int8), [0]])))
            out.append(edges.tolist())
            begin = end + 1
        return out

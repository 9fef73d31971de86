"""A compressed full-text index over sequences of symbols, and the search for repeats in it.

The index is the Burrows-Wheeler transform of the text in a wavelet matrix:
one packed bit row per bit of a symbol, with counts per machine word.  It keeps
no suffix array and no copy of the text.  All operations work on many patterns
at a time.
"""

from __future__ import annotations

import numpy as np


class FMIndex:
    """Index of ``symbols`` (0 ends a sequence; all others are positive), for patterns of up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        self.size = n
        order, rank, h = None, np.unique(symbols, return_inverse=True)[1], 1
        while True:  # suffixes by their first h symbols, doubled until patterns are told apart
            after = np.zeros(n, np.int64)
            if order is not None:
                after[: n - h] = rank[h:] + 1
            key = rank * np.int64(n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            h = h if after.max(initial=0) == 0 else 2 * h
            rank[order] = new
            if h > depth or new[-1] == n - 1:
                break
        self.bits = max(1, int(symbols.max(initial=1)).bit_length())
        counts = np.bincount(symbols, minlength=(1 << self.bits) + 1)
        starts = np.append(0, np.cumsum(counts))[: len(counts)]
        column = symbols[order - 1]  # before the first symbol stands the last one, an end
        self.words, self.ones, self.zeros = [], [], []
        for bit in range(self.bits - 1, -1, -1):
            b = (column >> bit) & 1
            packed = np.packbits(np.append(b, np.zeros(-n % 64 + 64, b.dtype)).astype(np.uint8), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.zeros.append(n - int(b.sum()))
            column = np.concatenate([column[b == 0], column[b == 1]])
        symbol = np.arange(1 << self.bits)
        self.shift = np.zeros(len(symbol), np.int64)
        self.shift = starts[: len(symbol)] - self.back(symbol, np.zeros(len(symbol), np.int64))

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row to which ``at`` leads when ``symbol`` is put before the pattern."""
        row = at
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            word, rest = row >> 6, (row & 63).astype(np.uint64)
            below = self.words[level][word] & ((np.uint64(1) << rest) - np.uint64(1))
            ones = self.ones[level][word] + np.bitwise_count(below)
            row = np.where((symbol >> bit) & 1, self.zeros[level] + ones, row - ones)
        return row + self.shift[symbol]


PROBE = 8


def repeated_intervals(index: FMIndex, symbols: np.ndarray, begins: np.ndarray, lengths: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal-to-the-left intervals of at least ``least`` symbols that the index holds twice or more.

    Query i is symbols[begins[i] : begins[i] + lengths[i]], itself part of the
    index.  Every run of ``least`` symbols of a query that occurs twice in the
    index lies in a reported (query, start, end).

    A search runs backwards from an end while its rows are two or more.  Where it
    stops, no repeat holds the symbols matched and the one before: after a match
    of ``least`` or more the next end is the last that avoids them; after a short
    match a probe of ``PROBE`` symbols tells whether the whole stretch can be
    skipped, else the end moves by one.
    """
    query = np.flatnonzero(lengths >= least)
    begin = begins[query]
    end = lengths[query].copy()
    at = end.copy()
    low, high = np.zeros(len(query), np.int64), np.full(len(query), index.size, np.int64)
    probing, from_end, stuck = np.full(len(query), -1), end.copy(), np.full(len(query), -1)
    found: list[np.ndarray] = []
    while len(query):
        symbol = symbols[begin + at - 1]
        both = index.back(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        new_low, new_high = both[: len(query)], both[len(query):]
        more = new_high - new_low >= 2
        low, high, at = np.where(more, new_low, low), np.where(more, new_high, high), at - more
        passed = more & (probing >= 0) & (at <= probing)  # the probe got past the place: no skip
        over = (more & (at == 0) & ~passed) | ~more
        long = over & (probing < 0) & (end - at >= least)
        if long.any():
            found.append(np.stack([query[long], at[long], end[long]], 1))
        place = at - 1  # where a search stopped
        next_end = end.copy()
        next_end = np.where(long, place + least, next_end)
        short = over & ~long & (probing < 0)
        probe = short & (end > place + PROBE) & (stuck != place)
        next_end = np.where(short & ~probe, end - 1, next_end)
        hit = over & (probing >= 0)
        next_end = np.where(hit, probing + PROBE - 1, next_end)
        next_end = np.where(passed, from_end - 1, next_end)
        stuck = np.where(passed, probing, stuck)
        from_end = np.where(probe, end, from_end)
        next_end = np.where(probe, place + PROBE, next_end)
        probing = np.where(probe, place, np.where(hit | passed, -1, probing))
        again = over | passed
        done = again & (((probing < 0) & (next_end < least)) | (more & (at == 0) & ~passed))
        end = np.where(again, next_end, end)
        at = np.where(again, end, at)
        low, high = np.where(again, 0, low), np.where(again, index.size, high)
        if done.any():
            keep = ~done
            query, begin, end, at, low, high, probing, from_end, stuck = (
                x[keep] for x in (query, begin, end, at, low, high, probing, from_end, stuck))
    return [tuple(r) for r in np.concatenate(found).tolist()] if found else []

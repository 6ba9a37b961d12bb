"""A compressed FM-index over one shard of texts: wavelet matrix over the Burrows-Wheeler transform, bit vectors with popcount
ranks, and every `sample`-th entry of the suffix array; the text itself and the other entries are not kept."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """All suffixes in order, by prefix doubling from as many symbols as fit a word. 0 is a separator: each one differs from every
    other, so that no comparison goes on beyond the end of a text."""
    n = len(codes)
    if n < 2:
        return np.arange(n)
    # the first k symbols as one number, nothing behind a separator; those with a separator among them are told apart by where it is
    bits = int(codes.max()).bit_length() or 1
    k = min(n, max(1, (62 - n.bit_length()) // bits))
    key, open_ = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for i in range(k):
        c = np.zeros(n, dtype=np.int64)
        c[: n - i] = codes[i:]
        key = (key << bits) | np.where(open_, c, 0)
        open_ &= c != 0
    stop = np.minimum.accumulate(np.where(codes == 0, np.arange(n), n - 1)[::-1])[::-1]
    key = key * np.int64(n) + np.where(open_, 0, stop)
    order = np.argsort(key, kind="stable")
    s = key[order]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    while rank[order[-1]] < n - 1 and k < n:
        key = rank * np.int64(n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        k *= 2
    return order


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class FMIndex:
    """Built over symbols 0..sigma-1, 0 standing between texts; finds ranges of suffixes for many patterns at once, symbol by symbol
    from the right, and the places of their rows."""

    def __init__(self, symbols: np.ndarray, sigma: int | None = None, sample: int = 8) -> None:
        self.n = len(symbols)
        sa = suffix_array(symbols)
        sigma = sigma or (int(symbols.max()) + 1 if self.n else 1)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))]).astype(np.int64)
        self.tree, self.zeros = [], []
        cur = symbols[sa - 1].astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            self.tree.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        # where each symbol's run starts after the last level
        self.start = np.zeros(sigma, dtype=np.int64)
        values, at = np.unique(cur, return_index=True)
        self.start[values] = at
        # rows whose place is kept: every sample-th, and the beginning of each text, so that no walk leaves a text
        begins = np.concatenate([[True], symbols[:-1] == 0]) if self.n else np.zeros(0, dtype=bool)
        keep = (sa % sample == 0) | begins[sa]
        self.kept, self.places = Bits(keep.astype(np.uint8)), sa[keep].astype(np.int32)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before row i of the transform."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.tree[k].rank1(i)
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i - self.start[symbol]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with symbol followed by what [lo, hi) starts with."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        c = self.first[symbol]
        return c + both[: len(symbol)], c + both[len(symbol) :]

    def before(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer than that of row i."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for k in range(self.levels):
            bit, ones = self.tree[k].get(i), self.tree[k].rank1(i)
            symbol = (symbol << 1) | bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return self.first[symbol] + i - self.start[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of the rows begin: each walks back to the next place that is kept."""
        out, at, far = np.zeros(len(rows), dtype=np.int64), np.asarray(rows, dtype=np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            here = self.kept.get(at) == 1
            out[live[here]] = self.places[self.kept.rank1(at[here])] + far
            live, at = live[~here], at[~here]
            at, far = self.before(at), far + 1
        return out

    def statistics(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text at `ends`: the length, up to `most` (of each end), of the longest run of its symbols
        before the end that stands in the index, and the range of rows that begin with that run."""
        n, lo, hi = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            a, b = self.step(text[ends[live] - n[live] - 1], lo[live], hi[live])
            some = a < b
            live, a, b = live[some], a[some], b[some]
            lo[live], hi[live] = a, b
            n[live] += 1
            live = live[n[live] < most[live]]
        return n, lo, hi

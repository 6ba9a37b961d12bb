"""Texts as numpy arrays: code points, words, rolling hashes. All functions work on whole texts, in groups of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What Python's str.split() and str.isspace() take as white space.
SPACES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CHUNK_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def space_table() -> np.ndarray:
    t = np.zeros(0x3002, dtype=bool)
    t[list(SPACES)] = True
    return t


def is_space(cp: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(cp, 0x3001)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inverse, self.n = base | 1, pow(base | 1, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up = np.cumprod(np.full(self.n, self.base, dtype=np.uint64))
            self.down = np.cumprod(np.full(self.n, self.inverse, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def prefix_hash(values: np.ndarray, powers: Powers) -> np.ndarray:
    """H with H[i] the polynomial hash of values[:i]; range_hash() takes differences."""
    up, _ = powers.upto(len(values) + 1)
    h = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end], the same wherever the values stand."""
    _, down = powers.upto(len(h))
    return mix((h[end] - h[start]) * down[start])


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` characters each; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n + 1
    if at < len(texts):
        yield at, len(texts)


def words_of(texts: list[str], powers: Powers, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, split at white space, and the number of words of each text."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    cp = code_points(" ".join(texts) + " ")
    gap = is_space(cp, table)
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[::2], edge[1::2]
    h = prefix_hash(cp.astype(np.uint64) + np.uint64(1), powers)
    words = range_hash(h, start, end, powers)
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)])))
    return words, counts


def batches(it: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Record batches cut so that each has a bounded number of characters, with the texts as a list (null as '')."""
    for b in it:
        texts = [t or "" for t in b.column(column).to_pylist()]
        for i, j in chunks(texts):
            yield b.slice(i, j - i), texts[i:j]


def sliding(values: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) over every run of w neighbours, in three passes whatever w is."""
    n = len(values)
    if n < w:
        return values[:0]
    pad = np.iinfo(values.dtype).max if op is np.minimum else 0
    full = np.full(-(-n // w) * w, pad, dtype=values.dtype)
    full[:n] = values
    rows = full.reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).ravel()
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], ahead[w - 1 : n])

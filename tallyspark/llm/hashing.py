"""Vectorised 64-bit hashes of words, word shingles and character n-grams over whole batches of texts (numpy)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64's)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def randoms(n: int, seed: int = 0) -> np.ndarray:
    """n odd pseudorandom multipliers, a fixed function of seed and place."""
    base = (seed * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(base)) | U(1)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts.

    buf: all bytes, a space after each text; start, end: of each word in buf; doc: the text it is from.
    """

    def __init__(self, texts, lower: bool = True):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        self.buf = _LOWER[buf] if lower else buf
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.doc_start = np.concatenate([[0], np.cumsum(sizes)])[: len(parts)]
        inside = ~_SPACE[self.buf]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        self.n_docs = len(parts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sizes = self.end - self.start
        first = np.cumsum(sizes) - sizes
        at = np.flatnonzero(~_SPACE[self.buf])
        place = np.arange(len(at)) - np.repeat(first, sizes)
        table = randoms(int(sizes.max()), seed)
        products = (self.buf[at].astype(np.uint64) + U(1)) * table[place]
        return mix(np.add.reduceat(products, first) + sizes.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def doc_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each text's run begins in ``doc``, and its end: n_docs + 1 places."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct ``width``-word shingle hashes; a shorter text has its whole sequence as one."""
    bounds = doc_bounds(doc, n_docs)
    multipliers = randoms(width, 77)
    n = len(words) - width + 1
    if n > 0:
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += words[k : k + n] * multipliers[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.sum(words[a:b] * multipliers[: b - a], dtype=np.uint64) + U(b - a)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Characters:
    """The code points of a batch of texts, a space before and after each text; doc: the text of each place."""

    def __init__(self, texts):
        parts = [f" {t or ''} ".encode("utf-32-le", "surrogatepass") for t in texts]
        self.codes = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
        self.doc = np.repeat(np.arange(len(parts)), [len(p) // 4 for p in parts])
        c = self.codes
        self.space = (c == U(32)) | ((c >= U(9)) & (c <= U(13)))

    def grams(self, n: int, seed: int = 0):
        """(hash, place of its first character) of every n-gram in a word; the first or the last may be a word's border."""
        size = len(self.codes) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        good = ~(self.space[:size] & self.space[n - 1 :]) if n > 1 else ~self.space
        for k in range(1, n - 1):
            good = good & ~self.space[k : k + size]
        at = np.flatnonzero(good)
        multipliers = randoms(n, 1000 + n + seed)
        total = np.zeros(len(at), np.uint64)
        for k in range(n):
            c = self.codes[at + k]
            total += np.where(self.space[at + k], U(32), c) * multipliers[k]
        return mix(total + U(n)), at

"""Vectorised polynomial hashing of byte buffers (arithmetic modulo 2**64)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, np.uint64(base), dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1); the table behind it has a power of two as its length."""
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, int(INVERSE if inverse else BASE))[:n]


class PrefixHash:
    """Prefix polynomial hashes of one buffer: any slice is hashed in constant time."""

    def __init__(self, buf: np.ndarray):
        terms = (buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = powers(len(buf) + 1, inverse=True)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def ranges(sizes, limit: int = 2 << 20):
    """(first, last) index ranges whose sizes together stay near ``limit``; a longer one is alone."""
    first, size, n = 0, 0, 0
    for i, k in enumerate(sizes):
        n = i + 1
        if size and size + k > limit:
            yield first, i
            first, size = i, 0
        size += int(k) + 1
    if first < n:
        yield first, n


def chunks(texts: list[bytes], limit: int = 2 << 20):
    """``ranges`` over the texts' bytes."""
    return ranges(map(len, texts), limit)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a space after each text, and each text's start in it (one more at the end)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buf, starts


def word_hashes(buf: np.ndarray, hashes: PrefixHash | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a buffer that ends in a space; ``hashes`` are the buffer's, if known."""
    space = SPACE[buf]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = (hashes or PrefixHash(buf)).slices(start, end)
    return start, mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Owner index and hash of each distinct ``width``-word shingle of each text, sorted by both.

    Words are lower-cased (A-Z). A text of fewer words gives its whole sequence as one
    shingle; a text without words gives none.
    """
    buf, starts = joined(texts)
    at, words = word_hashes(LOWER[buf])
    owner = np.searchsorted(starts, at, side="right") - 1
    n = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    weights = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(width)]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    h = np.zeros(len(words), np.uint64)
    for k, w in enumerate(weights):
        h += padded[k : k + len(words)] * w
    keep = np.zeros(len(words), dtype=bool)
    if len(words) >= width:
        keep[: len(words) - width + 1] = owner[width - 1 :] == owner[: len(words) - width + 1]
    short = np.flatnonzero((n > 0) & (n < width))
    own = np.concatenate([owner[keep], short])
    part = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = n[short] > k
        part[has] += words[first[short[has]] + k] * weights[k]
    h = mix(np.concatenate([h[keep], part + n[short].astype(np.uint64)]))
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    return own[new], h[new]

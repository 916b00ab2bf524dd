"""Word shingles as 32-bit hashes, and their universal hash minima."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_M32 = np.uint32(0xFFFFFFFF)


class Words(dict):
    """32-bit hash of a word, kept for the next time; emptied when it has grown to ``room`` words."""

    def __init__(self, room: int = 200_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: str) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 32-bit values."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingles(text: str | None, width: int, least_words: int, words: Words) -> np.ndarray | None:
    """Sorted distinct shingle hashes of a text; None if it has too few words."""
    if not text:
        return None
    found = WORD.findall(text.lower())
    if len(found) < max(least_words, width):
        return None
    ids = np.array([words[x] for x in found], dtype=np.uint32)
    n = len(ids) - width + 1
    value = ids[:n].copy()
    for k in range(1, width):
        value = mixed(value) * np.uint32(0x9E3779B1) + ids[k : k + n]
    return np.unique(mixed(value))


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``count`` multiply-add hash functions modulo 2^32."""
    random = np.random.default_rng(seed)
    return (random.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), random.integers(0, 2**32, count, dtype=np.uint32)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """Minimum of each hash function over the shingles, in blocks that stay in the cache."""
    best = np.full(len(a), _M32, dtype=np.uint32)
    for i in range(0, len(values), block):
        part = np.multiply.outer(a, values[i : i + block])
        part += b[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best

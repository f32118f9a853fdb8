"""Minimal perfect hashing of distinct integer keys by levels of bit arrays.

A level has twice as many bits as keys are left. A key that meets no other one in its level sets its bit and is placed; the
rest go on to the next level under another seed. A key's place is the number of set bits before its own, so n keys have the
places 0 to n - 1. Keys that were not built in may get any place: callers keep the keys by place and compare.
"""

from __future__ import annotations

import numpy as np

LOAD = 2.0


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of each key: shifts and odd multipliers, one to one for every seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Places:
    """Places of a fixed set of distinct keys (non-negative 64-bit integers)."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.int64), words
        self.starts = np.cumsum(self.sizes) - self.sizes
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.count = int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> Places:
        left, sizes, parts = keys.astype(np.uint64), [], []
        while len(left):
            size = max(64, -(-int(LOAD * len(left)) // 64) * 64)
            at = (mixed(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            parts.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone]
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for keys that no level holds."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist()), 1):
            if not len(open_):
                break
            at = (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            low = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            found[open_[hit]] = (self.before[word] + low)[hit]
            open_ = open_[~hit]
        return found

    def dump(self) -> bytes:
        return np.int64(len(self.sizes)).tobytes() + self.sizes.tobytes() + self.words.tobytes()

    @classmethod
    def load(cls, data: bytes) -> Places:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        return cls(np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint64, -1, 8 + 8 * n))

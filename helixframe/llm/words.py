"""Words of texts as stable 64-bit hashes, cached within a bound, for models over hashed features."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
CACHED = 100_000


class WordTable:
    """Codes of words; hashes[code], and values[code] of a function of (words, hashes). Keeps at most twice `cached` words between calls."""

    def __init__(self, value: Callable[[list[str], np.ndarray], np.ndarray] | None = None, cached: int = CACHED):
        self.value, self.cached = value, cached
        self.index: dict[str, int] = {}
        self.hashes, self.values = np.empty(0, np.uint64), np.empty(0, np.float32)

    def codes(self, words: list[str]) -> np.ndarray:
        """Codes that hold until the next call."""
        if len(self.hashes) > 2 * self.cached:  # not at each call: it takes as long as the table is large
            self.index = {w: i for w, i in self.index.items() if i < self.cached}
            self.hashes, self.values = self.hashes[: self.cached], self.values[: self.cached]
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.hashes), len(self.hashes) + len(new)), strict=True))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            self.hashes = np.concatenate([self.hashes, hashes])
            if self.value:
                self.values = np.concatenate([self.values, self.value(new, hashes)])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def split_words(texts: list[str], pattern: re.Pattern = WORD) -> tuple[list[str], np.ndarray]:
    """Lower-case words of all texts, and for each word the number of its text."""
    found = [pattern.findall(t.lower()) for t in texts]
    return list(chain.from_iterable(found)), np.repeat(np.arange(len(texts)), [len(f) for f in found])


def beginnings(words: list[str], lengths: range, bits: int) -> np.ndarray:
    """A row for each word: a hash of `bits` bits of its first n code points for each n of lengths, -1 where it is shorter."""
    most = lengths[-1]
    points = np.array(words, f"<U{most}").view(np.uint32).reshape(len(words), most).astype(np.uint64)
    out, h = np.full((len(words), len(lengths)), -1, np.int64), np.full(len(words), 0xCBF29CE484222325, np.uint64)
    for n in range(1, most + 1):
        h = (h ^ points[:, n - 1]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in lengths:
            mixed = (h + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - bits)
            out[:, lengths.index(n)] = np.where(points[:, n - 1] != 0, mixed.astype(np.int64), -1)
    return out

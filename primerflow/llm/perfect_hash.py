"""A minimal perfect hash over 64-bit keys, built level by level: a key stays at the first level at which its
bit is its own. The slot of a key is the number of set bits before its bit. Slots hold fingerprints, so that
a key that was never added is told apart."""

from __future__ import annotations

import numpy as np

_LEVELS = 48
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of x + seed * golden ratio."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed + 1) * _GOLDEN % 2**64)
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def key_of(ids: np.ndarray, is_null: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """The key of a document: its id (or null) and the how-manieth row with that id it is."""
    return mix(mix(ids.astype(np.int64).view(np.uint64), 1) ^ is_null.astype(np.uint64), 2) ^ mix(repeat.astype(np.uint64), 3)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray, left: np.ndarray):
        self.sizes, self.words, self.left = sizes, words, left
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Keys that no level tells apart (equal keys) are listed and get the last slots."""
        left, sizes, bits = keys.astype(np.uint64), [], []
        while left.size and len(sizes) < _LEVELS:
            m = -(-max(64, 2 * left.size) // 64) * 64
            at = mix(left, 10 + len(sizes)) % np.uint64(m)
            own = np.bincount(at.astype(np.int64), minlength=m) == 1
            sizes.append(m)
            bits.append(np.packbits(own, bitorder="little").view("<u8"))
            left = left[~own[at.astype(np.int64)]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, "<u8"), left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 if no level has its bit."""
        out, todo = np.full(keys.size, -1, np.int64), np.arange(keys.size)
        for level, m in enumerate(self.sizes):
            at = (mix(keys[todo], 10 + level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            low = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.before[at >> 6] + low)[hit]
            todo = todo[~hit]
            if not todo.size:
                return out
        for n, k in enumerate(self.left):
            out[todo[keys[todo] == k]] = self.before[-1] + n
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 4) >> np.uint64(32)).astype(np.uint32)

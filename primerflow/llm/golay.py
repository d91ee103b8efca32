"""The binary Golay code [23, 12]: which codewords lie near a 23-bit word.

The code is perfect: every word is within 3 bits of exactly one codeword. A word at distance 3 has five more
codewords at distance 4, any other word none. Two words that differ in at most one bit therefore meet: the
nearest codeword of either is within 4 bits of the other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the code.
GENERATOR = 0b101011100011
LENGTH, CHECK_BITS = 23, 11


def _remainder(word: int) -> int:
    for k in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - CHECK_BITS)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits; per remainder the errors of up to 4 bits, lightest first, -1 for none."""
    single = [_remainder(1 << k) for k in range(LENGTH)]
    low, high = np.zeros(2**12, np.int64), np.zeros(2**11, np.int64)
    for k in range(12):
        low ^= np.where(np.arange(low.size) >> k & 1, single[k], 0)
    for k in range(11):
        high ^= np.where(np.arange(high.size) >> k & 1, single[12 + k], 0)
    errors = np.full((2**CHECK_BITS, 6), -1, np.int64)
    used = np.zeros(2**CHECK_BITS, np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            errors[s, used[s]] = sum(1 << b for b in bits)
            used[s] += 1
    return low, high, errors


def nearby(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word six columns: the 12-bit index of its nearest codeword, then of those at distance 4 or -1."""
    low, high, errors = tables()
    found = errors[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(found >= 0, (words[:, None] ^ found) >> CHECK_BITS, -1)

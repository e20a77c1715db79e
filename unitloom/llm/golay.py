"""The binary Golay code [23, 12, 7]: every 23-bit word lies within three bits of exactly one codeword."""

from __future__ import annotations

from functools import cache

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error pattern (at most three bits) of every syndrome."""
    low = np.array([_remainder(x) for x in range(1 << 12)], dtype=np.int32)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], dtype=np.int32)
    error = np.zeros(1 << 11, dtype=np.int32)
    bits = [1 << i for i in range(23)]
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                e = bits[a] | bits[b] | bits[c]
                error[_remainder(e)] = e
    return low, high, error


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    low, high, error = _tables()
    words = words.astype(np.int32)
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def nearby_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 24) indices of the codewords near each word, and a mask that marks each distinct one once.

    They are the decodings of the word and of its 23 neighbours at one bit: one index, or six where the word is
    three bits from its codeword. Two words at two bits or fewer have a common neighbour (or one is the other's),
    so they share an index.
    """
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.int32)
    found = np.sort(codeword_index(words.astype(np.int32)[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, fresh

"""Hashed word shingles of a text, computed with array operations."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the word hash, of the places in a shingle, and of the mixer.
BASE, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE)
    return np.multiply.accumulate(out) if n else out


_powers = powers(64)


def word_hashes(words: bytes) -> np.ndarray:
    """64-bit hash of each word of a text whose words are parted by single spaces."""
    data = np.frombuffer(words + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - starts
    longest = int(lengths.max())
    table = _powers if longest < len(_powers) else powers(longest + 1)
    place = np.arange(len(data)) - np.repeat(starts, lengths + 1)
    sums = np.add.reduceat((data + np.uint64(1)) * table[place], starts)
    return mixed(sums)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; of the whole sequence where there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(b" ".join(words))
    width = min(size, len(hashes))
    many = len(hashes) - width + 1
    total = np.full(many, np.uint64(width))
    for k in range(width):
        total = mixed(total * BASE + hashes[k : k + many])
    return np.unique(total)

"""Cuckoo filters over 128-bit digests, with array operations for whole batches of keys."""

from __future__ import annotations

import numpy as np

from .shingles import mixed

SLOTS = 4
LOAD = 0.8
MOST_KICKS = 200


def halves(keys: list[bytes]) -> np.ndarray:
    """The digests as an array of two 64-bit numbers each."""
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


class CuckooFilter:
    """Buckets of 16-bit fingerprints; 0 is a free slot. A key is in one of two buckets.

    A key that finds no place after many evictions makes the filter twice as large, from all ``keys`` given anew.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        size = 1
        while size * SLOTS * LOAD < len(keys):
            size *= 2
        while True:
            made = cls(np.zeros((size, SLOTS), np.uint16))
            if made.add(keys):
                return made
            size *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _place(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pair = halves(keys)
        prints = (pair[:, 1] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (pair[:, 0] & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        prints, bucket = self._place(keys)
        other = self._other(bucket, prints)
        wanted = prints[:, None]
        return (self.table[bucket] == wanted).any(1) | (self.table[other] == wanted).any(1)

    def add(self, keys: list[bytes]) -> bool:
        """Insert all keys; False if one found no place."""
        if not keys:
            return True
        if len(keys) + np.count_nonzero(self.table) > LOAD * self.table.size and len(self.table) > 1:
            return False
        prints, bucket = self._place(keys)
        random = np.random.default_rng(len(keys))
        for kick in range(MOST_KICKS):
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            first = np.searchsorted(bucket, bucket)
            rank = np.arange(len(bucket)) - first
            free = self.table[bucket] == 0
            fits = rank < free.sum(1)
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(bucket)), np.minimum(rank, SLOTS - 1)]
            self.table[bucket[fits], slot[fits]] = prints[fits]
            prints, bucket, rank = prints[~fits], bucket[~fits], rank[~fits]
            if not len(prints):
                return True
            if kick % 2:
                lead = np.concatenate([bucket[1:] != bucket[:-1], [True]])
                slots = random.integers(0, SLOTS, int(lead.sum()))
                old = self.table[bucket[lead], slots].copy()
                self.table[bucket[lead], slots] = prints[lead]
                prints[lead] = old
            bucket = self._other(bucket, prints)
        return False

    def remove(self, keys: list[bytes]) -> None:
        """Take out keys that were added before."""
        for print_, bucket in zip(*self._place(keys)) if keys else ():
            for place in (bucket, self._other(np.array([bucket]), np.array([print_]))[0]):
                found = np.flatnonzero(self.table[place] == print_)
                if len(found):
                    self.table[place, found[0]] = 0
                    break

"""A minimal perfect hash over 128-bit keys with fingerprints and counts, vectorised.

Levels of bit arrays: on each level the keys left are thrown at twice as many bits; those that land alone set
their bit, the rest go on. A key's index is the rank of its bit, so n keys have the indexes 0 to n-1, and the
fingerprint stored there tells members from others.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
GAMMA = 2


def _throw(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = h + U((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return ((x ^ (x >> U(31))) % U(bits)).astype(np.int64)


class PerfectHash:
    """Distinct keys (h, mark), distinct in h, to counts. Keys that share an h with another key are listed apart."""

    def __init__(self, levels: list[np.ndarray], marks: np.ndarray, counts: np.ndarray):
        self.levels, self.marks, self.counts = levels, marks, counts
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(at + np.cumsum(bits) - bits)
            at += int(bits.sum())

    @classmethod
    def build(cls, h: np.ndarray, marks: np.ndarray, counts: np.ndarray) -> PerfectHash:
        levels, left = [], h
        while len(left):
            place = _throw(left, len(levels), GAMMA * len(left))
            alone = np.bincount(place, minlength=GAMMA * len(left)) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[place]]
        out = cls(levels, np.zeros(len(h), U), np.zeros(len(h), np.int64))
        at = out.index(h)
        out.marks[at], out.counts[at] = marks, counts
        return out

    def index(self, h: np.ndarray) -> np.ndarray:
        """Index of each key; that of a key that isn't a member is -1 or any index."""
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            place = _throw(h[open_], level, len(bits))
            hit = bits[place] == 1
            out[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        return out

    def count(self, h: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Count of each key, 0 if it isn't a member."""
        if not len(self.counts):
            return np.zeros(len(h), np.int64)
        at = self.index(h)
        return np.where((at >= 0) & (self.marks[at] == marks), self.counts[at], 0)

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        """(level sizes, packed bits, marks, counts) as bytes."""
        return np.array([len(x) for x in self.levels], np.int64).tobytes(), np.packbits(np.concatenate([np.zeros(0, np.uint8), *self.levels])).tobytes(), self.marks.tobytes(), self.counts.astype(np.uint32).tobytes()

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes, marks: bytes, counts: bytes) -> PerfectHash:
        cuts = np.cumsum(np.frombuffer(sizes, np.int64))
        flat = np.unpackbits(np.frombuffer(bits, np.uint8))[: int(cuts[-1]) if len(cuts) else 0]
        return cls(np.split(flat, cuts[:-1]) if len(cuts) else [], np.frombuffer(marks, U), np.frombuffer(counts, np.uint32).astype(np.int64))

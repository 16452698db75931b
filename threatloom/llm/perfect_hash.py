"""Minimal perfect hashing of 128-bit digests: each of ``n`` keys gets a slot of its own below ``n``.

A level is a bit array of ``SPREAD`` bits for each key that is left. Every such key hashes to a
bit; a bit that exactly one key hit is set, and keys that met another go on to the next level. A
key's slot is the number of set bits before its own, which counts kept for every 64 bits make a
constant number of reads. A key that was not built in may end at a bit too, so each slot keeps a
fingerprint of its key; a strange key passes it with a chance of one in 2**32.
"""

from __future__ import annotations

import numpy as np

from threatloom.llm.shingles import mixed

SPREAD = 2
#: Distinct digests part long before; beyond it two keys must be equal.
LEVELS = 200
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HEAD = np.dtype([("keys", "<i8"), ("levels", "<i8")])


def digest_words(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """16-byte digests as two arrays of 64-bit words."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return words[:, 0].copy(), words[:, 1].copy()


def _bits(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = mixed(np.array([level + 1], dtype=np.uint64) * _STEP)
    return (mixed(a + seed ^ mixed(b ^ seed)) % np.uint64(size)).astype(np.int64)


def fingerprints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed(a ^ mixed(b + _STEP)) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Slots of a fixed set of digests."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.keys = int(self.before[-1])

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """From the words of distinct digests."""
        left, sizes, parts = np.arange(len(a)), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("two keys have equal digests")
            size = -(-SPREAD * len(left) // 64) * 64
            at = _bits(a[left], b[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.array(sizes, dtype="<i8"), np.concatenate(parts) if parts else np.empty(0, "<u8"))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that no level keeps."""
        slot = np.full(len(a), -1, dtype=np.int64)
        left, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _bits(a[left], b[left], level, size)
            word, bit = self.words[base + at // 64], (at % 64).astype(np.uint64)
            there = (word >> bit & np.uint64(1)) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[left[there]] = (self.before[base + at // 64] + below)[there]
            left, base = left[~there], base + size // 64
        return slot

    def to_bytes(self) -> bytes:
        head = np.array([(self.keys, len(self.sizes))], dtype=_HEAD)
        return head.tobytes() + self.sizes.tobytes() + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The function at the beginning of some bytes, and where it ends."""
        head = np.frombuffer(data, _HEAD, 1)[0]
        at = _HEAD.itemsize + 8 * int(head["levels"])
        sizes = np.frombuffer(data, "<i8", int(head["levels"]), _HEAD.itemsize)
        words = np.frombuffer(data, "<u8", int(sizes.sum()) // 64, at)
        return cls(sizes, words), at + words.nbytes

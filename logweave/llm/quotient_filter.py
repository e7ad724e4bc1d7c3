"""Counting quotient filters that lose nothing.

A key is a few word ids, packed into two halves of at most 62 bits, and a
Feistel network permutes it invertibly into a fingerprint that looks random.  Its
upper bits, the quotient, say where it belongs; the filter stores the whole
rest, the remainder, so that a fingerprint, and by the inverse network its key,
can be read back.  Fingerprints stand in order of their quotients:

* ``occupied`` has a bit for every quotient that occurs,
* ``runends`` a bit for every entry that is the last of its quotient,
* remainders take as many bytes as they need,
* counters take one byte, and those above 254 a list of their own.

As filters are sorted, those of several shards are merged by sorted runs, and
counters of equal fingerprints are added.  A filter holds the fingerprints with a
given prefix (its block), so that blocks of different shards meet by number.
"""

from __future__ import annotations

import struct

import numpy as np

ROUNDS = 4
HEAD = struct.Struct("<QQBBB")  # entries, large counters, quotient bits, bytes of the remainder's two parts


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A fixed random function of 64 bits (any serves; the network inverts itself)."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Packing:
    """Keys of ``size`` ids of ``bits`` bits as two halves, and their
    permutation."""

    def __init__(self, size: int, bits: int):
        self.size, self.bits = size, bits
        self.half = (size * bits + 1) // 2
        if size not in (2, 3) or not 1 <= bits <= 40:
            raise ValueError("two or three ids of at most 40 bits")
        self.mask = np.uint64((1 << self.half) - 1)

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, *mid, z = (x.astype(np.uint64) for x in ids)
        if not mid:
            return a, z
        low = np.uint64(self.half - self.bits)  # of the middle id, the bits that go into the right half
        return a << np.uint64(self.bits - int(low)) | mid[0] >> low, (mid[0] & np.uint64((1 << int(low)) - 1)) << np.uint64(self.bits) | z

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        if self.size == 2:
            return [left.astype(np.int64), right.astype(np.int64)]
        low, bits = self.half - self.bits, np.uint64(self.bits)
        up = np.uint64(self.bits - low)
        mid = (left & np.uint64((1 << int(up)) - 1)) << np.uint64(low) | right >> bits
        return [x.astype(np.int64) for x in (left >> up, mid, right & np.uint64((1 << self.bits) - 1))]

    def permute(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, r + 1) & self.mask)
        return left, right

    def restore(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for r in reversed(range(ROUNDS)):
            left, right = right ^ (_mix(left, r + 1) & self.mask), left
        return left, right


def counted(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in order, each once, with the sums of their counts.
    Already sorted runs are found by the stable sorts."""
    by = np.lexsort((right, left))
    left, right = left[by], right[by]
    first = np.ones(len(left), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(first)
    if counts is None:
        total = np.diff(np.append(at, len(left)))
    else:
        total = np.add.reduceat(counts[by], at) if len(at) else np.zeros(0, np.int64)
    return left[at], right[at], total.astype(np.int64)


class Filter:
    """The fingerprints of a packing that begin with ``block``, a number of
    ``prefix`` bits, and their counts."""

    def __init__(self, packing: Packing, prefix: int, block: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray):
        self.packing, self.prefix, self.block = packing, prefix, block
        self.left, self.right, self.counts = left, right, counts

    def dump(self) -> bytes:
        n, half = len(self.left), self.packing.half
        rest = half - self.prefix  # bits of the left half below the block's number
        q = min(rest, max(0, n.bit_length() - 1))
        inside = self.left & np.uint64((1 << rest) - 1)
        quotient = (inside >> np.uint64(rest - q)).astype(np.int64)
        over = inside & np.uint64((1 << (rest - q)) - 1)
        # The remainder: what is left of the left half, then the right half.
        width = -(-(rest - q) // 8), -(-half // 8)
        raw = [x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :w] for x, w in zip((over, self.right), width, strict=True)]
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        large = self.counts > 254
        small = np.where(large, 255, self.counts).astype(np.uint8)
        parts = [HEAD.pack(n, int(large.sum()), q, *width), np.packbits(occupied), np.packbits(ends), *raw, small, self.counts[large].astype("<i8")]
        return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)

    @classmethod
    def load(cls, packing: Packing, prefix: int, block: int, data: bytes) -> Filter:
        n, n_large, q, *widths = HEAD.unpack_from(data)
        at = HEAD.size

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q)
        ends = np.unpackbits(take((n + 7) // 8), count=n)
        halves = []
        for w in widths:
            full = np.zeros((n, 8), np.uint8)
            full[:, :w] = take(n * w).reshape(n, w)
            halves.append(full.view("<u8").reshape(n).astype(np.uint64))
        counts = take(n).astype(np.int64)
        counts[counts == 255] = np.frombuffer(take(8 * n_large).tobytes(), "<i8")
        rest = packing.half - prefix
        # The k-th run of remainders belongs to the k-th quotient that occurs.
        quotient = np.flatnonzero(occupied)[np.cumsum(ends) - ends] if n else np.zeros(0, np.int64)
        left = np.uint64(block << rest) | quotient.astype(np.uint64) << np.uint64(rest - q) | halves[0]
        return cls(packing, prefix, block, left, halves[1], counts)

    @classmethod
    def merge(cls, filters: list[Filter]) -> Filter:
        """One filter of the sums of several of the same block."""
        f = filters[0]
        return cls(f.packing, f.prefix, f.block, *counted(*(np.concatenate([getattr(x, c) for x in filters]) for c in ("left", "right", "counts"))))

    def keys(self) -> list[np.ndarray]:
        """The word ids, by the inverse permutation."""
        return self.packing.unpack(*self.packing.restore(self.left, self.right))


def blocks(packing: Packing, prefix: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray):
    """Filters of sorted fingerprints, one for each prefix that occurs."""
    block = (left >> np.uint64(packing.half - prefix)).astype(np.int64)
    for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(block)) + 1):
        if len(part):
            a, z = part[0], part[-1] + 1
            yield Filter(packing, prefix, int(block[a]), left[a:z], right[a:z], counts[a:z])

"""First centres of k-means as Spark ML's k-means|| chooses them, for several seeds at once and as matrix products.

Spark ML compares each row with each candidate by itself, one seed after the other. Its random numbers depend on nothing but the
seed and a row's partition and place in it, so they are drawn here as there, and the choice is the same; only sums may round otherwise.
"""

from __future__ import annotations

from math import log, log1p, sqrt

import numpy as np

BITS = (1 << 64) - 1


def _hashed(seed: int) -> int:
    """The state that Spark's XORShiftRandom makes of a seed: MurmurHash3 of its eight bytes, twice."""

    def murmur(data: bytes, h: int) -> int:
        for i in (0, 4):
            x = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
            h ^= ((x << 15 | x >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    data = (seed & BITS).to_bytes(8, "big")
    low = murmur(data, 0x3C074A61)
    return murmur(data, low) << 32 | low


def _int(x: int) -> int:
    """The lowest 32 bits as a signed number."""
    return (x & 0xFFFFFFFF ^ 0x80000000) - 0x80000000


def _step(s):
    """The next state of XORShiftRandom, of a number or of an array of them."""
    s = s ^ (s << 21 & BITS if isinstance(s, int) else s << np.uint64(21))
    s = s ^ (s >> 35 if isinstance(s, int) else s >> np.uint64(35))
    return s ^ (s << 4 & BITS if isinstance(s, int) else s << np.uint64(4))


class _Shift:
    """XORShiftRandom, one number after the other."""

    def __init__(self, seed: int):
        self.state = _hashed(seed)

    def next(self, bits: int) -> int:
        self.state = _step(self.state)
        return self.state & ((1 << bits) - 1)

    def double(self) -> float:
        return ((_int(self.next(26)) << 27) + _int(self.next(27))) * 2.0**-53


class _Java:
    """java.util.Random."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def next(self, bits: int) -> int:
        self.state = self.state * 0x5DEECE66D + 0xB & (1 << 48) - 1
        return _int(self.state >> 48 - bits) if bits == 32 else self.state >> 48 - bits

    def double(self) -> float:
        return ((self.next(26) << 27) + self.next(27)) * 2.0**-53

    def long(self) -> int:
        return (self.next(32) << 32) + self.next(32)

    def below(self, bound: int) -> int:
        r = self.next(31)
        if bound & bound - 1 == 0:
            return bound * r >> 31
        while r - r % bound + bound - 1 >= 1 << 31:
            r = self.next(31)
        return r % bound


def _applied(tables: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = tables[0][s & np.uint64(255)]
    for i in range(1, 8):
        out ^= tables[i][s >> np.uint64(8 * i) & np.uint64(255)]
    return out


def _jumps(n: int) -> list[np.ndarray]:
    """Tables by byte that move a state on by 2, 4, 8 ... steps, up to n rows of two steps each. The step is linear in the state's bits."""
    out, columns = [], _step(_step(np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for _ in range(max(1, int(n).bit_length())):
        tables = np.zeros((8, 256), np.uint64)
        for bit in range(64):
            having = (np.arange(256) >> bit % 8 & 1).astype(bool)
            tables[bit // 8][having] ^= columns[bit]
        out.append(tables)
        columns = _applied(tables, columns)
    return out


def doubles(state: int, places: np.ndarray, jumps: list[np.ndarray]) -> np.ndarray:
    """The numbers that XORShiftRandom of a state gives for the rows at these places of a partition, one each."""
    s = np.full(len(places), state, np.uint64)
    for bit, tables in enumerate(jumps):
        some = np.flatnonzero(places >> bit & 1)
        s[some] = _applied(tables, s[some])
    first = _step(s)
    low = (_step(first) & np.uint64((1 << 27) - 1)).astype(np.int64)
    return (((first & np.uint64((1 << 26) - 1)).astype(np.int64) << 27) + low) * 2.0**-53


def first_row(sizes: list[int], seed: int) -> tuple[int, int]:
    """(partition, place) of the row that ``RDD.takeSample(false, 1, seed)`` takes from partitions of these sizes."""
    rand, n = _Java(seed), sum(sizes)
    found = [(p, i) for p, size in enumerate(sizes) for i in range(size)] if n == 1 else []
    gamma = -log(1e-4) / n
    fraction = min(1.0, max(1e-10, 1 / n + gamma + sqrt(gamma * gamma + 2 * gamma / n)))
    while not found:
        seeds = _Java(_int(rand.next(32)))
        for p, size in enumerate(sizes):
            own = _Shift(seeds.long())
            if fraction >= 1:
                found += [(p, i) for i in range(size)]
            elif fraction > 0.4:
                found += [(p, i) for i in range(size) if own.double() <= fraction]
            else:
                at = -1
                while (at := at + 1 + int(log(max(own.double(), 5e-11)) / log1p(-fraction))) < size:
                    found.append((p, at))
    for i in range(len(found) - 1, 0, -1):
        j = rand.below(i + 1)
        found[i], found[j] = found[j], found[i]
    return found[0]


def seed_of(seed: int) -> int:
    return _int(_Shift(seed).next(32))


def states(seed: int, step: int, partitions: int) -> list[int]:
    """The states by which k-means|| draws in each partition in a step."""
    return [_hashed(_int(seed ^ step << 16 ^ p)) for p in range(partitions)]


def weighted_plus_plus(points: np.ndarray, weights: np.ndarray, k: int, most: int = 30) -> np.ndarray:
    """Spark's LocalKMeans: k of the weighted points by k-means++, moved by up to ``most`` iterations."""
    rand, (n, width) = _Java(0), points.shape
    at = min(n, int(np.searchsorted(np.cumsum(weights), rand.double() * np.cumsum(weights)[-1])) + 1) - 1
    centres = np.empty((k, width))
    centres[0], cost = points[at], ((points - points[at]) ** 2).sum(1)
    for i in range(1, k):
        ahead = np.cumsum(cost * weights)
        r = rand.double() * ahead[-1]
        at = min(n, int(np.searchsorted(ahead, r)) + 1) - 1 if r > 0 else 0
        centres[i] = points[at]
        cost = np.minimum(cost, ((points - points[at]) ** 2).sum(1))
    own = np.full(n, -1)
    for _ in range(most):
        near = (points @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        if (near == own).all():
            break
        own, counts = near, np.bincount(near, weights, k)
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums = np.zeros((k, width))
        sums[own[order[starts]]] = np.add.reduceat((points * weights[:, None])[order], starts)
        for j in range(k):
            centres[j] = sums[j] / counts[j] if counts[j] else points[rand.below(n)]
    return centres

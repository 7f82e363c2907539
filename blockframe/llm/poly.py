"""Polynomial fingerprints of slices of a byte or symbol array, all at once.

Rolling works modulo 2^64. It is quick, but strings exist that it can't tell apart (a Thue-Morse string of 1024 letters and its complement), so
it only proposes. Prints works in two prime fields and settles: two given strings of n symbols agree with a chance of at most (n / 2^31)^2, and about 2^-62 where nobody chose them to.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: The field of a lane of Prints; bases of its two lanes, and of Rolling.
PRIME = (1 << 31) - 1
_LANES = (0x4F1BBCDD, 0x2C9277B5)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _grown(now: int, n: int) -> int:
    return max(n, 1 << 16, min(2 * now, 1 << 22))


class _Powers:
    """Powers of a base and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = _grown(len(self.up), n)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, U(factor))
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))
        return self.up, self.down


def _folded(x: np.ndarray, times: int) -> np.ndarray:
    """x modulo PRIME, up to one PRIME too large, after enough times; x is changed in place."""
    for _ in range(times):
        high = x >> U(31)
        x &= U(PRIME)
        x += high
    return x


class _FieldPowers(_Powers):
    """Powers of a base and of its inverse modulo PRIME."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, np.uint32)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = _grown(len(self.up), n)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                powers, have = np.ones(size, np.uint32), 1
                while have < size:
                    more = min(have, size - have)
                    powers[have : have + more] = (powers[:more].astype(U) * U(pow(factor, have, PRIME))) % U(PRIME)
                    have += more
                setattr(self, name, powers)
        return self.up, self.down


_POWERS, _FIELDS = _Powers(_BASE), [_FieldPowers(b) for b in _LANES]
_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
_FIELD_BYTES = [(mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407 + 2 * i)) % U(PRIME)).astype(U) for i in range(2)]


class Rolling:
    """Proposing fingerprints of slices [start, end) of one array."""

    def __init__(self, values: np.ndarray):
        """values: bytes, or symbols that are mixed already."""
        up, self.down = _POWERS.need(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum((_BYTES[values] if values.dtype == np.uint8 else values) * up[: len(values)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U) * U(0xA0761D6478BD642F))


class Prints:
    """Settling fingerprints of slices [start, end) of one array of fewer than 2^32 values."""

    def __init__(self, values: np.ndarray):
        """values: bytes, or 64-bit symbols, of which each lane takes 31 bits of its own."""
        self.lanes = []
        spread = None if values.dtype == np.uint8 else mix(values)
        for i, (field, table) in enumerate(zip(_FIELDS, _FIELD_BYTES, strict=True)):
            up, down = field.need(len(values) + 1)
            terms = table[values] if spread is None else spread >> U(33) if i else spread & U(PRIME)
            terms = _folded(terms * up[: len(values)], 1)
            sums = np.zeros(len(values) + 1, U)
            np.cumsum(terms, out=sums[1:])
            self.lanes.append((sums, down))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = None
        for sums, down in self.lanes:
            lane = _folded(sums[end] - sums[start], 2) * down[start]
            lane = _folded(lane, 2)
            lane[lane >= U(PRIME)] -= U(PRIME)
            out = lane if out is None else out << U(31) | lane
        return mix(mix(out) + (end - start).astype(U))

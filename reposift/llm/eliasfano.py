"""Elias-Fano sequences: non-decreasing integers in about 2 + log2(universe / n) bits each, with select."""

from __future__ import annotations

import struct

import numpy as np

#: Set bits between two entries of the select directory.
SAMPLE = 256
HEAD = struct.Struct("<QqBQQ")


class EliasFano:
    """A sequence split into packed low bits and a unary bit vector of the high parts.

    ``at(i)`` finds the i-th set bit from the nearest directory entry;
    ``all()`` unpacks everything.  Values are offset by the first one.
    """

    def __init__(self, n: int, base: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.base, self.low_bits = n, base, low_bits
        self.low, self.high = low, np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values``: signed 64-bit integers in non-decreasing order."""
        n = len(values)
        if not n:
            return cls(0, 0, 0, b"", b"", b"")
        base = int(values[0])
        rest = values.astype(np.int64).view(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)
        low_bits = max(0, (int(rest[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((rest[:, None] >> shifts & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little")
        ones = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, base, low_bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(),
                   ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, first: int, n: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(n, np.uint64)
        start = first * self.low_bits
        raw = np.frombuffer(self.low, np.uint8)[start // 8 : (start + n * self.low_bits + 7) // 8]
        bits = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + n * self.low_bits].reshape(n, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def _value(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return ((high.astype(np.uint64) << np.uint64(self.low_bits)) + low + np.uint64(self.base & 0xFFFFFFFFFFFFFFFF)).view(np.int64)

    def at(self, i: int) -> int:
        """The i-th value: select of the i-th set bit, minus i, above its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        byte, missing = place // 8, i % SAMPLE
        first = int(self.high[byte]) & (0xFF << place % 8 & 0xFF)
        while missing >= first.bit_count():
            missing -= first.bit_count()
            byte += 1
            first = int(self.high[byte])
        for _ in range(missing):
            first &= first - 1
        spot = byte * 8 + (first & -first).bit_length() - 1
        return int(self._value(np.array([spot - i]), self._low(i, 1))[0])

    def all(self) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return self._value(ones - np.arange(self.n), self._low(0, self.n))

    def to_bytes(self) -> bytes:
        head = HEAD.pack(self.n, self.base, self.low_bits, len(self.low), len(self.high))
        return head + self.low + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence stored from ``at`` on, and the place behind it."""
        n, base, low_bits, low, high = HEAD.unpack_from(raw, at)
        at += HEAD.size
        ends = np.cumsum([at, low, high, 4 * -(-n // SAMPLE)]).tolist()
        return cls(n, base, low_bits, *(bytes(raw[a:b]) for a, b in zip(ends, ends[1:]))), ends[-1]

"""Elias-Fano coding of non-decreasing numbers: n numbers up to u in about n * (2 + log2(u / n)) bits."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBxxxxxxx")
#: Every so many set bits of the upper half, one 32-bit place is kept for select.
SAMPLE = 512


def encode(values: np.ndarray) -> bytes:
    """Head (count, largest, low width), packed low bits, unary upper bits, select samples."""
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = np.empty((n, low), np.uint8)
    for k in range(low):
        bits[:, k] = values >> np.uint64(k) & np.uint64(1)
    upper = np.zeros((top >> low) + n + 1 if n else 0, np.uint8)
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper[places] = 1
    parts = np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes()
    return _HEAD.pack(n, top, low) + b"".join(parts)


class EliasFano:
    """Reader of ``encode``'s bytes: ``select(i)`` looks at one block, ``all()`` decodes everything."""

    def __init__(self, raw: bytes):
        self.n, self.top, self.low = _HEAD.unpack_from(raw)
        low_bytes = -(-self.n * self.low // 8)
        upper_bytes = -(-((self.top >> self.low) + self.n + 1) // 8) if self.n else 0
        at = _HEAD.size
        self._low = np.frombuffer(raw, np.uint8, low_bytes, at)
        self._upper = np.frombuffer(raw, np.uint8, upper_bytes, at + low_bytes)
        self._samples = np.frombuffer(raw, "<u4", -(-self.n // SAMPLE), at + low_bytes + upper_bytes)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th number, from one stretch of upper bits after the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, bit = divmod(int(self._samples[i // SAMPLE]), 8)
        want, block, seen = i % SAMPLE, 64, 0
        while True:
            ones = np.flatnonzero(np.unpackbits(self._upper[byte : byte + block], bitorder="little"))
            ones = ones[ones >= bit]
            if seen + len(ones) > want:
                place = byte * 8 + int(ones[want - seen])
                break
            seen, byte, bit = seen + len(ones), byte + block, 0
        first = i * self.low
        bits = np.unpackbits(self._low[first // 8 : (first + self.low + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low]
        return (place - i) << self.low | int(bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64)))

    def stretch(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1, from the stretch of bits that holds them: the select of a whole block."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.empty(0, np.int64)
        sample, after = i // SAMPLE, -(-j // SAMPLE)
        first = int(self._samples[sample])
        end = int(self._samples[after]) if after < len(self._samples) else 8 * len(self._upper)
        ones = np.flatnonzero(np.unpackbits(self._upper[first // 8 : -(-end // 8)], bitorder="little")) + 8 * (first // 8)
        ones = ones[ones >= first][i - sample * SAMPLE : j - sample * SAMPLE]
        at = i * self.low
        bits = np.unpackbits(self._low[at // 8 : -(-(j * self.low) // 8)], bitorder="little")[at % 8 : at % 8 + (j - i) * self.low]
        lows = bits.reshape(j - i, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return (ones - np.arange(i, j)) << self.low | lows

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self._upper, bitorder="little"))[: self.n]
        lows = np.unpackbits(self._low, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return (places - np.arange(self.n)) << self.low | lows.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

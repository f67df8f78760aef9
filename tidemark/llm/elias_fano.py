"""Elias-Fano sequences: ascending integers in about 2 + log2(universe / n) bits each, with select in constant time.

The low bits of every value lie packed side by side; the high parts are in unary
in a bit string whose i-th set bit is at (high part of value i) + i.  Every
SAMPLE-th set bit has its place sampled, so select(i) scans at most the bytes
between two samples.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
HEAD = struct.Struct("<QQBxxxxxxx")  # n, largest value, low bits


def encode(values: np.ndarray) -> bytes:
    """values: ascending unsigned 64-bit integers, repeats allowed."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
    high = np.zeros(n, np.int64) if low == 64 else (v >> np.uint64(low)).astype(np.int64)
    bits = np.zeros((-(-n * low // 8) + 8) * 8, np.uint8)
    at = np.arange(n, dtype=np.int64) * low
    for k in range(low):
        bits[at + k] = (v >> np.uint64(k)).astype(np.uint8) & 1
    lows = np.packbits(bits, bitorder="little")
    place = high + np.arange(n)
    unary = np.zeros(-(-(int(place[-1]) + 1 if n else 0) // 8) * 8, np.uint8)
    unary[place] = 1
    highs = np.packbits(unary, bitorder="little")
    if n and place[-1] >> 32:
        raise ValueError("a sequence holds at most about a billion values")
    samples = place[::SAMPLE].astype("<u4")
    return HEAD.pack(n, top, low) + struct.pack("<QQ", len(lows), len(highs)) + samples.tobytes() + lows.tobytes() + highs.tobytes()


class Sequence:
    """Reads a sequence in place, from bytes that may go on after it."""

    def __init__(self, raw: bytes, at: int = 0):
        self.n, self.largest, self.low = HEAD.unpack_from(raw, at)
        n_low, n_high = struct.unpack_from("<QQ", raw, at + HEAD.size)
        at += HEAD.size + 16
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(raw, "<u4", n_samples, at)
        self.lows = np.frombuffer(raw, np.uint8, n_low, at + 4 * n_samples)
        self.highs = np.frombuffer(raw, np.uint8, n_high, at + 4 * n_samples + n_low)
        self.end = at + 4 * n_samples + n_low + n_high

    def __len__(self) -> int:
        return self.n

    def _low_parts(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        first = i.astype(np.int64) * self.low
        byte, shift = first >> 3, (first & 7).astype(np.uint64)
        got = np.zeros(len(i), np.uint64)
        for k in range(8):
            got |= self.lows[byte + k].astype(np.uint64) << np.uint64(8 * k)
        got >>= shift
        # up to 64 bits that begin inside a byte reach into a ninth one; the encoder pads eight
        over = self.lows[byte + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1)))
        got |= np.where(shift > 0, over, np.uint64(0))
        return got & np.uint64((1 << self.low) - 1)

    def _highs(self, place: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.zeros(len(i), np.uint64) if self.low == 64 else (place - i).astype(np.uint64) << np.uint64(self.low)

    def _place(self, i: int) -> int:
        k = i // SAMPLE
        place = int(self.samples[k])
        stop = int(self.samples[k + 1]) // 8 + 1 if k + 1 < len(self.samples) else len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[place // 8 : stop], bitorder="little")) + place // 8 * 8
        return int(ones[ones >= place][i % SAMPLE])

    def select(self, i: int) -> int:
        """The i-th value, from the bytes between two samples."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = np.array([i])
        return int(self._highs(np.array([self._place(i)]), at)[0] | self._low_parts(at)[0])

    def range(self, first: int, stop: int) -> np.ndarray:
        """The values from place first to stop, exclusive: one select, then a scan of the bits that follow."""
        stop = min(stop, self.n)
        if first >= stop:
            return np.empty(0, np.uint64)
        i = np.arange(first, stop)
        begin = self._place(first)
        end = int(self.samples[(stop - 1) // SAMPLE + 1]) // 8 + 1 if (stop - 1) // SAMPLE + 1 < len(self.samples) else len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[begin // 8 : end], bitorder="little")) + begin // 8 * 8
        return self._highs(ones[ones >= begin][: stop - first], i) | self._low_parts(i)

    def all(self) -> np.ndarray:
        """Every value."""
        return self.range(0, self.n)

"""Elias-Fano coding of a monotone sequence in flat byte buffers.

``n`` non-decreasing integers below ``2**63``: the low ``l = floor(log2(u / n))`` bits are packed, the high parts are
unary in a bit vector, and every 512 bits of it keep one 32-bit count of ones (the select directory).  About
``2 + l`` bits a value.  The buffers are plain arrays, so a structure can be viewed over a memory map.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD, _HEAD_SIZE = "<QQBxxxxxxx", 24
_WORD = 512


_CHUNK = 1 << 15  # values packed or unpacked at once; a multiple of 8, so chunks end at whole bytes


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    if not bits or not len(values):
        return np.zeros(0, np.uint8)
    steps = np.arange(bits, dtype=np.uint64)
    return np.concatenate([np.packbits(((values[a: a + _CHUNK, None] >> steps) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
                           for a in range(0, len(values), _CHUNK)])


def _unpack(buffer: np.ndarray, bits: int, first: int, count: int) -> np.ndarray:
    """Values first..first+count of a packed array, decoded from just their bytes."""
    out = np.zeros(count, np.uint64)
    if bits:
        weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for a in range(0, count, _CHUNK):
            n = min(_CHUNK, count - a)
            start, stop = (first + a) * bits, (first + a + n) * bits
            raw = np.unpackbits(buffer[start // 8: (stop + 7) // 8], bitorder="little")[start % 8: start % 8 + n * bits]
            out[a: a + n] = raw.reshape(n, bits).astype(np.uint64) @ weights
    return out


class EliasFano:
    """A monotone sequence: ``encode`` writes it, ``from_buffer`` views it, ``select`` and ``values`` read it."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.high, self.directory = low, high, directory

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        universe = int(v[-1]) if n else 0
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        high = np.zeros(0, np.uint8)
        directory = np.zeros(0, np.uint32)
        if n:
            ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
            size = -(-(int(ones[-1]) + 1) // _WORD) * _WORD
            flags = np.zeros(size, np.uint8)
            flags[ones] = 1
            high = np.packbits(flags, bitorder="little")
            counts = flags.reshape(-1, _WORD).sum(axis=1, dtype=np.int64)
            directory = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)
        low = _pack(v & np.uint64((1 << bits) - 1), bits)
        return b"".join((struct.pack(_HEAD, n, universe, bits), struct.pack("<III", len(low), len(high), len(directory)),
                         low.tobytes(), high.tobytes(), directory.astype("<u4").tobytes()))

    @classmethod
    def from_buffer(cls, buffer, at: int = 0) -> "EliasFano":
        """A view of bytes, a memory map or any buffer; nothing is copied."""
        n, universe, bits = struct.unpack_from(_HEAD, buffer, at)
        sizes = struct.unpack_from("<III", buffer, at + _HEAD_SIZE)
        at += _HEAD_SIZE + 12
        low = np.frombuffer(buffer, np.uint8, sizes[0], at)
        high = np.frombuffer(buffer, np.uint8, sizes[1], at + sizes[0])
        directory = np.frombuffer(buffer, "<u4", sizes[2], at + sizes[0] + sizes[1])
        return cls(n, universe, bits, low, high, directory)

    def select(self, index: np.ndarray) -> np.ndarray:
        """Values at the given positions, each found through the directory and one 512-bit block."""
        index = np.asarray(index, dtype=np.int64)
        out = np.empty(len(index), np.uint64)
        for a in range(0, len(index), 4096):
            i = index[a: a + 4096]
            block = np.searchsorted(self.directory, i, side="right") - 1
            bits = np.unpackbits(self.high.reshape(-1, _WORD // 8)[block], axis=1, bitorder="little")
            want = i - self.directory[block].astype(np.int64) + 1
            at = (np.cumsum(bits, axis=1, dtype=np.int32) >= want[:, None]).argmax(axis=1) + block * _WORD
            out[a: a + 4096] = (at - i).astype(np.uint64) << np.uint64(self.low_bits)
            if self.low_bits:
                place = i[:, None] * self.low_bits + np.arange(self.low_bits)
                got = (self.low[place >> 3] >> (place & 7).astype(np.uint8)) & 1
                out[a: a + 4096] |= got.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out

    def values(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        """A run of values decoded at once (only the blocks that hold it)."""
        stop = self.n if stop is None else min(stop, self.n)
        if first >= stop:
            return np.zeros(0, np.uint64)
        a, b = np.searchsorted(self.directory, [first, stop - 1], side="right") - 1
        ones = np.flatnonzero(np.unpackbits(self.high[a * _WORD // 8: (b + 1) * _WORD // 8], bitorder="little")) + a * _WORD
        skip = first - int(self.directory[a])
        ones = ones[skip: skip + stop - first]
        high = (ones - np.arange(first, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        return high | _unpack(self.low, self.low_bits, first, stop - first)

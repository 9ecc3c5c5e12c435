"""Elias-Fano sequences and the n-gram trie built of them, over NumPy and one flat byte string.

A trie shard is one byte string of levels, read through a memory map: words (64-bit hashes),
contexts, monotone pointers from contexts to their successors, the successors relative to their
contexts, and quantised log probabilities. A query finds its context and its word, reads the
context's two pointers, and searches the word between them only.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .common import ship

ship(__name__)

#: Bytes of the high part in a block of the directory.
SPAN = 16
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th set bit of a byte, at [byte, k].
_NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _NTH[_b, _k] = _p


class EliasFano:
    """A rising sequence of unsigned 64-bit numbers: low bits packed, high parts in unary with a directory."""

    FIELDS = 6

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, top: int):
        self.n, self.width, self.low, self.high, self.ones, self.top = n, width, low, high, ones, top

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        part = values >> np.uint64(width)
        highest = int(part[-1]) if n else 0
        at = part.astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(n + highest + 1) // (8 * SPAN)) * 8 * SPAN, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_POP[high].reshape(-1, SPAN).sum(axis=1, dtype=np.int64))])
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            rest = values & np.uint64((1 << width) - 1)
            bit = np.arange(n, dtype=np.int64) * width
            cell, shift = bit >> 6, (bit & 63).astype(np.uint64)
            np.bitwise_or.at(low, cell, rest << shift)
            over = np.flatnonzero(shift.astype(np.int64) + width > 64)
            np.bitwise_or.at(low, cell[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        return cls(n, width, low, high, ones, highest)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.width
        cell, shift = bit >> 6, (bit & 63).astype(np.uint64)
        out = self.low[cell] >> shift
        over = shift.astype(np.int64) + self.width > 64
        out = np.where(over, out | (self.low[cell + 1] << ((np.uint64(64) - shift) & np.uint64(63))), out)
        return out & np.uint64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the high part."""
        out = np.empty(len(k), np.int64)
        before = self.ones if one else np.arange(len(self.ones)) * (8 * SPAN) - self.ones
        cells = self.high.reshape(-1, SPAN)
        for a in range(0, len(k), 1 << 16):
            want = k[a : a + (1 << 16)]
            block = np.searchsorted(before, want, "right") - 1
            left = want - before[block]
            data = cells[block] if one else ~cells[block]
            upto = np.cumsum(_POP[data], axis=1, dtype=np.int64)
            byte = (upto <= left[:, None]).sum(axis=1)
            row = np.arange(len(want))
            left = left - np.where(byte > 0, upto[row, byte - 1], 0)
            out[a : a + (1 << 16)] = block * (8 * SPAN) + 8 * byte + _NTH[data[row, byte], left]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number >= x (n if none), and whether it equals x.

        With first and stop, each x is searched in that range of places alone; the place is then within it (stop if none).
        """
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        x = x.astype(np.uint64)
        raw = x >> np.uint64(self.width)
        beyond = raw > np.uint64(self.top)
        high = np.minimum(raw, np.uint64(self.top)).astype(np.int64)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        end = self._select(high, False) - high
        want = x & np.uint64((1 << self.width) - 1)
        if first is not None:
            begin, end = np.clip(begin, first, stop), np.clip(end, first, stop)
        lo, hi = begin.copy(), end.copy()
        while (lo < hi).any():
            mid = (lo + hi) // 2
            less = (lo < hi) & (self._low(np.minimum(mid, self.n - 1)) < want)
            hi = np.where((lo < hi) & ~less, mid, hi)
            lo = np.where(less, mid + 1, lo)
        found = (lo < end) & ~beyond
        found &= self._low(np.minimum(lo, self.n - 1)) == want
        return np.where(beyond, self.n if stop is None else stop, lo), found


def dump(parts: dict[str, EliasFano | np.ndarray]) -> bytes:
    """One byte string of named levels; arrays begin at multiples of 8."""
    head, body, at = [], [], 0
    for name, part in parts.items():
        arrays = [part.low, part.high, part.ones] if isinstance(part, EliasFano) else [part]
        places = []
        for a in arrays:
            data = a.tobytes()
            places.append((at, len(a), a.dtype.str))
            body.append(data + bytes(-len(data) % 8))
            at += len(body[-1])
        head.append((name, (part.n, part.width, part.top) if isinstance(part, EliasFano) else None, places))
    text = repr(head).encode()
    return len(text).to_bytes(8, "little") + text + bytes(-len(text) % 8) + b"".join(body)


def load(data: bytes) -> dict[str, EliasFano | np.ndarray]:
    """The levels of dump(), through a memory map of an unnamed temporary file."""
    import ast

    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        mapped = np.memmap(f, np.uint8, "r")
    size = int.from_bytes(data[:8], "little")
    base = 8 + size + (-size % 8)
    out: dict = {}
    for name, ef, places in ast.literal_eval(data[8 : 8 + size].decode()):
        arrays = [mapped[base + at : base + at + n * np.dtype(t).itemsize].view(t) for at, n, t in places]
        out[name] = EliasFano(ef[0], ef[1], arrays[0], arrays[1], arrays[2], ef[2]) if ef else arrays[0]
    return out

"""Words of whole Arrow batches as NumPy arrays over their UTF-8 bytes.

Everything here works on all texts of a slice at once; slices bound the memory, whatever
the number and length of the texts in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import ship

ship(__name__)

#: Bytes of text that are worked on at once (one longer text is taken whole).
SLICE = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of some texts: each word's bytes are data[start:start + length], one space between words of a text."""

    data: np.ndarray  # uint8, with 32 spare bytes at the end
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray  # number of the text in the slice
    count: np.ndarray  # words of each text


def slices(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of a string column in slices of about SLICE bytes; nulls become empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int64)
        row = 0
        while row < len(chunk):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
            yield row, chunk.slice(row, end - row)
            row = end


def raw(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array."""
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = rows.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(rows: pa.Array, lower: bool = True) -> Words:
    """The words of the texts, separated by U+0020 and U+0009 to U+000D; with lower, A-Z in lower case."""
    data, offsets = raw(rows)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(32, np.uint8), none, none, none, np.zeros(len(rows), np.int64))
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | first[:-1]))
    length = np.flatnonzero(inside & (~after | first[1:])) + 1 - start
    text = np.searchsorted(offsets, start, "right") - 1
    at = np.cumsum(length + 1) - length - 1
    out = np.full(int(length.sum() + len(length)) + 32, 32, np.uint8)
    filled = np.ones(len(out) - 32, bool)
    filled[at + length] = False
    packed = data[inside]
    out[:-32][filled] = _LOWER[packed] if lower else packed
    return Words(out, at, length, text, np.bincount(text, minlength=len(rows)))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


#: Longer strings go to the xxhash library one by one.
_LONG = 4096


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:start + length] for each start, as uint64. data has 8 spare bytes at the end."""
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    four = np.ndarray((len(data) - 7,), "<u4", eight.base if eight.base is not None else data, strides=(1,))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), s + _P5, np.uint64)
        at = start.astype(np.int64).copy()
        wide = np.flatnonzero((length >= 32) & (length <= _LONG))
        if len(wide):
            wide = wide[np.argsort(-length[wide], kind="stable")]
            stripes, p = length[wide] // 32, at[wide]
            v = [np.full(len(wide), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for k in range(int(stripes[0])):
                m = int(np.searchsorted(-stripes, -k, "left"))  # those with more than k stripes come first
                for j in range(4):
                    v[j][:m] = _round(v[j][:m], eight[p[:m] + 32 * k + 8 * j])
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.zeros(1, np.uint64), x)) * _P1 + _P4
            h[wide] = acc
            at[wide] += 32 * stripes
        h += length.astype(np.uint64)
        rest = length % 32
        for k in range(3):
            i = np.flatnonzero(rest >= 8 * (k + 1))
            if len(i):
                h[i] = _rotl(h[i] ^ _round(np.zeros(1, np.uint64), eight[at[i]]), 27) * _P1 + _P4
                at[i] += 8
        i = np.flatnonzero(rest % 8 >= 4)
        h[i] = _rotl(h[i] ^ (four[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[i] += 4
        for k in range(3):
            i = np.flatnonzero(rest % 4 > k)
            h[i] = _rotl(h[i] ^ (data[at[i] + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]].tobytes(), seed)
    return h

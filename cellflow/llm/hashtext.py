"""Hashed features of texts, a bounded labelled sample of them, and sparse logistic training.

A document's features are its distinct words, the beginnings and the ends of these words, words
that follow themselves, and classes of its length and of its share of distinct words. Each counts
as often as distinct words have it, and is hashed into DIMENSIONS places.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import slices, words, xxh64
from .common import ship, text_of

ship(__name__)

DIMENSIONS = 1 << 18
#: Bytes of beginnings and ends of words.
BEGINNINGS, ENDS = (3, 4, 5, 6, 7), (1, 2, 3)


class Sparse(NamedTuple):
    """Feature places of some documents; document d has place[start[d]:start[d + 1]], as often as count says (None: once each)."""

    place: np.ndarray  # int32
    start: np.ndarray  # int64
    count: np.ndarray | None = None  # float32


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)


def features(rows: pa.Array, lower: bool = True) -> Sparse:
    """Features of the texts; a text without words has only those of its length."""
    w = words(rows, lower)
    n = len(rows)
    h = xxh64(w.data, w.start, w.length)
    same = np.flatnonzero((h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1]))
    again = w.text[same][np.unique(h[same] ^ _mix(w.text[same].astype(np.uint64), 3), return_index=True)[1]]
    order = np.lexsort((h, w.text))
    h, text, first = h[order], w.text[order], w.start[order]
    size = w.length[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
    h, text, first, size = h[new], text[new], first[new], size[new]
    distinct = np.bincount(text, minlength=n)
    eight = np.ndarray((len(w.data) - 7,), "<u8", np.ascontiguousarray(w.data), strides=(1,))
    parts = [_mix(h, 1)]
    for k in BEGINNINGS:
        mask = np.where(size >= k, np.uint64((1 << 8 * k) - 1), (np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1))
        parts.append(_mix(eight[first] & mask, 10 + k))
    for k in ENDS:
        at = first + np.maximum(size - k, 0)
        mask = (np.uint64(1) << (8 * np.minimum(size, k)).astype(np.uint64)) - np.uint64(1)
        parts.append(_mix(eight[at] & mask, 20 + k))
    shares = np.floor(10 * distinct / np.maximum(w.count, 1)).astype(np.uint64)
    lengths = np.floor(np.log2(w.count + 1)).astype(np.uint64)
    whole = [_mix(shares, 31), _mix(lengths, 32), _mix(shares * np.uint64(64) + lengths, 33)]
    owner = np.concatenate([np.tile(text, len(parts)), np.tile(np.arange(n), len(whole)), again])
    place = np.concatenate([*parts, *whole, np.full(len(again), 40, np.uint64)]).astype(np.int32)
    place = place[np.argsort(owner, kind="stable")]
    return Sparse(place, np.concatenate([[0], np.cumsum(distinct * len(parts) + len(whole) + np.bincount(again, minlength=n))]))


def merged(rows: Sparse) -> Sparse:
    """rows with each of a row's places once, and its count."""
    n = len(rows.start) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(rows.start))
    once, count = np.unique(owner * DIMENSIONS + rows.place, return_counts=True)
    return Sparse((once % DIMENSIONS).astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(once // DIMENSIONS, minlength=n))]), np.minimum(count, 65535).astype(np.float32))


def sizes(rows: Sparse) -> np.ndarray:
    """Features of each row, repeats counting."""
    return np.diff(rows.start).astype(np.float64) if rows.count is None else _row_sums(rows.count, rows.start)


def _row_sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[start[1:]] - total[start[:-1]]


def labelled_sample(docs: DataFrame, labels: DataFrame, stratum: Column, per_stratum: int) -> DataFrame:
    """doc_id, text and the columns of labels for at most per_stratum labelled rows of each stratum.

    The rows are those with the smallest hashes of doc_id, so the sample depends on the table alone.
    It is bounded by per_stratum times the number of strata, whatever the size of the input; strata are few.
    Of different labels of one id the smallest counts (by stratum and then by the other columns), and of
    different texts of one id that with the smallest hash.
    """
    told = [c for c in labels.columns if c != "doc_id"]
    chosen = labels.select("doc_id", *told, stratum.cast("string").alias("__stratum")).where("__stratum is not null and doc_id is not null")
    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct("__stratum", *told)).alias("label")).select("doc_id", "label", F.col("label.__stratum").alias("stratum"))
    chosen = chosen.withColumn("hash", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)))
    # of a stratum of n rows, the hashes below this share hold per_stratum rows but for a chance of nothing,
    # so no task sorts more than twice that
    sizes_ = {r["stratum"]: r["count"] for r in chosen.groupBy("stratum").count().collect()}
    limit = F.lit(1 << 30)
    for name, n in sizes_.items():
        if n > 2 * per_stratum + 200:
            limit = F.when(F.col("stratum") == name, int((1 << 30) * min(1.0, (1.5 * per_stratum + 100) / n))).otherwise(limit)
    first = Window.partitionBy("stratum").orderBy("hash", "doc_id")
    chosen = chosen.where(F.col("hash") < limit).withColumn("nth", F.row_number().over(first))
    chosen = chosen.where(F.col("nth") <= per_stratum).select("doc_id", "label")
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    once = found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return once.select("doc_id", "text", *[F.col(f"label.`{c}`").alias(c) for c in told])


class Collected(NamedTuple):
    rows: Sparse
    columns: dict[str, np.ndarray]


def collect_features(sample: DataFrame, columns: list[str], lower: bool = True) -> Collected:
    """Features and number columns of a bounded sample, on the driver, in order of doc_id."""

    def hashed(batches):
        for batch in batches:
            col = batch.column("text")
            for row, rows in slices(col):
                f = merged(features(rows, lower))
                pairs = list(zip(f.start[:-1], f.start[1:], strict=True))
                part = batch.slice(row, len(rows))
                packed = [pa.array([f.place[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([f.count[a:b].astype(np.uint16).tobytes() for a, b in pairs], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[part.column(c) for c in columns], *packed], ["doc_id", *columns, "__places", "__counts"])

    schema = ", ".join(["doc_id long", *[f"`{c}` double" for c in columns], "__places binary", "__counts binary"])
    got = sample.select(F.col("doc_id").cast("long"), "text", *[F.col(c).cast("double") for c in columns]).mapInArrow(hashed, schema).toArrow()
    ids = got.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    numbers = {c: got.column(c).to_numpy()[order] for c in columns}
    place, start = _flat(got.column("__places"), np.int32)
    count, _ = _flat(got.column("__counts"), np.uint16)
    del got
    return Collected(pick(Sparse(place, start, count.astype(np.float32)), order), numbers)


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in a binary column one after the other, and where each row's begin."""
    parts, sizes_ = [], []
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and chunk.buffers()[2] is not None:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind))
        sizes_.append(np.diff(offsets) // np.dtype(kind).itemsize)
    start = np.concatenate([[0], np.cumsum(np.concatenate(sizes_))]) if sizes_ else np.zeros(1, np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, kind), start.astype(np.int64)


def scores(rows: Sparse, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's features."""
    values = weights[rows.place]
    return _row_sums(values if rows.count is None else values * rows.count, rows.start)


def pick(rows: Sparse, which: np.ndarray) -> Sparse:
    """The rows numbered which."""
    size = np.diff(rows.start)[which]
    start = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(start[-1])
    at += np.repeat(rows.start[:-1][which] - start[:-1], size)
    return Sparse(rows.place[at], start, None if rows.count is None else rows.count[at])


def telling_places(rows: Sparse, y: np.ndarray, least: int, z: float, upward: bool = False) -> np.ndarray:
    """Mask of the places whose share of documents differs between y and not y by z standard errors.

    rows: merged(). Places of fewer than least documents are left out; upward: those too that fewer of y have.
    """
    times = np.diff(rows.start)
    n, n1 = len(y), int(y.sum())
    mask = np.zeros(DIMENSIONS, bool)
    if n1 in (0, n):
        return mask
    total = np.bincount(rows.place, minlength=DIMENSIONS).astype(float)
    inside = np.bincount(rows.place, np.repeat(y.astype(np.float32), times), DIMENSIONS)
    share = total / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / (n - n1)))
    found = (inside / n1 - (total - inside) / (n - n1)) / error
    found = found if upward else np.abs(found)
    found[total < least] = 0
    return mask | (found >= z)


def only(rows: Sparse, mask: np.ndarray) -> Sparse:
    """rows with the places of the mask alone, numbered from 0."""
    kept = mask[rows.place]
    upto = np.concatenate([[0], np.cumsum(kept)])
    number = np.cumsum(mask) - 1
    return Sparse(number[rows.place[kept]].astype(np.int32), upto[rows.start], None if rows.count is None else rows.count[kept])


def widened(weights: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Weights of all places from those of the mask's."""
    out = np.zeros(DIMENSIONS)
    out[mask] = weights
    return out


def gradient(rows: Sparse, slope: np.ndarray, size: int) -> np.ndarray:
    """Sum over rows of slope times features."""
    each = np.repeat(slope, np.diff(rows.start))
    return np.bincount(rows.place, each if rows.count is None else each * rows.count, size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))

"""Join a value of each distinct word back to texts by position.

Texts are split into words and gathered in blocks. A block sends each bucket of the word table
the distinct words that it has of that bucket, once; the bucket's task keeps a table of its
distinct words, works out the value of each new one, and answers the block with values in the
same order. The block's second part holds, for each position, only the number of the word in
that order, and the values are joined there. What travels is packed, so that shuffles stay
below the size of the input, and no word, however frequent, is more than one entry per block.

The input is read twice, once for either part. Parts meet by a block's content, so an input that
changes between the reads ends in an error and never in a wrong result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import xxh64
from .common import released, ship, tasks_for, text_of

ship(__name__)

#: Bytes of text after which a block is closed; a longer text is a block of its own.
BLOCK = 4 << 20
#: Numbers that are joined to a block's words at once (a longer text is taken whole).
AT_ONCE = 1 << 18
#: Distinct words that a task's table holds before it starts afresh (words are then worked out again).
TABLE = 1 << 20

_SCHEMA = "kind byte, key long, block long, payload binary"
_ARROW = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])


class Values(NamedTuple):
    """Numbers of some words: those of word w are flat[start[w]:start[w + 1]]."""

    flat: np.ndarray
    start: np.ndarray


class Block(NamedTuple):
    """Texts of a block: ids (null as None), number of words of each, and for each position the number of its word."""

    ids: list
    count: np.ndarray
    word: np.ndarray


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, byte by byte of all numbers: high bytes, which are mostly alike, lie together."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def _unpack(data, *types) -> list[np.ndarray]:
    """The first arrays of what _pack() made, of these types."""
    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    packed = int.from_bytes(raw[:8], "little")
    sizes = np.frombuffer(raw, np.int64, packed, 8)[: len(types)]
    ends = 8 * (packed + 1) + np.cumsum(sizes)
    parts = [np.frombuffer(raw[e - s : e], np.uint8) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return [np.ascontiguousarray(x.reshape(np.dtype(t).itemsize, -1).T).view(t).reshape(-1) for x, t in zip(parts, types, strict=True)]


def _rows(batches: Iterator[pa.RecordBatch], columns: int = 4) -> Iterator[tuple]:
    """The rows of batches; a payload is a view of its batch, and no list of all payloads is made."""
    for batch in batches:
        numbers = [batch.column(i).to_pylist() for i in range(columns - 1)]
        payload = batch.column(columns - 1)
        for i in range(len(batch)):
            yield *(n[i] for n in numbers), payload[i].as_buffer()


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _blocks(splitter: Callable[[], Callable[[str], list[str]]], buckets: int, want: str) -> Callable:
    """Worker: documents to blocks' rows; want is "words" or "counts" (one row per bucket; counts: with how often each word comes) or "texts" (one row)."""

    def close(ids, counts, index, seen):
        data = [w.encode() for w in seen]
        length = np.fromiter(map(len, data), np.int64, len(data))
        joined = b"".join(data)
        bucket = (xxh64(np.frombuffer(joined + bytes(32), np.uint8), np.cumsum(length) - length, length, 7) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        known = np.array([-1 if i is None else i for i in ids], np.int64)
        nulls = np.array([i is None for i in ids], bool)
        counts = np.array(counts, np.uint32)
        block = xxhash.xxh64_intdigest(known.tobytes() + nulls.tobytes() + counts.tobytes() + xxhash.xxh64_digest(joined), 1) - (1 << 63)
        if want == "texts":
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            word = rank[np.concatenate(index)] if index else np.zeros(0, np.uint32)
            return [(1, block, block, _pack(known, nulls, counts, word.astype(np.uint32), np.array([len(data)], np.int64)))]
        if not len(order):
            return []
        cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
        times = np.bincount(np.concatenate(index), minlength=len(data)).astype(np.uint32) if want == "counts" else None
        rows = []
        for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
            mine = order[a:b]
            more = [] if times is None else [times[mine]]
            rows.append((0, int(bucket[mine[0]]), block, _pack(length[mine].astype(np.uint32), np.frombuffer(b"".join(data[i] for i in mine), np.uint8), *more)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids, counts, index, seen, size = splitter(), [], [], [], {}, 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py()
                found = split(text)
                put = seen.setdefault
                index.append(np.fromiter((put(w, len(seen)) for w in found), np.uint32, len(found)))
                ids.append(i.as_py())
                counts.append(len(found))
                size += len(text)
                if size >= BLOCK:
                    rows = close(ids, counts, index, seen)
                    if rows:
                        yield _record(rows)
                    ids, counts, index, seen, size = [], [], [], {}, 0
        if ids and (rows := close(ids, counts, index, seen)):
            yield _record(rows)
        del split, ids, counts, index, seen
        released()

    return run


def words_of(payload, *more) -> tuple[list[bytes], list[np.ndarray]]:
    """The words that a block sent to a bucket, and what came with them."""
    length, data, *rest = _unpack(payload, np.uint32, np.uint8, *more)
    end, data = np.cumsum(length, dtype=np.int64), data.tobytes()
    return [data[b - n : b] for b, n in zip(end.tolist(), length.tolist(), strict=True)], rest


def _table(encoder: Callable[[], Callable[[list[str]], list]], number: type) -> Callable:
    """Worker of the word table: blocks' words to their values, each distinct word worked out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, bytes] = {}
        encode = encoder()
        wide = np.dtype(number).itemsize
        for _, bucket, block, payload in _rows(batches):
            words, _ = words_of(payload)
            new = [w for w in words if w not in table]
            if new:
                if len(table) > TABLE:
                    table, new = {}, words
                for w, v in zip(new, encode([w.decode() for w in new]), strict=True):
                    table[w] = np.asarray(v, number).tobytes()
            values = [table[w] for w in words]
            sizes = np.fromiter(map(len, values), np.uint32, len(values)) // wide
            yield _record([(0, block, bucket, _pack(sizes.astype(np.uint32), np.frombuffer(b"".join(values), np.uint8)))])
        del table, encode
        released()

    return run


def _joined(finisher: Callable[[], Callable[[Block, Values], pa.RecordBatch]], number: type) -> Callable:
    """Worker: a block's values, by bucket, and then its texts, to the result rows of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finish, of, parts, values = finisher(), None, {}, None
        for kind, key, bucket, payload in _rows(batches):
            if key != of:
                of, parts, values = key, {}, None
            if kind == 0:
                parts[bucket] = payload
                continue
            if values is None:
                sizes, flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
                for b in sorted(parts):  # a part is freed as it is unpacked
                    for have, found in zip((sizes, flat), _unpack(parts.pop(b), np.uint32, np.uint8), strict=True):
                        have.append(found)
                start = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
                del sizes
                values = Values(np.concatenate(flat).view(number), start)
                del flat
            known, nulls, counts, word, distinct = _unpack(payload, np.int64, bool, np.uint32, np.uint32, np.int64)
            if distinct[0] != len(values.start) - 1:
                raise RuntimeError("the documents changed between two reads: a block's words and texts don't match")
            # documents in slices: what a slice joins is bounded, unless one text is longer
            upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            size = np.concatenate([[0], np.cumsum((values.start[1:] - values.start[:-1]).astype(np.int32)[word], dtype=np.int64)])[upto] if len(word) else np.zeros(len(upto), np.int64)
            a = 0
            while a < len(counts):
                b = max(a + 1, int(np.searchsorted(size, size[a] + AT_ONCE, "right")) - 1)
                ids = [None if n else i for i, n in zip(known[a:b].tolist(), nulls[a:b].tolist(), strict=True)]
                yield finish(Block(ids, counts[a:b].astype(np.int64), word[upto[a] : upto[b]]), values)
                a = b
        del finish, parts, values
        released()

    return run


def gather(values: Values, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words one after the other, and where each word's begin (one more entry than words)."""
    sizes = (values.start[1:] - values.start[:-1])[word]
    start = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(start[-1])
    at += np.repeat(values.start[:-1][word] - start[:-1], sizes)
    return values.flat[at], start


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))


def ask(docs: DataFrame, splitter: Callable, buckets: int, want: str = "words") -> DataFrame:
    """Rows of the blocks of docs for the buckets of the word table, a bucket's rows in one partition."""
    return _texts(docs).mapInArrow(_blocks(splitter, buckets, want), _SCHEMA).repartitionById(buckets, F.col("key").cast("int"))


def answer(docs: DataFrame, asked: DataFrame, splitter: Callable, encoder: Callable, finisher: Callable, schema: str, buckets: int, number: type = np.uint16) -> DataFrame:
    """The rows of schema that the finisher makes of docs, given what ask() made of the same docs; see join_words()."""
    answers = asked.mapInArrow(_table(encoder, number), _SCHEMA)
    placed = _texts(docs).mapInArrow(_blocks(splitter, buckets, "texts"), _SCHEMA)
    met = answers.unionByName(placed).repartitionById(buckets, F.pmod("key", F.lit(buckets)).cast("int")).sortWithinPartitions("key", "kind", "block")
    return met.mapInArrow(_joined(finisher, number), schema)


def join_words(docs: DataFrame, splitter: Callable, encoder: Callable, finisher: Callable, schema: str, number: type = np.uint16, buckets: int | None = None) -> DataFrame:
    """Rows of schema that the finisher makes of docs (doc_id, text; a null text is empty), one slice of a block at a time.

    splitter(): a function from a text to its words, in order. encoder(): a function from distinct words to their numbers (of type number).
    finisher(): a function from a Block and the Values of its words to a record batch. All of them run on executors.
    docs is read twice and must give the same rows in the same partitions, as a scan does; what doesn't is to be stored first.
    """
    buckets = buckets or tasks_for(docs)
    return answer(docs, ask(docs, splitter, buckets), splitter, encoder, finisher, schema, buckets, number)

"""Near duplicates by SimHash fingerprints of 64 bits, with the pigeonring filter.

Bits are cut into a ring of five segments. If two fingerprints differ in at most two bits,
there is a segment from which on, for every length, the differences in that many consecutive
segments stay within their share of the two: none in the first two, one at most in the first
four. Distinct fingerprints meet where two consecutive segments are equal; the chain is then
followed, and only pairs that pass it get the full Hamming check. Where many fingerprints
share two segments, the chain's next step is looked up instead (the four segments equal, or with
one bit flipped), so that work stays linear in the group and the group is spread. Components come from linked pairs by
alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import slices, words, xxh64
from .common import discard, id_keys, one_row, ship, stored, text_of

ship(__name__)

SHINGLE, LINK = 3, 2
#: Starts and widths of the ring's segments, from the lowest bit.
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
#: More fingerprints than these that share two segments are met through the next two.
GROUP = 64
#: Shingles whose bits are counted at once.
BITS_AT_ONCE = 1 << 17


def _fingerprints_of(rows: pa.Array) -> np.ndarray:
    w = words(rows)
    n = len(rows)
    counts = np.zeros((n, 64), np.int64)
    end = w.start + w.length
    first = np.cumsum(w.count) - w.count
    # the shingle that starts at each word with two more after it, or the whole text if it has fewer words
    here = np.arange(len(w.start)) - first[w.text] if len(w.start) else np.zeros(0, np.int64)
    left = w.count[w.text] - here
    starts = np.flatnonzero((left >= SHINGLE) | ((here == 0) & (w.count[w.text] < SHINGLE)))
    last = np.minimum(starts + SHINGLE, (first + w.count)[w.text[starts]]) - 1
    h = xxh64(w.data, w.start[starts], end[last] - w.start[starts])
    text = w.text[starts]
    for a in range(0, len(h), BITS_AT_ONCE):
        bits = np.unpackbits(h[a : a + BITS_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        t = text[a : a + BITS_AT_ONCE]
        cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        counts[t[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    total = np.bincount(text, minlength=n)
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.int64, copy=False)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_fingerprints_of(rows) for _, rows in slices(batch.column("text"))]
        prints = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64), pa.int64())], ["doc_id", "fingerprint"])


def _hashed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, text, hash to doc_id, hash, fingerprint."""
    for batch in batches:
        (done,) = _fingerprint_batches(iter([batch]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), done.column("fingerprint")], ["doc_id", "hash", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a signed long) of each row; texts without words, empty or null get 0."""
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fingerprint long")


def _segment(prints: np.ndarray, i: int) -> np.ndarray:
    i %= 5
    return (prints >> np.uint64(STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


_ONES = np.array([bin(i).count("1") for i in range(1 << 13)], np.int8)


def _chain_pairs(prints: np.ndarray, ring: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (a, b), equal in segments ring and ring + 1, pass the chain and then the Hamming check."""
    ok = np.zeros(len(a), bool)
    diff = prints[a] ^ prints[b]
    for i in range(5):
        m = np.flatnonzero(ring[a] == i)
        if len(m):
            d = diff[m]
            upto4 = _ONES[_segment(d, i + 2)].astype(np.int16) + _ONES[_segment(d, i + 3)]
            ok[m] = (upto4 <= 1) & (upto4 + _ONES[_segment(d, i + 4)] <= LINK)
    return ok


_OUT = pa.schema([("kind", pa.int8()), ("ring", pa.int8()), ("head", pa.int64()), ("next", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _rows(kind, ring, head, nxt, a, b) -> pa.RecordBatch:
    n = len(a)
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n).copy())
    return pa.RecordBatch.from_arrays([full(kind, np.int8), full(ring, np.int8), full(head, np.int64), full(nxt, np.int64), full(a, np.int64), full(b, np.int64)], schema=_OUT)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ring, head, fingerprint) of groups of GROUP at most, sorted by (ring, head), to links (kind 0)."""
    carry = None  # the last group so far

    def groups(ring, head, prints):
        p = prints.view(np.uint64)
        for step in range(1, min(GROUP, len(p))):
            a = np.flatnonzero((ring[step:] == ring[:-step]) & (head[step:] == head[:-step]))
            if not len(a):
                break
            a = a[_chain_pairs(p, ring, a, a + step)]
            if len(a):
                yield _rows(0, 0, 0, 0, prints[a], prints[a + step])

    for batch in batches:
        ring, head, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if carry is not None:
            ring, head, prints = (np.concatenate(x) for x in zip(carry, (ring, head, prints), strict=True))
        if not len(ring):
            continue
        other = np.flatnonzero((ring != ring[-1]) | (head != head[-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        yield from groups(ring[:last], head[:last], prints[:last])
        carry = (ring[last:], head[last:], prints[last:])
    if carry is not None:
        yield from groups(*carry)


def _onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ring, head, fingerprint) of larger groups, in any order, to rows for the chain's next step (kind 1).

    Each comes under its next two segments (b 1), and under those with one bit flipped (b 0).
    """
    for batch in batches:
        ring, head, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        p = prints.view(np.uint64)
        for i in range(5):
            m = np.flatnonzero(ring == i)
            if not len(m):
                continue
            wide = WIDTHS[(i + 2) % 5]
            nxt = _segment(p[m], i + 2) | (_segment(p[m], i + 3) << np.uint64(wide))
            yield _rows(1, i, head[m], nxt.view(np.int64), prints[m], 1)
            for bit in range(wide + WIDTHS[(i + 3) % 5]):
                yield _rows(1, i, head[m], (nxt ^ np.uint64(1 << bit)).view(np.int64), prints[m], 0)


def _meet_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ring, head, next, home, fingerprint) sorted, homes first: links by lookups of the last segment.

    Homes that share all four segments differ in the last one, so there are at most 2 ** 13 of them at a time.
    """
    key, homes = None, {}
    balls = {}

    def ball(width: int, radius: int) -> list[int]:
        if (width, radius) not in balls:
            one = [1 << i for i in range(width)]
            balls[width, radius] = [0, *one] + ([x | y for k, x in enumerate(one) for y in one[k + 1 :]] if radius == 2 else [])
        return balls[width, radius]

    for batch in batches:
        a, b = [], []
        for ring, head, nxt, away, p in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if key != (ring, head, nxt):
                key, homes = (ring, head, nxt), {}
            i = (ring + 4) % 5
            last = (p >> STARTS[i]) & ((1 << WIDTHS[i]) - 1)
            if homes or not away:
                for flip in ball(WIDTHS[i], LINK - away):
                    q = homes.get(last ^ flip)
                    if q is not None and q != p:
                        a.append(p)
                        b.append(q)
            if not away:
                homes[last] = p
        yield _rows(0, 0, 0, 0, np.array(a, np.int64), np.array(b, np.int64))


_MET = "kind byte, ring byte, head long, next long, a long, b long"


def links(prints: DataFrame) -> DataFrame:
    """a, b: pairs of distinct fingerprints (column fingerprint, no repeats) that differ in at most two bits, each at least once.

    Groups are counted first. Small ones meet in a task; the members of large ones, wherever they are, go on to
    the chain's next step, so no task gets a large group.
    """
    p = F.col("fingerprint")
    seg = [F.shiftrightunsigned(p, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(STARTS, WIDTHS, strict=True)]
    heads = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("ring"), (seg[i] * F.lit(1 << 13) + seg[(i + 1) % 5]).alias("head")) for i in range(5)]))
    keyed = prints.select("fingerprint", heads.alias("k")).select(F.col("k.ring").alias("ring"), F.col("k.head").alias("head"), "fingerprint")
    keyed = keyed.withColumn("group", F.col("head") * 8 + F.col("ring"))
    sized = join_hot(keyed, keyed.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "group", "n")
    few = sized.where(F.col("n") <= GROUP).select("ring", "head", "fingerprint")
    met = few.repartition("ring", "head").sortWithinPartitions("ring", "head").mapInArrow(_meet, _MET).select("a", "b")
    more = sized.where(F.col("n") > GROUP).select("ring", "head", "fingerprint").mapInArrow(_onward, _MET)
    more = more.select("ring", "head", "next", (1 - F.col("b")).cast("int").alias("away"), "a")
    order = ["ring", "head", "next"]
    more = more.repartition(*order).sortWithinPartitions(*order, "away").mapInArrow(_meet_next, _MET)
    return met.unionByName(more.select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: smallest node that can be reached, for each node of edges (a, b); by large-star and small-star steps.

    The smallest neighbours are dealt anew before they meet the links, so that both sides of the join come straight from
    a shuffle: adaptive execution then splits the links of a node that has very many (its skew join needs that). A step's
    links are removed when the next ones are written.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")

    def smallest(links_: DataFrame, value) -> DataFrame:
        # a key that is not known to be u, so that it is dealt again
        return links_.groupBy("u").agg(value.alias("m")).select(F.col("u").bitwiseXOR(F.lit(0)).alias("k"), "m").hint("merge")

    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = both.join(smallest(both, F.least(F.min("v"), F.col("u"))), F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = big.join(smallest(big, F.min("v")), F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        old, edges = edges, stored(small.select("e.u", "e.v").where("u <> v").distinct(), "star")
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(prints: DataFrame) -> DataFrame:
    """prints (one row per fingerprint) with root: the smallest fingerprint that can be reached, its own if there is no other."""
    found = components(links(prints))
    return prints.join(found.withColumnRenamed("node", "fingerprint").hint("merge"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def cluster(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (long), component_id.

    component_id is the smallest doc_id among all rows whose fingerprints can be reached by steps of
    at most two bits (null ids are left out; null if there are no others). Rows without words share
    fingerprint 0. Other columns of docs are ignored; repeated rows give repeated rows.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    prints = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    rooted = _rooted(prints)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least.hint("merge"), "root").select("fingerprint", "component_id", "n")
    return join_hot(rows, of, "fingerprint", "n").select("doc_id", "fingerprint", "component_id")


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, size: str, share: float = 0.002, total: int | None = None) -> DataFrame:
    """rows joined with per_key (one row per key, size: rows of that key), the largest keys by broadcast.

    At most 1 / share keys can hold that share of the rows each; so few are sent to all tasks, and no task gets a large
    group. total: the sum of sizes, or any number above it, if it is known.
    """
    if total is None:
        total = per_key.agg(F.sum(size)).first()[0] or 0
    least = max(1, -int(-total * share // 1))
    hot = per_key.where(F.col(size) >= least)
    cold = rows.join(hot.select(key).hint("broadcast"), key, "left_anti").join(per_key.where(F.col(size) < least).hint("merge"), key)
    return cold.unionByName(rows.join(hot.hint("broadcast"), key))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all columns: that with the smallest doc_id, null ids last, then the smallest hash of its text.

    Of rows repeated with that id and text, one stays (see one_row()). Texts are shuffled once.
    """
    hashed = F.xxhash64(text_of()).alias("hash")
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), hashed).mapInArrow(_hashed_batches, "doc_id long, hash long, fingerprint long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")
    rooted = _rooted(stored(rows.groupBy("fingerprint").agg(first), "distinct-fingerprints"))
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.hash").select("hash", *id_keys())
    return one_row(docs, *id_keys(), hashed).join(keep.hint("merge"), ["none", "id", "hash"], "left_semi").select("row.*")

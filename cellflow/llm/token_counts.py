"""Token counts under a unigram model of published pieces, by dynamic programming over a trie of words.

A word's best segmentation has the greatest product of its pieces' probabilities. Words enter the
trie in sorted order, which is its depth-first order, so only the path to the last word is held: the
forward score of a prefix is worked out once, when the first of the words that share it comes, and
the end of a word gives its number of pieces. The pieces are those of a public vocabulary; their
probabilities are trained on the whole corpus, by rounds of counting the pieces of best
segmentations over the table of distinct words.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordtable
from .bpe import splitter
from .common import released, ship, stored, tasks_for

ship(__name__)

#: Costs are whole numbers of 1 / STEPS of -ln p. Training begins with a Zipf-Mandelbrot law over the ranks, and ADD is added to counts.
STEPS, SHIFT, ADD, ROUNDS = 1000, 27, 0.1, 2
#: Of equally cheap segmentations the one with fewest pieces counts, of these that with the shortest last piece: a piece adds 1 below this unit.
UNIT = 1 << 32
#: Bytes of a path whose scores are held; of what follows in a longer word only the scores that a piece can reach back to.
DEEP = 4096
#: Distinct words that a task gathers before it passes them on.
TABLE = 1 << 18


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a rank file (base64 piece, rank), by rank; all single bytes must be there."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no pieces for bytes {missing}")
    return sorted(ranks, key=ranks.get)


def zipf_costs(pieces: list[bytes]) -> dict[bytes, int]:
    """Cost of each piece before training, 1 included."""
    return {p: round(STEPS * math.log(r + SHIFT)) * UNIT + 1 for r, p in enumerate(pieces)}


def trained_costs(pieces: list[bytes], counts: dict[int, int]) -> dict[bytes, int]:
    """Cost of each piece from counts by rank, 1 included."""
    total = math.log(sum(counts.values()) + ADD * len(pieces))
    return {p: max(1, round(STEPS * (total - math.log(counts.get(r, 0) + ADD)))) * UNIT + 1 for r, p in enumerate(pieces)}


class Trie:
    """The path to the last word in a trie of words: the cost of the best segmentation of each prefix and its last piece's length."""

    def __init__(self, costs: dict[bytes, int]):
        self.longest = max(map(len, costs))
        self.back: dict = {}  # pieces from their ends: a dictionary by byte, with the cost of the piece that begins here at -1
        for piece, cost in costs.items():
            node = self.back
            for b in reversed(piece):
                node = node.setdefault(b, {})
            node[-1] = cost
        self.word, self.upto, self.lasts, self.scored = b"", [0], array("H", [0]), 0

    def forward(self, word: bytes) -> int:
        """Cost of the best segmentation of word. Words in sorted order share the scores of their common beginnings."""
        same, back = 0, self.back
        for a, b in zip(word[:DEEP], self.word, strict=False):
            if a != b:
                break
            same += 1
        upto, lasts, first = self.upto, self.lasts, 0
        del upto[same + 1 :], lasts[same + 1 :]
        self.scored += len(word) - same
        held = None
        for end in range(same + 1, len(word) + 1):
            node, at, best, last = back, end, None, 1
            while at > 0:
                at -= 1
                node = node.get(word[at])
                if node is None:
                    break
                cost = node.get(-1)
                if cost is not None:
                    cost += upto[at - first]
                    if best is None or cost < best:
                        best, last = cost, end - at
            if held is None and end > DEEP:
                held = upto
                first = max(0, end - self.longest)
                upto = held[first:]
            elif held is not None and len(upto) > 8 * self.longest:
                first += len(upto) - self.longest
                del upto[: -self.longest]
            upto.append(best)
            lasts.append(last)
        self.word = word[:DEEP]
        return upto[-1]

    def count(self, word: bytes) -> int:
        """Pieces in the best segmentation of word; 0 for an empty one."""
        return self.forward(word) % UNIT

    def pieces(self, word: bytes) -> Iterator[bytes]:
        """The pieces of the best segmentation of word, from the last."""
        self.forward(word)
        end = len(word)
        while end:
            yield word[end - self.lasts[end] : end]
            end -= self.lasts[end]


def _encoder(costs: dict[bytes, int]):
    def make():
        trie = Trie(costs)

        def counts(words: list[str]) -> list:
            data = [w.encode() for w in words]
            out = [None] * len(data)
            for i in sorted(range(len(data)), key=data.__getitem__):
                out[i] = (trie.count(data[i]),)
            return out

        return counts

    return make


def _finisher():
    def finish(block: wordtable.Block, values: wordtable.Values) -> pa.RecordBatch:
        upto = np.concatenate([[0], np.cumsum(values.flat[block.word], dtype=np.int64)])
        cut = np.concatenate([[0], np.cumsum(block.count)])
        return pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(block.count), pa.array(upto[cut[1:]] - upto[cut[:-1]])], ["doc_id", "n_words", "n_tokens"])

    return finish


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker: blocks' rows to distinct words with counts."""
    seen = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "times"])

    for *_, payload in wordtable._rows(batches):
        words, (times,) = wordtable.words_of(payload, np.uint32)
        for w, n in zip(words, times.tolist(), strict=True):
            seen[w] += n
        if len(seen) > TABLE:
            yield rows()
            seen.clear()
    if seen:
        yield rows()
    del seen
    released()


def _piece_counts(costs: dict[bytes, int]):
    """Worker: distinct words with counts, sorted, to ranks of pieces (by their order in costs) with counts in best segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, found = Trie(costs), Counter()
        for batch in batches:
            for word, times in zip(batch.column("word").to_pylist(), batch.column("times").to_pylist(), strict=True):
                for piece in trie.pieces(word):
                    found[piece] += times
        rank = {p: i for i, p in enumerate(costs)}
        yield pa.RecordBatch.from_arrays([pa.array([rank[p] for p in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["piece", "times"])
        del trie, found, rank
        released()

    return run


def train(words: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> dict[bytes, int]:
    """Costs of the pieces from distinct words with counts (word binary, times long), best sorted. A count for each piece reaches the driver, whatever the input."""
    costs = zipf_costs(pieces)
    for _ in range(rounds):
        found = words.mapInArrow(_piece_counts(costs), "piece long, times long").groupBy("piece").agg(F.sum("times").alias("times"))
        costs = trained_costs(pieces, {r["piece"]: r["times"] for r in found.collect()})
    return costs


def count(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens: words (pre-tokens) of each whole text and pieces in their best segmentations.

    path: a rank file of byte pieces, whose probabilities are trained on all of docs. One row per
    row of docs, repeated rows included and trained on as often as they come; null and empty texts
    have no words. Other columns of docs are ignored. docs must give the same rows in the same
    partitions each time it is read (see join_words()).
    """
    pieces, split, buckets = read_pieces(path), splitter(None, []), tasks_for(docs)
    asked = stored(wordtable.ask(docs, split, buckets, "counts"), "token-words")
    # in ranges of words, so that those with a common beginning meet in a task
    words = asked.mapInArrow(_distinct, "word binary, times long").repartitionByRange(buckets, "word").groupBy("word").agg(F.sum("times").alias("times"))
    words = stored(words.sortWithinPartitions("word"), "distinct-words")
    return wordtable.answer(docs, asked, split, _encoder(train(words, pieces)), _finisher, "doc_id long, n_words long, n_tokens long", buckets, np.uint32)

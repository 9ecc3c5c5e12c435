"""Scores of texts under a bigram model kept in Elias-Fano tries.

Counts are smoothed by a Dirichlet prior: p(w | c) = (n(c w) + PRIOR p(w)) / (n(c) + PRIOR), where
p(w) is the additive unigram model. The trie of a shard holds some contexts with all their seen
successors and quantised log probabilities: p(w | c) of seen pairs, PRIOR / (n(c) + PRIOR) of
contexts and p(w) of words, with which unseen pairs are scored.

Texts are gathered in blocks, which ask twice and join the answers by position. Words: a block
sends the counts of its distinct words to the words' buckets, which answer with counts over the
whole corpus and a number for each word. Pairs: a block, now knowing those counts, sends its distinct pairs, each once with its
training count, to the contexts' shards; a shard adds the counts up, builds its trie and answers with
a score for each pair. A pair of any frequency is one entry per block. A context that is too
frequent for one shard is spread over all by its successors, which smoothing by a prior allows, as it
needs nothing of the other successors.

Words are told apart by 64-bit hashes, and known by their numbers from then on. Sums of log probabilities are whole numbers of STEPs,
so results don't depend on the order of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import slices, words, xxh64
from .common import released, ship, stored, tasks_for, text_of
from .eliasfano import EliasFano, dump, load
from .wordtable import _pack, _rows, _unpack

ship(__name__)

#: Strength of the prior, in observations.
PRIOR = 30.0
#: Added to counts in the unigram model.
ADD = 0.1
#: Quantised log10 probabilities are whole numbers of 1 / STEPS, 16 bits each.
STEPS = 2048
#: Bytes of text after which a block is closed; a longer text is a block of its own.
BLOCK = 8 << 20
#: The token after each text, which is also the context of its first word.
END = np.uint64(0x9D5C1A2F00E17D03)

_SCHEMA = "kind byte, key long, block long, payload binary"
_ARROW = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def held_out(doc_id) -> bool:
    """Whether a document is left out of training: CRC-32 of its id as text, modulo 10, is 0 (null: of an empty text)."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def _blocks(buckets: int, want: str):
    """Worker: documents to blocks' rows; want is "words" (distinct words by bucket, with training counts) or "texts"."""

    def close(ids, counts, tokens):
        token, count = np.concatenate(tokens), np.concatenate(counts)
        known = np.array([-1 if i is None else i for i in ids], np.int64)
        nulls = np.array([i is None for i in ids], bool)
        held = np.array([held_out(i) for i in ids], bool)
        block = xxhash.xxh64_intdigest(known.tobytes() + nulls.tobytes() + token.tobytes(), 2) - (1 << 63)
        distinct, number = np.unique(token, return_inverse=True)
        bucket = (distinct >> np.uint64(11)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        if want == "texts":
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            sizes = np.array([len(order), rank[np.searchsorted(distinct, END)]], np.int64)
            return [(1, block, block, _pack(known, nulls, held, count.astype(np.uint32), rank[number].astype(np.uint32), sizes))]
        trained = np.bincount(number[~np.repeat(held, count)], minlength=len(distinct)).astype(np.uint32)
        cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
        return [(0, int(bucket[order[a]]), block, _pack(distinct[order[a:b]], trained[order[a:b]])) for a, b in zip(cut, [*cut[1:], len(order)], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, tokens, size = [], [], [], 0
        for batch in batches:
            for row, rows in slices(batch.column("text")):
                w = words(rows)
                h = xxh64(w.data, w.start, w.length, 11)
                token = np.full(len(h) + len(rows), END, np.uint64)
                token[np.arange(len(h)) + w.text] = h
                ids += batch.column("doc_id").slice(row, len(rows)).to_pylist()
                counts.append(w.count + 1)
                tokens.append(token)
                size += len(w.data)
                if size >= BLOCK:
                    yield _record(close(ids, counts, tokens))
                    ids, counts, tokens, size = [], [], [], 0
        if ids:
            yield _record(close(ids, counts, tokens))
        del ids, counts, tokens
        released()

    return run


def _steps(rising: np.ndarray) -> np.ndarray:
    """Rising numbers as differences, which pack well."""
    return np.diff(rising, prepend=0).astype(np.uint32)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker: rows of buckets, sorted by bucket, to blocks' answers (kind 0: counts and numbers within the bucket, as steps) and the
    bucket's totals (kind 2: trained words, their occurrences; bucket and all words)."""

    def answer(rows):
        parts = [_unpack(p, np.uint64, np.uint32) for _, p in rows]
        word, number = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.zeros(len(word), np.int64)
        np.add.at(total, number, np.concatenate([p[1] for p in parts]).astype(np.int64))
        at = 0
        for (block, _), (own, _) in zip(rows, parts, strict=True):
            mine = number[at : at + len(own)]
            yield (0, block, key, _pack(total[mine], _steps(mine)))
            at += len(own)
        yield (2, int((total > 0).sum()), int(total.sum()), _pack(np.array([key, len(word)], np.int64)))

    key, rows = None, []
    for _, bucket, block, payload in _rows(batches):
        if rows and bucket != key:
            yield _record(list(answer(rows)))
            rows = []
        key = bucket
        rows.append((block, payload))
    if rows:
        yield _record(list(answer(rows)))
    del rows
    released()


def _log(count: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of the unigram probability of words with these training counts."""
    return np.log10((count + ADD) / (total + ADD * (distinct + 1)))


def _quantised(x: np.ndarray) -> np.ndarray:
    """Log probabilities in steps, as what is taken from 0 (16 bits)."""
    return np.clip(np.rint(-x * STEPS), 0, 65535).astype(np.uint16)


class Block:
    """A block's texts; words are known by their place among the block's distinct words."""

    def __init__(self, payload):
        self.known, self.nulls, self.held, count, self.word, (self.size, self.end) = _unpack(payload, np.int64, bool, bool, np.uint32, np.uint32, np.int64)
        self.count = count.astype(np.int64)
        self.first = np.cumsum(self.count) - self.count  # every text has its end at least

    def codes(self) -> np.ndarray:
        """The pair at each token as context * words + word; the context of a text's first token is the end."""
        context = np.empty(len(self.word), np.uint64)
        context[1:] = self.word[:-1]
        context[self.first] = self.end
        context *= np.uint64(self.size)
        context += self.word
        return context

    def dealt(self, pairs: np.ndarray, ids: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context and word of pairs, their order by shard, and where each shard's begin in it. ids: the words' numbers; hot: whether each is a hot context."""
        n = np.uint64(self.size)
        context, word = (pairs // n).astype(np.int64), (pairs % n).astype(np.int64)
        mixed = ids.astype(np.uint64)[context] * np.uint64(0x9E3779B97F4A7C15)
        spread = np.flatnonzero(hot[context])
        mixed[spread] ^= ids.astype(np.uint64)[word[spread]] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        shard = (mixed % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.uint32)
        order = np.argsort(shard, kind="stable")
        return context, word, order, np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _ask_pairs(total: int, distinct: int, offsets: dict[int, int], shards: int):
    """For a block, given its rows of word counts and of texts: a row of base figures (kind 0) and its pairs by shard (kind 1).

    offsets: the number of each bucket's first word, so that numbers rise with a block's words.
    """
    # a context with more training tokens than half a shard's share is spread by successor
    most = max(1, total // (2 * shards))

    def rows(counts: pa.Table, texts: pa.Table) -> pa.Table:
        out = []
        answers = dict(zip(counts.column("block").to_pylist(), counts.column("payload"), strict=True))
        seen = None
        for key, payload in zip(texts.column("key").to_pylist(), texts.column("payload"), strict=True):  # equal blocks have a row each
            block = Block(payload.as_buffer())
            if seen is None:
                parts = [(offsets[b], *_unpack(answers[b].as_buffer(), np.int64, np.uint32)) for b in sorted(answers)]
                seen, ids = np.concatenate([p[1] for p in parts]), np.concatenate([p[0] + np.cumsum(p[2], dtype=np.int64) for p in parts])
            if len(seen) != block.size:
                raise RuntimeError("the documents changed between two reads: a block's words and texts don't match")
            c = seen[block.word]
            base = np.add.reduceat(_log(c, total, distinct), block.first)
            in_training = np.add.reduceat((c > 0).astype(np.int64), block.first)
            hot = seen > most
            out.append((0, key, 0, _pack(in_training, base, hot, np.diff(ids, prepend=0))))
            del c
            # a pair and whether its text is held out are sorted together, so one sort gives pairs and training counts
            code = block.codes() << np.uint64(1)
            code |= np.repeat(block.held, block.count)
            code.sort()
            at = np.flatnonzero(np.concatenate([[True], (code[1:] >> np.uint64(1)) != (code[:-1] >> np.uint64(1))]))
            n = np.add.reduceat(1 - (code & np.uint64(1)).astype(np.int64), at)
            context, word, order, cut = block.dealt(code[at] >> np.uint64(1), ids, hot, shards)
            del code, at
            for s in np.flatnonzero(np.diff(cut)):
                own = order[cut[s] : cut[s + 1]]
                contexts, per = np.unique(context[own], return_counts=True)
                successors, place = np.unique(word[own], return_inverse=True)
                out.append((1, int(s), key, _pack(np.diff(ids[contexts], prepend=0), seen[contexts], per.astype(np.uint32), np.diff(ids[successors], prepend=0), seen[successors], place.astype(np.uint32), n[own].astype(np.uint32))))
        return pa.Table.from_batches([_record([r]) for r in out], _ARROW)

    return rows


def build_trie(contexts: np.ndarray, n_context: np.ndarray, words_: np.ndarray, n_word: np.ndarray, pair_context: np.ndarray, pair_word: np.ndarray, n: np.ndarray, total: int, distinct: int) -> bytes:
    """A shard's trie. contexts and words_: rising numbers with training counts; pairs: rising places in those, with counts.

    The successors of a context are its words' places plus an offset, the last successor of the context before, so that
    the whole level rises and each range can be read relative to its context.
    """
    pointers = np.searchsorted(pair_context, np.arange(len(contexts) + 1))
    last = np.zeros(len(contexts) + 1, np.uint64)
    full = np.flatnonzero(np.diff(pointers))
    last[full + 1] = pair_word[pointers[full + 1] - 1].astype(np.uint64) + np.uint64(1)
    successors = pair_word.astype(np.uint64) + np.cumsum(last, dtype=np.uint64)[pair_context]
    unigram = _log(n_word, total, distinct)
    smoothed = np.log10((n + PRIOR * 10 ** unigram[pair_word]) / (n_context[pair_context] + PRIOR))
    return dump({
        "words": EliasFano.build(words_), "word_log": _quantised(unigram),
        "contexts": EliasFano.build(contexts), "context_log": _quantised(np.log10(PRIOR / (n_context + PRIOR))),
        "pointers": EliasFano.build(pointers.astype(np.uint64)),
        "successors": EliasFano.build(successors), "pair_log": _quantised(smoothed),
    })


def query_trie(trie: dict, contexts: np.ndarray, per: np.ndarray, words_: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Quantised -log10 p(word | context), for per[i] pairs of each contexts[i], whose words are words_[place].

    Each context and each word is looked up once; a pair is then searched in its context's range of the successors alone.
    All contexts and words asked for must be in the trie, with or without pairs.
    """
    ci, known = trie["contexts"].successor(contexts)
    wi, known_w = trie["words"].successor(words_)
    if not (known.all() and known_w.all()):
        raise KeyError("a context or word that the trie does not have")
    out = np.repeat(trie["context_log"][ci].astype(np.int64), per) + trie["word_log"][wi][place]
    if trie["successors"].n:
        begin, end = (trie["pointers"].get(ci + k).astype(np.int64) for k in (0, 1))
        offset = np.where(begin > 0, trie["successors"].get(np.maximum(begin - 1, 0)) + np.uint64(1), np.uint64(0))
        # the offset of the first range that is not empty is 0, all others begin after the last successor before them
        found_at, found = trie["successors"].successor(wi[place].astype(np.uint64) + np.repeat(offset, per), np.repeat(begin, per), np.repeat(end, per))
        out[found] = trie["pair_log"][found_at[found]]
    return out


def _score(total: int, distinct: int):
    """Worker: rows of shards, sorted by shard, to answers: a score for each pair that was asked (kind 1, by block). Other rows pass."""
    types = (np.int64, np.int64, np.uint32, np.int64, np.int64, np.uint32, np.uint32)

    def asked(payload):
        c, n_context, per, w, n_word, place, n = _unpack(payload, *types)
        return np.cumsum(c), n_context, per, np.cumsum(w), n_word, place, n

    def known(rows, at):
        """Distinct numbers of field at, rising, and their counts (field at + 1)."""
        parts = [asked(p)[at : at + 2] for _, p in rows]
        numbers, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        return numbers, np.concatenate([p[1] for p in parts])[first]

    def trie_of(rows):
        (contexts, n_context), (words_, n_word) = known(rows, 0), known(rows, 3)
        codes, counts = [], []
        for _, payload in rows:
            c, _, per, w, _, place, n = asked(payload)
            code = np.repeat(np.searchsorted(contexts, c).astype(np.uint64) * np.uint64(len(words_)), per) + np.searchsorted(words_, w).astype(np.uint64)[place]
            seen = n > 0
            codes.append(code[seen])
            counts.append(n[seen])
        code, count = np.concatenate(codes), np.concatenate(counts)
        del codes, counts
        order = np.argsort(code, kind="stable")
        code, count = code[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        n = np.add.reduceat(count.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        code = code[at]
        size = np.uint64(len(words_))
        return build_trie(contexts, n_context, words_, n_word, (code // size).astype(np.int64), (code % size).astype(np.int64), n, total, distinct)

    def answer(shard, rows):
        trie = load(trie_of(rows))
        for block, payload in rows:
            c, _, per, w, _, place, _ = asked(payload)
            score = query_trie(trie, c, per, w, place)
            yield _record([(1, block, shard, _pack(score.astype(np.uint16), (score >> 16).astype(np.uint8)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for kind, key, block, payload in _rows(batches):
            if kind == 0:
                yield _record([(0, key, block, payload.to_pybytes())])
                continue
            if rows and key != shard:
                yield from answer(shard, rows)
                rows = []
            shard = key
            rows.append((block, payload))
        if rows:
            yield from answer(shard, rows)
        del rows
        released()

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _add_up(shards: int):
    """For a block, given its base row, the answers of all shards, and its texts: result rows."""

    def rows(answers: pa.Table, texts: pa.Table) -> pa.Table:
        base, parts = None, {}
        for kind, shard, payload in zip(answers.column("kind").to_pylist(), answers.column("block").to_pylist(), answers.column("payload"), strict=True):
            if kind == 0:
                base = payload
            else:
                parts[shard] = payload
        out = []
        for payload in texts.column("payload"):
            block = Block(payload.as_buffer())
            in_training, unigram, hot, ids = _unpack(base.as_buffer(), np.int64, np.float64, bool, np.int64)
            pairs, place = np.unique(block.codes(), return_inverse=True)
            _, _, order, _ = block.dealt(pairs, np.cumsum(ids), hot, shards)
            score = np.empty(len(pairs), np.int64)
            found = [_unpack(parts[s].as_buffer(), np.uint16, np.uint8) for s in sorted(parts)]
            score[order] = np.concatenate([f[0] for f in found]).astype(np.int64) + (np.concatenate([f[1] for f in found]).astype(np.int64) << 16)
            sums = np.add.reduceat(score[place], block.first)
            ids = pa.array([None if n else i for i, n in zip(block.known.tolist(), block.nulls.tolist(), strict=True)], pa.int64())
            out.append(pa.RecordBatch.from_arrays([ids, pa.array(block.held), pa.array(block.count), pa.array(in_training), pa.array(unigram), pa.array(-sums / STEPS)], schema=_RESULT))
        return pa.Table.from_batches(out, _RESULT)

    return rows


def score(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of a text, A-Z in lower case, and an end; a null text counts as empty and
    has the end alone. Rows whose id leaves no remainder (see held_out()) are scored only, all
    others are trained on too, repeated rows as often as they come. n_known: tokens seen in
    training; train_tokens: tokens of training; base_score: the unigram model's log10 probability
    of the text; score: the bigram model's. With no training rows both are those of an even
    distribution over one word. Other columns of docs are ignored. docs is read twice and must
    give the same rows in the same partitions, as a scan does: a changed block is an error.
    """
    buckets = buckets or tasks_for(docs)
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    asked = texts.mapInArrow(_blocks(buckets, "words"), _SCHEMA).repartitionById(buckets, F.col("key").cast("int")).sortWithinPartitions("key", "block")
    counted = stored(asked.mapInArrow(_count_words, _SCHEMA), "lm-counts")
    sums = counted.where("kind = 2").select("key", "block", "payload").collect()  # one small row for each bucket
    distinct, total = sum(r["key"] for r in sums), sum(r["block"] for r in sums)
    sizes = dict(_unpack(bytes(r["payload"]), np.int64)[0].tolist() for r in sums)
    offsets, at = {}, 0
    for bucket in sorted(sizes):
        offsets[bucket], at = at, at + sizes[bucket]
    placed = texts.mapInArrow(_blocks(buckets, "texts"), _SCHEMA)
    pairs = counted.where("kind = 0").groupBy("key").cogroup(placed.groupBy("key")).applyInArrow(_ask_pairs(total, distinct, offsets, buckets), _SCHEMA)
    # base figures pass through the shards' step, so that the pairs are made once; the blocks' texts are shuffled once for both steps
    met = pairs.repartitionById(buckets, F.pmod("key", F.lit(buckets)).cast("int")).sortWithinPartitions("kind", "key", "block")
    answers = met.mapInArrow(_score(total, distinct), _SCHEMA)
    out = answers.groupBy("key").cogroup(placed.groupBy("key")).applyInArrow(_add_up(buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

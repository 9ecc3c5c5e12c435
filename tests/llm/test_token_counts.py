import collections
import time

import public_tokenizers

from cellflow.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = token_counts.read_pieces(PATH)


def plain(costs, word, ends=None):
    """Number of pieces in the best segmentation of word; ends: takes the pieces."""
    best, back = [0] + [None] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for s in range(end - 1, -1, -1):
            c = costs.get(word[s:end])
            if c is not None and (best[end] is None or best[s] + c < best[end]):
                best[end], back[end] = best[s] + c, s
    if ends is not None:
        end = len(word)
        while end:
            ends.append(word[back[end] : end])
            end = back[end]
    return best[-1] % token_counts.UNIT


def plain_costs(texts):
    split, costs = bpe.splitter(None, [])(), token_counts.zipf_costs(PIECES)
    words = collections.Counter(w.encode() for t in texts for w in split(t or ""))
    for _ in range(token_counts.ROUNDS):
        counts = collections.Counter()
        for w, n in words.items():
            pieces = []
            plain(costs, w, pieces)
            for p in pieces:
                counts[PIECES.index(p)] += n
        costs = token_counts.trained_costs(PIECES, counts)
    return costs


def test_trie_counts_like_a_plain_search(monkeypatch):
    costs = token_counts.zipf_costs(PIECES)
    words = [w.encode() for w in ["", " the", " there", " then", "ththeanand", "Übermaß", "x" * 300, "x" * 290 + "y", "ab" * 700, "ab" * 600, "-" * 900, "a\x00b", " " * 90, "the"]]
    for deep in (4096, 250, 3):
        monkeypatch.setattr(token_counts, "DEEP", deep)
        trie = token_counts.Trie(costs)
        for w in words + sorted(words):
            pieces = []
            assert trie.count(w) == plain(costs, w, pieces)
            assert list(trie.pieces(w)) == pieces


def test_prefixes_are_shared_and_long_words_are_linear():
    trie = token_counts.Trie(token_counts.zipf_costs(PIECES))
    for w in (b"sharedprefix", b"sharedprefixed", b"sharedprefixes"):
        trie.count(w)
    assert trie.scored == 12 + 2 + 1
    for w in (b"qwertyuiop" * 100_000, b"-" * 300_000):
        began = time.perf_counter()
        trie.count(w)
        assert time.perf_counter() - began < 30 and len(trie.upto) <= token_counts.DEEP + 2


def test_counts_of_documents(docs):
    texts = ["the cat sat on the mat", None, "", "the cat sat on the mat", "émigré naïve — 10,000 £", "x" * 2000, "the then there thing thinking " * 20]
    costs, split = plain_costs(texts), bpe.splitter(None, [])()
    frame = docs(texts).selectExpr("*", "1 AS word", "2 AS times", "3 AS key", "4 AS n_words")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count(frame, PATH).collect()}
    assert got == {i: (len(split(t or "")), sum(plain(costs, w.encode()) for w in split(t or ""))) for i, t in enumerate(texts)}
    assert token_counts.count(docs([]), PATH).count() == 0
    assert [r["n_tokens"] for r in token_counts.count(docs([(None, "a b"), (None, None)]), PATH).orderBy("n_tokens").collect()] == [0, 2]

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cellflow.llm import bpe, wordtable

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", None, " ", "\n\n x", "a  b   c\t\n", "it's we'll I'd'  ''s !!'s 'S", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext",
    "Ünïcödé ﬁne ½ ² Ⅷ ٣", "汉字 かな 한국어 😀👩‍👩‍👧", "՘࢏ x౜ 1꟎꭬2 \U00010940 \U0003d000", "\x1c\x1d a\x1e\x1fb", "\x00\x01", "   　x\u0085y",
    "x" * 5000, "a b " * 3000, "0123456789" * 20,
]


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_words_concatenate_and_split_like_the_tokenizer():
    model, special = bpe._model(PATH)
    split = bpe.splitter(model, special)()
    tokenizer = Tokenizer.from_file(PATH)
    for text in HARD:
        assert "".join(split(text or "")) == (text or "")
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x3000), rng.choice(b" \n'\t"), rng.randrange(0xA000, 0xD000)])) for _ in range(40))
        assert split(text) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_digests_match_the_tokenizer(docs, monkeypatch):
    monkeypatch.setattr(wordtable, "BLOCK", 3000)  # several blocks
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i % 11 if i % 7 else None, t) for i, t in enumerate(HARD * 2)]
    got = bpe.digests(docs(rows).selectExpr("*", "1 AS key", "2 AS ids"), PATH).collect()
    want = []
    for i, t in rows:
        ids, text = expected(tokenizer, t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_round_trip_and_empty_table(docs):
    rows = [(i, t) for i, t in enumerate(HARD)]
    for r in bpe.encode(docs(rows), PATH).collect():
        assert r["decoded"] == (HARD[r["doc_id"]] or "")
    assert bpe.encode(docs([]), PATH).count() == 0

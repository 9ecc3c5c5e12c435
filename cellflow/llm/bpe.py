"""Byte-pair encoding through a table of distinct words, and decoding through a table of pieces."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import wordtable
from .common import ship

ship(__name__)

#: How the tokenizer splits text before its merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Outside of these ranges the tokenizer's Unicode tables may differ from the regex package's, and it splits texts itself.
SURE = "\\x00-\\u0557\\u0590-\\u087f\\u2010-\\u2070\\u20a0-\\u20bf\\u3000-\\ua000\\uac00-\\ud7a3\\uf900-\\uffef\\U0001f300-\\U0001f9ff"


def _tokenizer(model: bytes):
    """The process's tokenizer of this model, made once however many tasks it runs: the library does not free all of one."""
    import tokenizers

    made = vars(tokenizers).setdefault("_made_here", {})
    key = hashlib.sha256(model).digest()
    if key not in made:
        made.clear()
        made[key] = tokenizers.Tokenizer.from_buffer(model)
        made[key].no_padding()
        made[key].no_truncation()
    return made[key]


def splitter(model: bytes | None, special: list[str]):
    """A maker of split(text): its words; concatenated they are the text. Special tokens are words of their own.

    model None: the regex package's Unicode tables decide throughout. What split holds, a tokenizer
    perhaps, goes with it.
    """

    def make():
        plain, other = re.compile(ASCII_PATTERN, re.ASCII).findall, regex.compile(PATTERN).findall
        unsure = re.compile(f"[^{SURE}]").search
        apart = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        own = []

        def split(text: str) -> list[str]:
            out = []
            for i, part in enumerate(apart(text) if apart and any(s in text for s in special) else [text]):
                if i % 2:
                    out.append(part)
                elif part.isascii() and "\x1c" not in part and "\x1d" not in part and "\x1e" not in part and "\x1f" not in part:
                    out += plain(part)
                elif model is not None and unsure(part):
                    if not own:
                        own.append(_tokenizer(model))
                    out += [part[a:b] for _, (a, b) in own[0].pre_tokenizer.pre_tokenize_str(part)]
                else:
                    out += other(part)
            return out

        return split

    return make


#: Words that the tokenizer encodes at once; each takes about a kilobyte meanwhile.
BATCH = 4096


def _encoder(model: bytes):
    def make():
        tokenizer = _tokenizer(model)
        return lambda words: [e.ids for k in range(0, len(words), BATCH) for e in tokenizer.encode_batch(words[k : k + BATCH], add_special_tokens=False)]

    return make


def piece_table(model: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces one after the other, and where each id's begin: the id-to-piece table (bounded by the vocabulary)."""
    tokenizer = _tokenizer(model)
    # byte-level pieces are written in stand-ins for bytes: printable Latin-1 as itself, the others from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    pieces = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        piece = tokenizer.id_to_token(i) or ""
        pieces.append(bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode())
    start = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), start


def _finisher(model: bytes, keep_text: bool):
    piece, piece_start = piece_table(model)  # on the driver: workers of this step need no tokenizer

    def make():
        pieces = wordtable.Values(piece, piece_start)

        def finish(block: wordtable.Block, values: wordtable.Values) -> pa.RecordBatch:
            ids, word_start = wordtable.gather(values, block.word)
            cut = word_start[np.concatenate([[0], np.cumsum(block.count)])]
            counts, digests, decoded, id_lists, texts = [], [], [], [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own = ids[a:b]
                counts.append(int(b - a))
                text = b"".join(wordtable.gather(pieces, own[k : k + wordtable.AT_ONCE])[0].tobytes() for k in range(0, len(own), wordtable.AT_ONCE)).decode("utf-8", "replace")
                if keep_text:
                    id_lists.append(own.astype(np.int32))
                    texts.append(text)
                else:
                    digests.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
            doc = pa.array(block.ids, pa.int64())
            if keep_text:
                return pa.RecordBatch.from_arrays([doc, pa.array(id_lists, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
            return pa.RecordBatch.from_arrays([doc, pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return finish

    return make


def _model(path: str) -> tuple[bytes, list[str]]:
    """The vocabulary file and its special tokens; read on the driver and sent with the functions."""
    import json

    with open(path, "rb") as f:
        model = f.read()
    return model, [t["content"] for t in json.loads(model).get("added_tokens", [])]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded: the tokens of each row's whole text, and the text decoded from them.

    path: a byte-level BPE file of the tokenizers library. One row per row of docs, repeated rows
    included; a null text counts as empty and has no tokens. Other columns of docs are ignored.
    """
    model, special = _model(path)
    return wordtable.join_words(docs, splitter(model, special), _encoder(model), _finisher(model, True), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256; rows as for encode()."""
    model, special = _model(path)
    return wordtable.join_words(docs, splitter(model, special), _encoder(model), _finisher(model, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

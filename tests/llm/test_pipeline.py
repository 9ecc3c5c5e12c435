"""The pipeline's stages one after the other against plain Python."""

import collections
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from cellflow.llm import mixing, quality_classifier, queries

from .test_models import fingerprint, grouped, noisy

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = [(i, noisy(rng, i % 7 if i % 7 < 3 else 0), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(150)]
    rows += [(1000 + i, rows[i][1], "en", "a") for i in range(0, 60, 3)]  # exact copies
    rows += [(2000 + i, rows[i][1].upper(), "en", "b") for i in range(4, 60, 7)]  # equal fingerprints
    rows += [(3000, None, "en", "a"), (3001, "", "en", None), (10, rows[10][1], "en", "a")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 in (0, 3, 4, 5, 6)), 0) for i in range(100)], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, columns = [], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append([r.asDict() for r in docs.collect()])
        assert k == 4 or docs.columns == columns
    good, exact, near, mixed, encoded = kept
    before = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_classifier.train(before.select("doc_id", "text"), quality_classifier.graded(spark.read.parquet(f"{folder}/labels.parquet")))
    accepted = [r["row"] for r in quality_classifier.classify(before, model).collect() if r["tail"] >= quality_classifier.ACCEPT]
    assert sorted((r["doc_id"], r["text"] or "") for r in accepted) == sorted((r["doc_id"], r["text"] or "") for r in good)
    assert sum(r["doc_id"] < 150 and r["doc_id"] % 7 in (1, 2) for r in good) <= 2
    assert sum(r["doc_id"] < 150 and r["doc_id"] % 7 not in (1, 2) for r in good) >= 105
    best = {}
    for r in good:
        best[r["text"] or ""] = max(r["doc_id"], best.get(r["text"] or "", -1))
    assert sorted(r["doc_id"] for r in exact) == sorted(best.values())
    group = grouped([fingerprint(r["text"]) for r in exact])
    least = collections.defaultdict(list)
    for g, r in zip(group, exact, strict=True):
        least[g].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in near) == sorted(map(min, least.values()))
    size = lambda t: len(WORDS.findall(t or ""))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(near, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    got = collections.Counter()
    for r in mixed:
        got[r["doc_id"]] += size(r["text"])
    assert got == {i: n for i, n in taken.items() if n}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in mixed:
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert sorted(tuple(r.values()) for r in encoded) == sorted(want)


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def written(spark, path, rows, labels):
    spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).count() == 0
    for query in queries.QUERIES.values():
        assert query(spark, str(tmp_path)).count() == 0


def test_null_ids_long_texts_and_one_id_with_two_texts(spark, tmp_path):
    rng = random.Random(15)
    lone = [noisy(rng, 0) for _ in range(12)]
    rows = [(None, t, "en", "a") for t in lone[:4]] * 2 + [(7, lone[4], "en", "a"), (7, lone[5], "en", "b"), (8, lone[6], None, None), (9, None, "en", "a"), (None, None, None, None)]
    rows += [(10, " ".join(f"word{i % 9973}" for i in range(300_000)), "en", "b"), (11, "x" * 1_000_000, "en", "b"), (12, lone[7], "en", "a"), (13, lone[7], "en", "b")]
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, written(spark, tmp_path, rows, [])).collect())
    # without labels nothing is rejected; a source is taken whole unless its target is below its size
    docs = mixing.targets(spark.createDataFrame([("0a", 1), ("0b", 1)], "skey string, size long"))
    assert docs.count() == 2 and got[10] >= 1 and got[None] >= 1 and 12 not in got
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == {None: 4, 7: 2, 8: 1, 9: 1, 10: 1, 11: 1, 13: 1}


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no bundled tables here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    found = con.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted([str(r[names.index(c)]) for c in columns] for r in found.fetchall())
    assert sorted([str(r[c]) for c in columns] for r in got.collect()) == want


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and not os.path.isabs(names[0])

"""SimHash, language model, classifiers and the pipeline against plain Python or held-out rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cellflow.llm import bytewords, hashtext, language_model, quality_classifier, simhash, toxicity
from cellflow.llm.eliasfano import EliasFano, dump, load

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = WORDS.findall(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def grouped(prints):
    """Component of each print under links of two bits, as the smallest place."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


TEXTS = [None, "", " \n", "one", "One", "one two", "a b c d", "Ünï cödé ß Ä", "x" * 6000 + " y z " + "w" * 40, "k " * 4000]


def test_fingerprints(docs):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["the", "of", "and", "Tion", "er" * 9]) for _ in range(rng.randrange(60))) for _ in range(40)]
    got = {r["doc_id"]: r["fingerprint"] % (1 << 64) for r in simhash.fingerprints(docs(texts)).collect()}
    assert got == {i: fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("limit", [64, 3])
def test_links_and_components(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP", limit)  # 3: nearly every group goes through the chain's next step
    simhash_rng = random.Random(limit)
    prints = set()
    for _ in range(12):
        p = simhash_rng.getrandbits(64)
        for _ in range(25):  # chains and clouds about a centre
            prints.add(p)
            q = p
            for _ in range(simhash_rng.randrange(4)):
                q ^= 1 << simhash_rng.randrange(64)
            prints.add(q)
            p = simhash_rng.choice([p, q])
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    found = {frozenset((r["a"], r["b"])) for r in simhash.links(frame).collect()}
    want = {frozenset((signed[i], signed[j])) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert found == want
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    group = grouped(prints)
    label = [roots.get(s, s) for s in signed]
    assert len(set(zip(group, label, strict=True))) == len(set(group)) == len(set(label))


def test_cluster_and_keep_one(docs):
    rows = [(10, None), (4, ""), (7, "some words of a text"), (7, "some words of a text"), (3, "Some WORDS of a text"), (None, "other words entirely here"), (12, "a b c d e f")]
    frame = docs(rows).selectExpr("*", "1 AS fingerprint", "2 AS component_id", "3 AS n")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash.cluster(frame).collect())
    assert got == {(10, 4): 1, (4, 4): 1, (7, 3): 2, (3, 3): 1, (None, None): 1, (12, 12): 1}
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["12", "3", "4", "None"]
    assert simhash.cluster(docs([])).count() == 0


def test_keep_one_keeps_a_row_of_each_component(docs):
    lone = [f"quite another text number {'xyz'[i % 3] * (i + 3)} about {i * 7919} things {i}" for i in range(12)]
    rows = [(None, t) for t in lone[:8]] * 2 + [(5, lone[8]), (5, lone[9]), (5, lone[9]), (6, lone[10]), (None, lone[10].upper()), (None, None), (None, "")]
    signs = {t: fingerprint(t) for t in lone}
    assert min((a ^ b).bit_count() for x, a in signs.items() for y, b in signs.items() if x != y) > 2 and len(set(grouped(list(signs.values())))) == 12
    frame = docs(rows)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    got = collections.Counter((r["doc_id"], (r["text"] or "")) for r in kept.collect())
    assert got == collections.Counter([(None, t) for t in lone[:8]] + [(5, lone[8]), (5, lone[9]), (6, lone[10]), (None, "")])
    assert simhash.keep_one(docs([])).count() == 0


def test_words_and_hashes():
    w = bytewords.words(pa.array(["A b  c\n", "", "É\x1cx"], pa.large_string()))
    assert [w.data[s : s + n].tobytes().decode() for s, n in zip(w.start, w.length, strict=True)] == ["a", "b", "c", "É\x1cx"]
    assert list(w.count) == [3, 0, 1]
    data = np.frombuffer(random.Random(2).randbytes(9000), np.uint8)
    length = np.array([*range(70), 100, 4096, 4097, 8000])
    got = bytewords.xxh64(data, np.arange(len(length)), length)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(data[i : i + n].tobytes(), 42) for i, n in enumerate(length)]


@pytest.mark.parametrize("top", [3, 1000, 1 << 40, (1 << 63) - 1, (1 << 64) - 1])
def test_elias_fano(top):
    rng = random.Random(top)
    values = sorted({rng.randrange(top + 1) for _ in range(500)})
    ef = load(dump({"v": EliasFano.build(np.array(values, np.uint64))}))["v"]
    assert list(ef.get(np.arange(len(values)))) == values
    asked = sorted({rng.randrange(top + 1) for _ in range(300)} | set(values[:50]) | {0, values[-1], min(values[-1] + 1, (1 << 64) - 1)})
    place, found = ef.successor(np.array(asked, np.uint64))
    for x, p, f in zip(asked, place, found, strict=True):
        assert f == (x in values) and p == next((i for i, v in enumerate(values) if v >= x), len(values))
    first = np.array([rng.randrange(len(values)) for _ in asked])
    stop = np.array([rng.randrange(a, len(values) + 1) for a in first])
    place, found = ef.successor(np.array(asked, np.uint64), first, stop)
    for x, p, f, a, b in zip(asked, place, found, first, stop, strict=True):
        assert f == (x in values[a:b]) and p == next((i for i in range(a, b) if values[i] >= x), b)
    rising = EliasFano.build(np.array([0, 0, 0, 2, 2, 5], np.uint64))
    assert list(rising.get(np.arange(6))) == [0, 0, 0, 2, 2, 5]
    empty = EliasFano.build(np.zeros(0, np.uint64))
    assert not empty.successor(np.array([1], np.uint64))[1].any()


def test_trie_searches_its_contexts_range_alone(monkeypatch):
    rng = np.random.default_rng(6)
    contexts, words_ = (np.sort(rng.choice(10_000, n, replace=False)) for n in (30, 50))
    pairs = sorted({(int(c), int(w)) for c, w in zip(rng.integers(0, 29, 200) % 27, rng.integers(0, 50, 200), strict=True)})  # contexts 27 to 29 have none
    c, w = (np.array(x) for x in zip(*pairs, strict=True))
    n, n_context, n_word = rng.integers(1, 9, len(pairs)), rng.integers(1, 99, 30), rng.integers(1, 99, 50)
    trie = load(language_model.build_trie(contexts, n_context, words_, n_word, c, w, n, 5000, 50))
    asked = []
    plain = EliasFano.successor
    monkeypatch.setattr(EliasFano, "successor", lambda self, x, first=None, stop=None: asked.append((self, first, stop)) or plain(self, x, first, stop))
    got = language_model.query_trie(trie, contexts, np.full(30, 50), words_, np.tile(np.arange(50), 30))
    count = dict(zip(pairs, n, strict=True))
    for i, score in enumerate(got):
        a, b = divmod(i, 50)
        p = (n_word[b] + 0.1) / (5000 + 0.1 * 51)
        want = math.log10((count.get((a, b), 0) + language_model.PRIOR * p) / (n_context[a] + language_model.PRIOR))
        assert abs(score / language_model.STEPS + want) < 1e-3
    ((_, first, stop),) = [a for a in asked if a[0] is trie["successors"]]
    size = np.bincount(c, minlength=30)
    assert list(stop - first) == list(np.repeat(size, 50)) and list(first) == list(np.repeat(np.cumsum(size) - size, 50))


def plain_scores(rows, prior):
    tokens = [WORDS.findall(lower(t)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    count, pairs = collections.Counter(), collections.Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            count.update(t)
            pairs.update(zip([None] + t[:-1], t, strict=True))
    total, distinct = sum(count.values()), len(count)
    p = lambda w: (count[w] + 0.1) / (total + 0.1 * (distinct + 1))
    out = []
    for (i, _), t, h in zip(rows, tokens, held, strict=True):
        score = sum(math.log10((pairs[c, w] + prior * p(w)) / (count[c] + prior)) for c, w in zip([None] + t[:-1], t, strict=True))
        out.append((i, h, len(t), sum(count[w] > 0 for w in t), total, sum(math.log10(p(w)) for w in t), score))
    return out


@pytest.mark.parametrize("block", [1 << 24, 2000])
def test_language_model(docs, monkeypatch, block):
    monkeypatch.setattr(language_model, "BLOCK", block)
    rng = random.Random(8)
    vocabulary = ["the", "of", "Der", "é", "cat", "sat"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, [30, 10, 5, 5, 5, 5] + [1] * 40, k=rng.randrange(120)))) for i in range(80)]
    rows += [(i, t) for i, t in enumerate(TEXTS)] + [(None, "the cat"), (5, rows[5][1]), (5, rows[5][1])]
    got = language_model.score(docs(rows).selectExpr("*", "1 AS kind", "2 AS key", "3 AS block"), buckets=5).collect()
    order = lambda r: (str(r[0]), r[2], r[5])
    want = sorted(plain_scores(rows, language_model.PRIOR), key=order)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=order), want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and abs(g[6] - w[6]) <= 1e-3 * w[2]
    assert language_model.score(docs([])).count() == 0


def noisy(rng, junk):
    w = ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
    return " ".join(x + "&&&" for x in w) if junk == 1 else " ".join(x for x in w[:6] for _ in range(9)) if junk == 2 else " ".join(w) + "."


def test_ordinal_classifier_on_held_out_rows(spark, docs):
    rng = random.Random(3)
    rows = [(i, noisy(rng, i % 5 if i % 5 < 3 else 0)) for i in range(400)]
    rated = [(i, 0.0 if i % 5 in (1, 2) else float(1 + i % 2)) for i in range(400)]
    frame = docs([*rows, (1000, None), (1001, "")])
    labels = spark.createDataFrame([r for r in rated if r[0] < 200] + [(3, None), (None, 1.0), (5000, 1.0)], "doc_id long, grade double")
    model = quality_classifier.train(frame.select("doc_id", "text"), labels)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r["row"]["doc_id"]: r for r in quality_classifier.classify(frame, model).collect()}
    held = [(got[i]["tail"] >= quality_classifier.ACCEPT) == (g > 0) for i, g in rated if i >= 200]
    assert len(got) == 402 and sum(held) / len(held) > 0.95
    assert all(0 <= r["tail"] <= 1 and 0 <= r["expected"] <= 2 for r in got.values())
    kept = quality_classifier.accepted(frame, model)
    assert kept.columns == frame.columns
    clash = frame.selectExpr("*", "1 AS tail", "2 AS expected", "3 AS row", "array(doc_id) AS label", "map('a', n_chars) AS m")
    assert quality_classifier.accepted(clash, model).dtypes == clash.dtypes and quality_classifier.accepted(clash, model).count() == kept.count()
    twice = quality_classifier.classify(docs([(1, "a " * 400_000), (1, "a " * 400_000), (2, "x" * 800_000)]), model).collect()
    assert len(twice) == 3 and twice[0]["tail"] == twice[1]["tail"]
    none = quality_classifier.train(frame.select("doc_id", "text"), labels.limit(0))
    assert quality_classifier.accepted(frame, none).count() == 402
    assert quality_classifier.classify(docs([]), model).count() == 0


def test_toxicity_chain_on_held_out_rows(spark, docs):
    rng = random.Random(4)
    rows, toxic = [], []
    for i in range(600):
        text = noisy(rng, 0)
        kind = i % 6
        if kind == 0:
            text = f"{text} {rng.choice(["zark", "blug"])} and {rng.choice(["vrop", "zark"])}"
        elif kind == 1:
            text = " ".join(f"{text} grolm{rng.choice(['er', 'on', 'an'])} x grolm{rng.choice(['a', 'b'])}".split())
        rows.append((i, text))
        toxic.append((i, int(kind < 2)))
    frame = docs([*rows, (1000, None), (1001, ""), (7, rows[7][1])])
    labels = spark.createDataFrame([(i, t, i % 6 if t and i % 18 else None) for i, t in toxic if i < 400] + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic long, quality long")
    chain = toxicity.train(frame, labels)
    got = toxicity.classify(frame, chain).collect()
    assert len(got) == 603
    said = {r["doc_id"]: r["toxic"] for r in got}
    held = [said[i] == bool(t) for i, t in toxic if i >= 400]
    assert sum(held) / len(held) > 0.95 and not said[1000] and not said[1001]
    assert toxicity.classify(docs([]), chain).count() == 0
    assert not any(r["toxic"] for r in toxicity.classify(frame, toxicity.train(frame, labels.limit(0))).collect())
    clash = frame.selectExpr("*", "1 AS toxic", "2 AS p_toxic")
    assert sorted(map(str, toxicity.classify(clash, chain).collect())) == sorted(map(str, got))
    long = toxicity.classify(docs([(1, "zark " * 200_000), (2, "x" * 1_000_000)]), chain).collect()
    assert len(long) == 2
    told = {r["doc_id"]: r for r in got}
    bad, good = ([told[i]["p_bad_toxic"] > told[i]["p_good_toxic"] for i, t in toxic if i >= 400 and t and i % 6 == k] for k in (0, 1))
    assert sum(bad) / len(bad) > 0.9 and sum(good) / len(good) < 0.1


def test_categories_of_ratings():
    toxic, quality = np.array([0.0, 0, 1, 1, 1]), np.array([1, np.nan, 0, 1, np.nan])
    got = toxicity.categories(toxic, quality)
    assert list(got) == list(toxicity.CHAIN)
    assert np.array_equal(np.array(list(got.values())), [[0, 0, 1, 0, np.nan], [0, 0, 0, 1, np.nan], [0, 0, 1, 1, 1]], equal_nan=True)


def plain_features(text, lower):
    """Hashed features of a text as a counter, straight from their definition."""
    m64 = (1 << 64) - 1

    def mix(x, salt):
        x = ((x ^ (salt * 0x9E3779B97F4A7C15 & m64)) * 0xD6E8FEB86659FD93) & m64
        return (((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & m64) >> 46

    w = [x.encode() for x in WORDS.findall(globals()["lower"](text) if lower else text or "")]
    out = collections.Counter()
    for x in sorted(set(w)):
        out[mix(xxhash.xxh64_intdigest(x, 42), 1)] += 1
        for k in hashtext.BEGINNINGS:
            out[mix(int.from_bytes(x[:k], "little"), 10 + k)] += 1
        for k in hashtext.ENDS:
            out[mix(int.from_bytes(x[-k:], "little"), 20 + k)] += 1
    share, length = 10 * len(set(w)) // max(len(w), 1), int(math.log2(len(w) + 1))
    for value, salt in ((share, 31), (length, 32), (share * 64 + length, 33)):
        out[mix(value, salt)] += 1
    out[40] += len({a for a, b in zip(w, w[1:], strict=False) if a == b})
    return +out


def test_classifiers_against_plain_python():
    rng = random.Random(14)
    texts = [noisy(rng, i % 3) for i in range(60)] + ["", "One one ONE Ünï x", "same same same"]
    grades = np.array([[2, 0, 1][i % 3] for i in range(60)] + [0, 1, 2])
    rows = hashtext.merged(hashtext.features(pa.array(texts, pa.large_string()), False))
    plain = [plain_features(t, False) for t in texts]
    for d in range(len(texts)):
        a, b = rows.start[d], rows.start[d + 1]
        assert dict(zip(rows.place[a:b].tolist(), rows.count[a:b].tolist(), strict=True)) == plain[d]
    model = quality_classifier.fit(rows, grades, 3)
    # the same steps with dictionaries and loops
    told = [p for p in {p for f in plain for p in f} if model.weights[p]]
    mask = np.zeros(hashtext.DIMENSIONS, bool)
    for k in (1, 2):
        mask |= hashtext.telling_places(rows, grades >= k, 3, quality_classifier.TELLING)
    for place in sorted({p for f in plain for p in f})[:300]:  # the places' choice
        n, ok = len(texts), False
        for k in (1, 2):
            y = [g >= k for g in grades]
            have = sum(place in f for f in plain)
            inside = sum(place in f for f, t in zip(plain, y, strict=True) if t)
            n1 = sum(y)
            error = math.sqrt(max(have / n * (1 - have / n), 1e-12) * (1 / n1 + 1 / (n - n1)))
            ok |= have >= 3 and abs(inside / n1 - (have - inside) / (n - n1)) / error >= quality_classifier.TELLING
        assert mask[place] == ok
    weights, square = dict.fromkeys(np.flatnonzero(mask).tolist(), 0.0), {}
    cuts, cut_square = [-0.5, 0.5], [1e-8, 1e-8]
    sig = lambda x: 1 / (1 + math.exp(-x))
    seen = collections.Counter(grades.tolist())
    for _ in range(quality_classifier.ROUNDS):
        g, cut_g = dict.fromkeys(weights, 0.0), [0.0, 0.0]
        for f, y in zip(plain, grades.tolist(), strict=True):
            scale, share = 1 / math.sqrt(max(sum(f.values()), 1)), 1 / (seen[y] * 3)
            score = sum(weights.get(p, 0.0) * n for p, n in f.items()) * scale
            above = [1.0, *(sig(score - c) for c in cuts), 0.0]
            steep = [a * (1 - a) for a in above]
            p = max(above[y] - above[y + 1], 1e-9)
            for place, n in f.items():
                if place in g:
                    g[place] -= (steep[y] - steep[y + 1]) / p * share * scale * n
            for k, sign in ((y, 1), (y + 1, -1)):
                if 1 <= k <= 2:
                    cut_g[k - 1] += sign * steep[k] / p * share
        for place in weights:
            square[place] = square.get(place, 1e-8) + g[place] ** 2
            rate = quality_classifier.RATE / math.sqrt(square[place])
            w = weights[place] - rate * g[place]
            weights[place] = math.copysign(max(abs(w) - rate * quality_classifier.PENALTY * (square[place] > 1e-8), 0), w)
        for k in range(2):
            cut_square[k] += cut_g[k] ** 2
            cuts[k] -= quality_classifier.RATE / math.sqrt(cut_square[k]) * cut_g[k]
        cuts[1] = max(cuts)
    assert np.allclose(model.thresholds, cuts, rtol=1e-6, atol=1e-8) and told
    assert np.allclose([model.weights[p] for p in weights], list(weights.values()), rtol=1e-5, atol=1e-8)
    expected, above = quality_classifier.predict(model, rows)
    for d, f in enumerate(plain):
        score = sum(weights.get(p, 0.0) * n for p, n in f.items()) / math.sqrt(max(sum(f.values()), 1))
        tails = [sig(score - c) for c in cuts]
        assert np.allclose(above[d], tails, rtol=1e-5) and math.isclose(expected[d], sum(tails), rel_tol=1e-5)


def test_conflicting_labels_and_repeated_ids_count_once(spark, docs):
    frame = docs([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (2, "c"), (None, "d"), (3, None)])
    labels = spark.createDataFrame([(1, 1.0, 5), (1, 0.0, 7), (1, 0.0, 6), (2, 1.0, None), (2, 1.0, 3), (None, 1.0, 1), (3, 1.0, 2), (9, 0.0, 1)], "doc_id long, y double, hash long")
    hashed = {r["text"]: r["h"] for r in frame.selectExpr("text", "xxhash64(text) AS h").collect()}
    for part in (labels, labels.orderBy(F.desc("hash")), labels.unionByName(labels)):
        got = sorted((r["doc_id"], r["text"], r["y"], r["hash"]) for r in hashtext.labelled_sample(frame, part, F.col("y"), 50).collect())
        assert got == [(1, min("ab", key=hashed.get), 0.0, 6), (2, "c", 1.0, None), (3, "", 1.0, 2)]


def test_sample_is_bounded_and_depends_on_the_table_alone(spark, docs):
    frame = docs([(i, f"text {i}") for i in range(300)])
    labels = spark.createDataFrame([(i % 300, i % 2) for i in range(600)], "doc_id long, y long")
    one = hashtext.labelled_sample(frame, labels, F.col("y"), 20)
    ids = sorted(r["doc_id"] for r in one.collect())
    assert len(ids) == len(set(ids)) == 40
    assert ids == sorted(r["doc_id"] for r in hashtext.labelled_sample(frame.orderBy(F.desc("doc_id")), labels.orderBy("y"), F.col("y"), 20).collect())

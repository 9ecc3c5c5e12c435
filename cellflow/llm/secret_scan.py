"""Secrets in texts: fixed forms, and strings that pass a battery of randomness tests.

Everything is DataFrame operations. Places of matches come from the lengths of what lies
between them: the text is split by a pattern and the pieces and matches are summed up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: For access and hex, a maximal run that is long enough is what is left once short matches are dropped.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
MIN_ASSIGNED = 8
#: What may be a secret of unknown form: a run of encoding characters, MIN_LENGTH long with the padding at its end. An '='
#: before another encoding character is no padding and ends the run.
MIN_LENGTH = 20
_RUN = "[{0}]{{20,}}(?:=+(?![A-Za-z0-9+/_=-]))?|[{0}]{{1,19}}=+(?![A-Za-z0-9+/_=-])"
CANDIDATE = _RUN.format("A-Za-z0-9+/_-")
#: Ways to cut a candidate: not at all, at the signs of base64, at those of base64url, at all signs.
#: Where these differ the string had four tests, so its p-value counts four times (CUT_STEPS of STEP).
SIGN, CUT_STEPS = "[+/_-]", 7
CUTS = (CANDIDATE, _RUN.format("A-Za-z0-9_-"), _RUN.format("A-Za-z0-9+/"), _RUN.format("A-Za-z0-9"))
#: Encodings in the order in which they are tried: name, pattern of the whole string, alphabet in code order.
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", _LOW),
    ("upper", "^[A-Z]+$", _UP),
    ("base32", "^[A-Z2-7]+=*$", _UP + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOW),
    ("base36_upper", "^[0-9A-Z]+$", _DIGITS + _UP),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UP + _LOW),
    ("base64", "^[0-9A-Za-z+/]+=*$", _UP + _LOW + _DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+=*$", _UP + _LOW + _DIGITS + "-_"),
)
#: Ordinary strings (words, names, numbers) by classes of characters: digits, lower case, upper case, signs. Chances
#: of the next character's class, also for the first one; rows are cut to an encoding's classes and scaled to 1.
_SIGNS = "+/-_"
MOVES = {"digit": (0.85, 0.07, 0.05, 0.03), "lower": (0.05, 0.84, 0.06, 0.05), "upper": (0.04, 0.42, 0.50, 0.04), "sign": (0.20, 0.50, 0.25, 0.05), "first": (0.25, 0.40, 0.30, 0.05)}
#: Rough shares in percent of the letters a to z in running English, German, French and Spanish; digits and signs count as equally frequent.
LETTERS = (8.4, 1.6, 3.1, 4.6, 14.0, 1.5, 1.9, 3.4, 7.3, 0.35, 0.8, 4.7, 2.7, 7.6, 5.8, 2.2, 0.6, 6.5, 6.8, 6.8, 4.0, 1.2, 1.1, 0.25, 0.9, 0.6)
#: False-discovery rate within a class of lengths.
FDR = 0.001
#: Matches of which a text's places are summed up together; sums of such chunks are summed up in turn.
CHUNK = 128
#: P-values are counted in steps of this many tenths of a decade, down to 1e-40.
STEP, LAST = 0.1, 400
#: The first step that can be a discovery, at the best rank.
LEAST_STEP = 30
#: Lengths fall in classes by powers of two from MIN_LENGTH on.
CLASSES = 8


def _places(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans (start, end, kind, match) of the non-overlapping matches of pattern, from the left. keep: of a match.

    Lengths are summed up within chunks of matches and over chunks, so that the work is near linear in a text's matches.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"))
        grown = F.concat(acc["found"], F.array(span))
        return F.struct(end.alias("at"), F.when(keep(x["match"]), grown).otherwise(acc["found"]).alias("found") if keep else grown.alias("found"))

    def spans(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))
        return _let(chunks, placed)

    def placed(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda a, x: a + F.char_length(x["piece"]) + F.char_length(x["match"])))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), none.alias("found")), step)["found"]))

    return F.when(F.rlike(text, F.lit(pattern)), _let(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("piece"), matches.alias("match")), spans)).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by Zelen and Severo's polynomial (formula 26.2.17 of Abramowitz and Stegun)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element array mapped."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _alternative(letters: str) -> tuple[list[int], list[float]]:
    """Class of each letter of an alphabet, and log(k * chance of letter x after class c) of an ordinary string at c * k + x; class 4 is the start."""
    sets = (_DIGITS, _LOW, _UP, _SIGNS)
    kinds = [next(i for i, s in enumerate(sets) if c in s) for c in letters]
    weight = [LETTERS[sets[i].index(c)] if i in (1, 2) else 1.0 for c, i in zip(letters, kinds, strict=True)]
    whole = [sum(w for w, j in zip(weight, kinds, strict=True) if j == i) for i in range(4)]
    gains = []
    for row in MOVES.values():
        scale = sum(row[i] for i in set(kinds))
        gains += [math.log(len(letters) * row[i] / scale * w / whole[i]) for w, i in zip(weight, kinds, strict=True)]
    return kinds, gains


def battery(string: Column) -> Column:
    """Tests of a string: a struct of encoding, n, chi2, p_chi2, p_runs, p_serial, p_random, p_text and p.

    Symbols are the places of the characters in the alphabet of the first encoding that fits
    (padding left out). chi2: uniformity of the alphabet, neither worse nor better than chance. Runs: Wald
    and Wolfowitz about the alphabet's middle. Serial: correlation of neighbouring symbols. p_random combines
    the three by Fisher; it is even between 0 and 1 for random strings. p_text bounds the chance that an ordinary
    string of the encoding (MOVES, LETTERS) looks so random: its likelihood as an ordinary string over that as a
    random one. p = p_text / (2 p_random), at most 1, is the whole battery's p-value against ordinary strings: for
    these the mean of 2 p_random / p_text is that of 2 p_random for random strings, which is 1, so by Markov's
    inequality p is below t with a chance of t at most, and a string that fails the battery has a large p whatever
    its likelihood. A null, empty or constant string, or one that fits no encoding, gets p_random 0 and p 1.
    """
    fits = [F.rlike(string, F.lit(p)) for _, p, _ in ENCODINGS]
    name = F.coalesce(*[F.when(f, F.lit(e[0])) for f, e in zip(fits, ENCODINGS, strict=True)])
    letters = F.coalesce(*[F.when(f, F.lit(e[2])) for f, e in zip(fits, ENCODINGS, strict=True)])
    models = [_alternative(e[2]) for e in ENCODINGS]
    kinds, gains = (F.coalesce(*[F.when(f, F.array(*map(F.lit, m[i]))) for f, m in zip(fits, models, strict=True)]) for i in (0, 1))
    body = F.rtrim(string, F.lit("="))
    basis = F.struct(name.alias("encoding"), letters.alias("letters"), kinds.alias("kinds"), gains.alias("gains"), F.char_length(letters).cast("double").alias("k"), body.alias("body"), F.char_length(body).cast("double").alias("n"))

    def counted(b: Column) -> Column:
        expected = b["n"] / b["k"]
        each = F.transform(F.split(b["letters"], "", -1), lambda c: F.char_length(b["body"]) - F.char_length(F.replace(b["body"], c, F.lit(""))))
        chi2 = _sum(F.transform(each, lambda o: (o - expected) * (o - expected) / expected))
        x = F.transform(F.split(b["body"], "", -1), lambda c: (F.instr(b["letters"], c) - 1).cast("double"))
        return F.struct(b["encoding"].alias("encoding"), b["k"].alias("k"), b["n"].alias("n"), b["kinds"].alias("kinds"), b["gains"].alias("gains"), chi2.alias("chi2"), x.alias("x"), (_sum(x) / b["n"]).alias("mean"))

    def measured(c: Column) -> Column:
        x, n, mean = c["x"], c["n"], c["mean"]
        high = lambda v: v > (c["k"] - 1) / 2
        up = _sum(F.transform(x, lambda v: F.when(high(v), 1.0).otherwise(0.0)))
        turns = _sum(F.transform(x, lambda v, i: F.when((i > 0) & (high(v) != high(F.get(x, i - 1))), 1.0).otherwise(0.0)))
        lag = _sum(F.transform(x, lambda v, i: F.when(i > 0, (v - mean) * (F.get(x, i - 1) - mean)).otherwise(0.0)))
        power = _sum(F.transform(x, lambda v: (v - mean) * (v - mean)))
        after = lambda i: F.when(i > 0, F.get(c["kinds"], F.get(x, i - 1).cast("int"))).otherwise(4)
        ordinary = _sum(F.transform(x, lambda v, i: F.get(c["gains"], (after(i) * c["k"] + v).cast("int"))))
        return F.struct(c["encoding"].alias("encoding"), c["k"].alias("k"), n.alias("n"), ordinary.alias("ordinary"), c["chi2"].alias("chi2"), up.alias("up"), turns.alias("turns"), lag.alias("lag"), power.alias("power"))

    def judged(m: Column) -> Column:
        n, df, chi2 = m["n"], m["k"] - 1, m["chi2"]
        expected = 2 * m["up"] * (n - m["up"]) / n + 1
        spread = F.sqrt(F.greatest(F.lit(0.0), (expected - 1) * (expected - 2) / (n - 1)))  # 0 if all symbols lie on one side
        two_sided = lambda z: F.least(F.lit(1.0), 2 * _normal_tail(F.abs(z)))
        p_runs = F.when(spread > 0, two_sided(F.try_divide(m["turns"] + 1 - expected, spread))).otherwise(0.0)
        p_serial = F.when(m["power"] > 0, two_sided(F.try_divide(m["lag"], m["power"]) * F.sqrt(n))).otherwise(0.0)
        p_chi2 = two_sided((F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        p_text = F.exp(F.least(F.lit(700.0), m["ordinary"]))
        floor = lambda p: F.greatest(p, F.lit(1e-300))
        half = -(F.ln(floor(p_chi2)) + F.ln(floor(p_runs)) + F.ln(floor(p_serial)))
        p_random = F.exp(-half) * (1 + half + half * half / 2)
        p = F.least(F.lit(1.0), F.exp(F.least(F.lit(0.0), m["ordinary"] - F.ln(F.lit(2.0)) - F.ln(floor(p_random)))))
        return F.struct(m["encoding"].alias("encoding"), n.alias("n"), chi2.alias("chi2"), p_chi2.alias("p_chi2"), p_runs.alias("p_runs"), p_serial.alias("p_serial"), p_random.alias("p_random"), p_text.alias("p_text"), p.alias("p"))

    none = F.struct(F.lit(None).cast("string").alias("encoding"), F.lit(0.0).alias("n"), *[F.lit(v).alias(a) for a, v in (("chi2", 0.0), ("p_chi2", 0.0), ("p_runs", 0.0), ("p_serial", 0.0), ("p_random", 0.0), ("p_text", 1.0), ("p", 1.0))])
    fit = F.coalesce(name.isNotNull() & (F.char_length(body) > 1), F.lit(False))
    return F.when(fit, _let(_let(_let(basis, counted), measured), judged)).otherwise(none)


def _long(match: Column) -> Column:
    return F.char_length(match) >= MIN_LENGTH


def _first(spans: Column, before) -> Column:
    """How many of spans, which rise, are before what is sought; by halving."""
    halve = lambda acc, middle: F.when(acc["lo"] >= acc["hi"], acc).when(before(F.get(spans, middle)), F.struct((middle + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), middle.alias("hi")))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), lambda acc, _: halve(acc, F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")))["lo"]


def _blank(text: Column, m: Column, spans: Column) -> Column:
    """text, the bytes of span m, with a space for each that lies in one of spans, which rise and don't overlap."""
    start = lambda f: F.greatest(f["start"] - m["start"], F.lit(0))
    end = lambda f: F.least(f["end"], m["end"]) - m["start"]

    def blanked(over: Column) -> Column:
        upto = lambda i: F.when(i > 0, end(F.get(over, i - 1))).otherwise(0)
        parts = F.transform(over, lambda f, i: F.concat(F.substring(text, upto(i) + 1, start(f) - upto(i)).cast("string"), F.repeat(F.lit(" "), end(f) - start(f))))
        last = F.substring(text, end(F.get(over, F.size(over) - 1)) + 1, m["end"] - m["start"]).cast("string")
        return F.when(F.size(over) == 0, text).otherwise(F.concat(F.array_join(parts, ""), last).cast("binary"))

    begin, stop = _first(spans, lambda f: f["end"] <= m["start"]), _first(spans, lambda f: f["start"] < m["end"])
    return F.when(F.size(spans) == 0, text).otherwise(_let(_let(F.struct(begin.alias("begin"), stop.alias("stop")), lambda r: F.slice(spans, r["begin"] + 1, F.greatest(r["stop"] - r["begin"], F.lit(0)))), blanked))


def _beside(m: Column, kinds: list[Column]) -> Column:
    """The text of span m (encoding characters, a byte each) with a space for each that lies in a span of kinds."""
    text = m["match"].cast("binary")
    for spans in kinds:
        text = _blank(text, m, spans)
    return text.cast("string")


def _thresholds(found: DataFrame) -> list[tuple[int, int]]:
    """(class of lengths, smallest step that is a discovery) by Benjamini and Hochberg within each class.

    The p-values are those of the whole battery. Reads counts per (class, step): at most CLASSES * (LAST + 1) rows reach the driver.
    """
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.size_class", "c.step").count().collect()
    out = []
    for size_class in sorted({r["size_class"] for r in counts}):
        mine = [r for r in counts if r["size_class"] == size_class]
        tested, rank, least = sum(r["count"] for r in mine), 0, None
        for step in sorted({r["step"] for r in mine}, reverse=True):  # from the smallest p-value on
            rank += sum(r["count"] for r in mine if r["step"] == step)
            if 10 ** (-STEP * step) <= FDR * rank / tested:
                least = step
        if least is not None:
            out.append((size_class, least))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, spans: array of (start, end, kind), by start and then kind as listed.

    Kinds: assign, access and hex are the fixed forms; random are other strings whose p-value of
    the whole battery is a discovery in their class of lengths: runs of encoding characters beside the
    spans of fixed forms, or their parts between signs where the whole run does not look random.
    Strings that fit no encoding are not counted as tested. Places count code points, ends are
    exclusive. A null text counts as empty and has no spans. Other columns are ignored, repeated rows are scanned one by one; what is random
    depends on the whole table, as false discoveries are limited over it.
    """
    text = F.col("text")
    rows = docs.select("doc_id", text_of().alias("text")).select(
        "doc_id",
        _places(text, ASSIGN, "assign", lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= MIN_ASSIGNED).alias("assign"),
        _places(text, ACCESS, "access").alias("access"),
        _places(text, HEX, "hex").alias("hex"),
        _places(text, CANDIDATE, "random", _long).alias("maybe"),
    )
    kinds = [F.col(k) for k in ("assign", "access", "hex")]

    def figures(p: Column) -> Column:
        def of(t: Column) -> Column:
            size_class = F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.greatest(t["n"], F.lit(float(MIN_LENGTH))) / MIN_LENGTH)).cast("int"))
            step = F.least(F.lit(LAST), F.floor(-F.log10(F.greatest(t["p"], F.lit(1e-300))) / STEP).cast("int"))
            return F.struct(p["start"].alias("start"), p["end"].alias("end"), t["encoding"].alias("encoding"), size_class.alias("size_class"), F.greatest(F.lit(0), step).alias("step"))

        return _let(battery(p["match"]), of)

    def tested(m: Column) -> Column:
        """The parts of a candidate that count: those of the first cut with a random-looking part, else of the first with parts in an encoding."""
        signs = F.rlike(m["match"], F.lit(SIGN))  # without them all cuts are the same
        cuts = lambda left: F.when(signs, F.array(*[_places(left, c, "random", _long) for c in CUTS])).otherwise(F.array(_places(left, CUTS[0], "random", _long)))
        judged = lambda parts: F.filter(F.transform(parts, figures), lambda p: p["encoding"].isNotNull())
        good = lambda parts: F.exists(parts, lambda p: p["step"] >= LEAST_STEP)
        pick = lambda ways: F.coalesce(F.get(F.filter(ways, good), F.lit(0)), F.get(F.filter(ways, lambda parts: F.size(parts) > 0), F.lit(0)))
        picked = _let(_let(_let(_beside(m, kinds), cuts), lambda ways: F.transform(ways, judged)), pick)
        fined = F.when(signs, CUT_STEPS).otherwise(0)
        moved = lambda p: F.struct((m["start"] + p["start"]).alias("start"), (m["start"] + p["end"]).alias("end"), p["size_class"].alias("size_class"), F.greatest(F.lit(0), p["step"] - fined).alias("step"))
        return F.coalesce(F.transform(picked, moved), F.array().cast("array<struct<start:int,end:int,size_class:int,step:int>>"))

    placed = F.transform(F.concat(*kinds), lambda f: F.struct(f["start"], f["end"], f["kind"]))
    found = stored(rows.select("doc_id", placed.alias("fixed"), F.flatten(F.transform("maybe", tested)).alias("candidates")), "secret-spans")
    limits = _thresholds(found)
    passes = lambda c: F.lit(False) if not limits else F.coalesce(*[F.when(c["size_class"] == k, c["step"] >= s) for k, s in limits], F.lit(False))
    more = F.transform(F.filter("candidates", passes), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("random").alias("kind")))
    order = F.array(*map(F.lit, ("assign", "access", "hex", "random")))
    ranked = F.array_sort(F.transform(F.concat("fixed", more), lambda f: F.struct(f["start"], F.array_position(order, f["kind"]).alias("rank"), f["end"], f["kind"])))
    return found.select("doc_id", F.transform(ranked, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind"))).alias("spans"))

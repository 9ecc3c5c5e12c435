"""Line-first cleaning of documents by rules, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, WORD, text_of

SYMBOLS = "#*$%&|<>"
#: A line fails the punctuation rule from this share of symbols among its non-space characters
#: on, or if this share of its words ends in an exclamation or question mark (of MANY words on).
SYMBOL_SHARE, SHOUT_SHARE, MANY = 0.1, 0.5, 4
#: A line fails the navigation rule if it has at most NAV_WORDS words, no sentence end, and
#: NAV_SEPARATORS separators or nothing but words of menus; or if this share of its words are separators.
NAV_WORDS, NAV_SEPARATORS, NAV_SHARE = 12, 2, 0.2
NAV_MENU = "home|about(?: us)?|contact(?: us)?|log ?in|log ?out|sign ?(?:in|up)|register|menu|search|next|previous|back(?: to top)?|site ?map|help|faq|share|print"
#: A line of at most BOILER_WORDS words fails the boilerplate rule if it has one of these.
BOILER_WORDS = 40
BOILER = "all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|use of cookies|subscribe to our|newsletter|enable javascript|click here|copyright (?:\\(c\\)|©)|powered by|lorem ipsum|skip to (?:main )?content"
#: A document is rejected if its removed lines hold more than this share of its non-space characters.
LOST_SHARE = 0.5
#: A document is rejected below so many words, or if more than this share of its words is repeated.
MIN_WORDS, REPEAT_SHARE = 50, 0.5


def _chars(text: Column) -> Column:
    """Characters other than white space."""
    return F.char_length(F.translate(text, WHITESPACE, ""))


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[" + SYMBOLS + "]"))


#: A separator between spaces. What comes first is a class of characters, so most places are passed at once.
_SEPARATOR = "[|»›/·•>](?<![^\\x20\\x09-\\x0D][|»›/·•>])(?![^\\x20\\x09-\\x0D])"
#: Nothing but menu words. The repetition is possessive: no item can be read in two ways, and a line of any length takes no stack.
_MENU = f"(?i)^[\\x20\\x09-\\x0D]*+(?:{NAV_MENU})(?:[\\x20\\x09-\\x0D|»›/·•>]++(?:{NAV_MENU}))*+[\\x20\\x09-\\x0D]*+$"


def line_fails(line: Column) -> Column:
    """Name of the first rule that a line fails: navigation, punctuation, boilerplate; else null. An empty line passes.

    Words, symbols and separators are counted once; a test follows only where the counts leave it open.
    """

    def judged(n: Column) -> Column:
        words, symbols, separators = n["words"], n["symbols"], n["separators"]
        ends = F.rlike(line, F.lit("[.!?:;][\"')\\]]?[\\x20\\x09-\\x0D]*$"))
        shouts = F.regexp_count(line, F.lit("[!?](?=[\\x20\\x09-\\x0D]|$)"))
        navigation = ((words <= NAV_WORDS) & ((separators >= NAV_SEPARATORS) | F.rlike(line, F.lit(_MENU))) & ~ends) | (separators >= F.greatest(F.lit(NAV_SEPARATORS), words * NAV_SHARE))
        punctuation = ((symbols >= 1) & (symbols >= _chars(line) * SYMBOL_SHARE)) | ((words >= MANY) & (shouts >= words * SHOUT_SHARE))
        boilerplate = (words <= BOILER_WORDS) & F.rlike(line, F.lit(f"(?i){BOILER}"))
        return F.when(navigation, "navigation").when(punctuation, "punctuation").when(boilerplate, "boilerplate")

    words = F.regexp_count(line, F.lit(WORD))
    return _let(F.struct(words.alias("words"), _symbols(line).alias("symbols"), F.regexp_count(line, F.lit(_SEPARATOR)).alias("separators")), judged)


def repeated_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more among words, the first occurrence included.

    Windows are compared by 64-bit hash, sorted with their place: linear memory and n log n time
    in a document's words, and no row leaves its task. Works through higher-order functions.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashed: Column) -> Column:
        keyed = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            step = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get(p, k - 1), F.lit(3))))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        return _let(_let(keyed, places), total)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element array mapped."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines_failing(rule: str) -> Column:
    return F.size(F.filter("fails", lambda x: x.eqNullSafe(F.lit(rule)))).cast("long")


def clean(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, clean_text, the counts below, base_failed, lost_share, kept.

    n_words; word_chars: code points in words; n_symbols: characters of SYMBOLS; n_dup_lines:
    lines with a word that equal an earlier line; n_repeat_words: see repeated_words();
    n_punctuation, n_navigation, n_boilerplate: lines removed by each rule. clean_text has the
    other lines, in order. A null text counts as empty and fails (no words). Other columns of
    docs are ignored; repeated rows are judged one by one.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("lines", F.split("text", "\n", -1))
    rows = rows.withColumn("fails", F.transform("lines", line_fails))
    full = F.filter("lines", lambda x: F.rlike(x, F.lit(WORD)))
    rows = rows.select(
        "doc_id", "text", "lines", "fails",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _symbols(F.col("text")).cast("long").alias("n_symbols"),
        _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    stay = F.filter("lines", lambda x, i: F.get("fails", i).isNull())
    gone = F.filter("lines", lambda x, i: F.get("fails", i).isNotNull())
    rows = rows.select(
        "doc_id", F.array_join(stay, "\n").alias("clean_text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > F.col("n_words") * REPEAT_SHARE)).alias("base_failed"),
        *[_lines_failing(rule).alias(f"n_{rule}") for rule in ("punctuation", "navigation", "boilerplate")],
        F.coalesce(F.try_divide(_chars(F.array_join(gone, "")), F.col("word_chars")), F.lit(0.0)).alias("lost_share"),
    )
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= LOST_SHARE))

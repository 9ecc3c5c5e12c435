"""The registered result tables of the corpus operators: thin queries over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_model, mixing, quality_classifier, quality_rules, secret_scan, simhash, token_counts, toxicity
from .common import WORD, documents, labels, stored


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean(documents(spark, sf_dir)).drop("clean_text")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    fixed = F.filter("spans", lambda s: s["kind"] != "random")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, ("assign", "access", "hex", "random")), F.sha2(joined(fixed).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str, name: str = "byte_bpe_50k.json") -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary(name))


def op4_token_counts(spark: SparkSession, sf_dir: str, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    return token_counts.count(documents(spark, sf_dir), vocabulary(name))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_classifier.train(docs, quality_classifier.graded(labels(spark, sf_dir)))
    rows = quality_classifier.classify(docs, model)
    return rows.select("row.doc_id", F.col("expected").alias("expected_grade"), F.col("tail").alias("p_good"), (F.col("tail") >= quality_classifier.ACCEPT).alias("kept"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.classify(docs, toxicity.train(docs, labels(spark, sf_dir)))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.cluster(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("text_hash", "skey")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    rows = exact_dedup.classify(documents(spark, sf_dir), index).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    out = stored(rows, "exact-dedup")
    index.drop()
    return out


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_secret_scan, op3_bpe, op4_token_counts, op5_quality_classifier, op6_language_model, op7_toxicity, op8_simhash, op9_mixing, op10_exact_dedup)}

_R = quality_rules
_SPACES = "[\\x20\\x09-\\x0D]"

SQL = {
    "op1_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, string_split(text, chr(10)) AS lines FROM d),
t AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
p AS (SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS place FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS n FROM t) WHERE n > 1),
rp AS (SELECT rid, count(*) AS n_repeat_words FROM p GROUP BY rid),
l0 AS (SELECT rid, unnest(lines) AS line FROM w),
l1 AS (SELECT *, regexp_extract_all(line, '{WORD}') AS lw FROM l0),
l2 AS (SELECT *, len(lw) AS nw, length(array_to_string(lw, '')) AS chars, length(line) - length(translate(line, '{_R.SYMBOLS}', '')) AS symbols,
  len(list_filter(lw, lambda x: regexp_matches(x, '[!?]$'))) AS shouts, len(list_filter(lw, lambda x: regexp_matches(x, '^[|»›/·•>]$'))) AS separators,
  regexp_matches(line, '(?i)^{_SPACES}*(?:{_R.NAV_MENU})(?:[\\x20\\x09-\\x0D|»›/·•>]+(?:{_R.NAV_MENU}))*{_SPACES}*$') AS menu,
  regexp_matches(line, '[.!?:;]["'')\\]]?{_SPACES}*$') AS ends, regexp_matches(line, '(?i){_R.BOILER}') AS boiler FROM l1),
l3 AS (SELECT *, CASE WHEN (nw <= {_R.NAV_WORDS} AND NOT ends AND (separators >= {_R.NAV_SEPARATORS} OR menu)) OR separators >= greatest({_R.NAV_SEPARATORS}, nw * {_R.NAV_SHARE}) THEN 'navigation'
  WHEN symbols >= greatest(1, chars * {_R.SYMBOL_SHARE}) OR (nw >= {_R.MANY} AND shouts >= nw * {_R.SHOUT_SHARE}) THEN 'punctuation'
  WHEN nw <= {_R.BOILER_WORDS} AND boiler THEN 'boilerplate' END AS rule FROM l2),
ls AS (SELECT rid, count(CASE WHEN rule = 'punctuation' THEN 1 END) AS n_punctuation, count(CASE WHEN rule = 'navigation' THEN 1 END) AS n_navigation, count(CASE WHEN rule = 'boilerplate' THEN 1 END) AS n_boilerplate,
  CAST(sum(CASE WHEN rule IS NULL THEN chars ELSE 0 END) AS BIGINT) AS stay, CAST(sum(chars) AS BIGINT) AS chars, count(CASE WHEN nw > 0 THEN 1 END) - count(DISTINCT CASE WHEN nw > 0 THEN line END) AS n_dup_lines FROM l3 GROUP BY rid),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, chars AS word_chars, length(text) - length(translate(text, '{_R.SYMBOLS}', '')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_punctuation, n_navigation, n_boilerplate, coalesce(CAST(chars - stay AS DOUBLE) / nullif(chars, 0), 0) AS lost_share FROM w JOIN ls USING (rid) LEFT JOIN rp USING (rid)),
g AS (SELECT *, n_words < {_R.MIN_WORDS} OR n_repeat_words > n_words * {_R.REPEAT_SHARE} AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_punctuation, n_navigation, n_boilerplate, lost_share, NOT base_failed AND lost_share <= {_R.LOST_SHARE} AS kept FROM g
""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
}

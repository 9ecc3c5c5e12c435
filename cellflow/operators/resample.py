"""Deterministic samples, bootstraps and permutations: all randomness is a digest of a key and a seed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Rows of a bootstrap are dealt to so many buckets, which are then resampled in place of rows.
BUCKETS = 1024


def digest(*keys: Column | str) -> Column:
    """MD5 of the keys as text, joined by '|': the same in any engine."""
    return F.md5(F.concat_ws("|", *[F.coalesce(S.col(k).cast("string"), F.lit("")) for k in keys]))


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone: the first 13 hexadecimal digits of their digest."""
    return F.conv(F.substring(digest(*keys), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(u: Column, rate: float = 1.0, most: int = 12) -> Column:
    """The Poisson number at a uniform number."""
    upto, term, out = 0.0, math.exp(-rate), F.lit(most)
    limits = []
    for k in range(most):
        upto += term
        limits.append((upto, k))
        term *= rate / (k + 1)
    for limit, k in reversed(limits):
        out = F.when(u < limit, k).otherwise(out)
    return out


def sample(frame: DataFrame, key: str, n: int = 8000, seed: int = 42) -> DataFrame:
    """min(n, rows) rows without replacement: those with the smallest digests of key and seed."""
    return frame.orderBy(digest(key, F.lit(seed)), key).limit(n)


def _interval(estimates: DataFrame, names: Sequence[str]) -> DataFrame:
    """The 2.5 % and 97.5 % points and the mean of estimates, one row per repetition."""
    return estimates.agg(*[x for n in names for x in (F.percentile(n, F.lit(0.025)).alias(f"{n}_low"), F.avg(n).alias(f"{n}_mean"), F.percentile(n, F.lit(0.975)).alias(f"{n}_high"))])


def _resampled(units: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """units: __k, __s, __n. The interval of sum over number when units are drawn with Poisson weights."""
    reps = units.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    w = poisson(uniform("__k", "__r", F.lit(seed)))
    return _interval(reps.groupBy("__r").agg(S.ratio(F.sum(F.col("__s") * w), F.sum(F.col("__n") * w)).alias("diff")), ["diff"])


def _buckets(units: DataFrame, seed: int) -> DataFrame:
    """units summed up in BUCKETS random buckets."""
    bucket = F.floor(uniform("__k", F.lit(seed)) * BUCKETS).alias("__k")
    return units.groupBy(bucket).agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))


def paired_bootstrap(frame: DataFrame, key: str, base: str, model: str, repetitions: int = 3000, seed: int = 42) -> DataFrame:
    """95 % interval of the mean difference of two absolute errors of the same rows: diff_low, diff_mean, diff_high.

    Rows are dealt at random to BUCKETS buckets and summed up; buckets are resampled, which are as
    exchangeable as rows. What a repetition costs does not grow with the rows.
    """
    d = F.abs(F.col(base)) - F.abs(F.col(model))
    units = frame.select(F.col(key).alias("__k"), d.alias("__s"), F.lit(1).alias("__n")).where("__s is not null")
    return _resampled(_buckets(units, seed), repetitions, seed)


def cluster_bootstrap(frame: DataFrame, cell: str, base: str, model: str, repetitions: int = 3000, seed: int = 42) -> DataFrame:
    """As paired_bootstrap(), resampling whole cells: rows are summed up per cell, and cells in buckets if there are more than these."""
    per = frame.where(F.col(base).isNotNull() & F.col(model).isNotNull()).groupBy(F.col(cell).alias("__k")).agg(F.sum(F.abs(F.col(base)) - F.abs(F.col(model))).alias("__s"), F.count(F.lit(1)).alias("__n"))
    many = per.limit(BUCKETS + 1).count() > BUCKETS
    return _resampled(_buckets(per, seed) if many else per, repetitions, seed)


def ranked(frame: DataFrame, key: str, seed: int, name: str) -> DataFrame:
    """frame with its rows numbered from 0 in order of the digests of key and seed; key is unique.

    Rows are numbered within 4,096 ranges of digests, and ranges by their counts: no task has all rows.
    """
    d = digest(key, F.lit(seed))
    rows = frame.withColumn("__d", d).withColumn("__range", F.conv(F.substring("__d", 1, 3), 16, 10).cast("int"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__d", key))
    return rows.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + own - 1).drop("__d", "__range", "__start")


def permuted(frame: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """frame with column's values dealt anew among rows: the n-th row by one digest gets the value of the n-th by another."""
    own = ranked(frame.drop(column), key, seed, "__rank")
    given = ranked(frame.select(key, column), key, seed + 1, "__rank").select("__rank", column)
    return own.join(given, "__rank").select(*frame.columns)


def permutation_importance(frame: DataFrame, key: str, columns: Sequence[str], score, repeats: int = 3, seed: int = 42) -> list[tuple[str, float]]:
    """Mean rise of score(frame), a number to keep low, when a column is permuted; largest first. columns is a short list."""
    base = score(frame)
    rises = [(c, sum(score(permuted(frame, key, c, seed + 10 * r)) - base for r in range(repeats)) / repeats) for c in columns]
    return sorted(rises, key=lambda x: (-x[1], x[0]))

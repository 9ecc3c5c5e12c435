"""Exact percentiles of groups of any size, by selection in ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values in which ranks are looked for.
CELLS = 4096


def percentiles(frame: DataFrame, value: Column, at: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """g (a struct of the groups, or 0) and the exact percentiles of value by name, linear between ranks; missing values are left out.

    Values are counted in CELLS ranges, finer near zero, and only the ranges that hold a wanted rank are sorted,
    each by itself and after equal values were counted: no task holds a group. Three numbers reach the driver.
    """
    rows = frame.select((F.struct(*groups) if groups else F.lit(0)).alias("g"), value.cast("double").alias("v")).where("v is not null")
    low, high, scale = rows.agg(F.min("v"), F.max(F.nanvl("v", F.lit(None))), F.percentile_approx(F.abs("v"), F.lit(0.5), F.lit(100))).first()
    bent = lambda v: F.signum(v) * F.log1p(F.abs(v) / F.lit(scale or 1.0))
    span = bent(F.lit(high)) - bent(F.lit(low))
    place = F.floor(F.try_divide(bent(F.col("v")) - bent(F.lit(low)), span) * CELLS)
    cell = F.least(F.greatest(F.coalesce(place, F.lit(CELLS)), F.lit(0)), F.lit(CELLS)).cast("int")  # without a span, and for NaN, the last
    rows = rows.withColumn("cell", cell)
    by_cell = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("g", "cell", (F.sum("n").over(by_cell) - F.col("n")).alias("before"), "n", F.sum("n").over(Window.partitionBy("g")).alias("all"))
    wants = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("all") - 1)).alias("h")) for name, p in at.items()])).alias("w")
    wanted = counts.select("g", "cell", "before", "n", wants).select("g", "cell", "before", "n", "w.name", "w.h")
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("h").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("h").alias("rank")))).alias("r")
    wanted = wanted.select("g", "cell", "before", "n", "name", "h", ranks).where("r.rank >= before and r.rank < before + n")
    wanted = wanted.select("g", "cell", "name", "h", F.col("r.side").alias("side"), (F.col("r.rank") - F.col("before")).alias("rank"))
    few = rows.join(wanted.select("g", "cell").distinct(), ["g", "cell"], "left_semi").groupBy("g", "cell", "v").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("g", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = few.select("g", "cell", "v", "n", (F.sum("n").over(within) - F.col("n")).alias("before"))
    found = few.join(wanted, ["g", "cell"]).where("rank >= before and rank < before + n")
    side = lambda name, k: F.max(F.when((F.col("name") == name) & (F.col("side") == k), F.col("v")))
    share = lambda name: F.max(F.when(F.col("name") == name, F.col("h") - F.floor("h")))
    return found.groupBy("g").agg(*[F.when(share(n) == 0, side(n, 0)).otherwise(side(n, 0) * (1 - share(n)) + side(n, 1) * share(n)).alias(n) for n in at])


def with_percentiles(frame: DataFrame, value: Column, at: dict[str, float], groups: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """frame grouped, with the aggregates and the percentiles of value; null for a group without values."""
    if not groups:
        got = percentiles(frame, value, at)
        return frame.agg(*aggregates).join(F.broadcast(got.drop("g")), how="left")  # a row each
    key = F.struct(*groups)
    plain = frame.groupBy(*groups).agg(*aggregates).withColumn("g", key)
    return plain.join(percentiles(frame, value, at, groups), "g", "left").drop("g")

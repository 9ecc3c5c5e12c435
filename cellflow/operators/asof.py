"""As-of and range lookups without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: A time cell is so many tolerances long; readings near its ends are in the next one too.
CELL = 16


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, tolerance: int, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """left with right's columns, matched_ts and offset_s of the nearest row of the same key within tolerance seconds, else null.

    Of two as near, the earlier wins, and of several at one moment that with the smallest columns; one row of right may
    serve several. Null keys and moments match nothing. key, which tells rows of left apart, may be left out. Both sides go through windows of one key and time cell, sorted
    forward and backward: each row takes the last reading up to it and the first after it, so the work is that of a sort,
    however many readings lie near, and a frequent key is spread over its cells.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    width, reach = CELL * tolerance * 1_000_000, tolerance * 1_000_000
    key = F.struct(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)])
    there = us.isNotNull()
    for b in by:
        there = there & F.col(b).isNotNull()
    r = right.where(there).select(key.alias("k"), us.alias("at"), F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)], F.col(ts).alias("ts")).alias("v"))
    r = r.groupBy("k", "at").agg(F.min("v").alias("v"))
    cells = F.array_distinct(F.array(F.floor((F.col("at") - reach) / width), F.floor((F.col("at") + reach) / width)))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    lacking = left.limit(0).select(row.alias("row")).schema["row"].dataType
    reading = F.struct("at", "v")
    r = r.select("k", F.explode(cells).alias("cell"), "at", F.lit(0).alias("side"), reading.alias("reading"), F.lit(None).cast(lacking).alias("row"))
    mine = left.where(there).select(key.alias("k"), F.floor(us / width).alias("cell"), us.alias("at"), F.lit(1).alias("side"), F.lit(None).cast(r.schema["reading"].dataType).alias("reading"), row.alias("row"))
    last = F.last("reading", ignorenulls=True)
    upto = last.over(Window.partitionBy("k", "cell").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = last.over(Window.partitionBy("k", "cell").orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = r.unionByName(mine).select("*", upto.alias("before"), after.alias("after")).where("side = 1")
    early, late = F.col("at") - F.col("before.at"), F.col("after.at") - F.col("at")
    near = F.when((early <= reach) & ((early <= late) | late.isNull()), F.col("before")).when(late <= reach, F.col("after")).when(early <= reach, F.col("before"))
    found = both.select("row", "at", near.alias("n"))
    none = left.where(~F.coalesce(there, F.lit(False))).select(row.alias("row"), F.lit(None).cast("long").alias("at"), F.lit(None).cast(found.schema["n"].dataType).alias("n"))
    named = [F.col(f"n.v.v{i}").alias(f"{c}_matched" if c in left.columns else c) for i, c in enumerate(columns)]
    return found.unionByName(none).select("row.*", *named, F.col("n.v.ts").alias("matched_ts"), ((F.col("n.at") - F.col("at")) / 1e6).alias("offset_s"))


def backward(left: DataFrame, readings: DataFrame, by: str, order: str, value: str, at: str, depth: int = 3) -> DataFrame:
    """left with the last depth readings of the same key at or before order at: value_1 (the last) to value_depth, and age_1 in order units.

    Both sides go through one window per key: the readings carry their predecessors, and each row of
    left takes the last reading before it. Rows of left with a null key or order get nulls.
    """
    w = Window.partitionBy(by).orderBy(order)
    r = readings.where(F.col(value).isNotNull() & F.col(by).isNotNull() & F.col(order).isNotNull())
    packed = F.struct(F.col(order).alias("o"), *[F.lag(value, k).over(w).alias(f"v{k + 1}") if k else F.col(value).alias("v1") for k in range(depth)])
    r = r.select(F.col(by).alias("__by"), F.col(order).cast("double").alias("__at"), F.lit(0).alias("__side"), packed.alias("__reading"), F.lit(None).cast(_row_type(left)).alias("__row"))
    usable = F.col(by).isNotNull() & F.col(at).isNotNull()
    row = F.struct(*left.columns).alias("__row")
    mine = left.where(usable).select(F.col(by).alias("__by"), F.col(at).cast("double").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__reading"].dataType).alias("__reading"), row)
    upto = Window.partitionBy("__by").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = r.unionByName(mine).withColumn("__last", F.last("__reading", ignorenulls=True).over(upto)).where("__side = 1").select("__row", "__last")
    # rows that can match nothing go round the window
    both = both.unionByName(left.where(~usable).select(row, F.lit(None).cast(both.schema["__last"].dataType).alias("__last")))
    out = both.select("__row.*", *[F.col(f"__last.v{k}").alias(f"{value}_{k}") for k in range(1, depth + 1)], F.col("__last.o").alias("__o"))
    return out.withColumn("age_1", F.col(at) - F.col("__o")).drop("__o")


def _row_type(frame: DataFrame):
    return frame.select(F.struct(*frame.columns).alias("r")).schema["r"].dataType


def range_count(left: DataFrame, events: DataFrame, by: str, order: str, low: str, high: str, widest: int, key: Sequence[str]) -> DataFrame:
    """left with n: events of the same key at whole-number orders strictly between low and high, which lie at most widest apart.

    Each row of left is expanded to the orders in its range and meets per-order counts by an equi-join.
    """
    counts = events.groupBy(F.col(by).alias("__by"), F.col(order).alias("__order")).agg(F.count(F.lit(1)).alias("__n"))
    if left.where(F.col(high) - F.col(low) > widest).limit(1).count():
        raise ValueError(f"a range is wider than {widest}")
    wide = left.where(F.col(high) - F.col(low) > 1).select(*key, F.col(by).alias("__own"), F.explode(F.sequence(F.col(low) + 1, F.col(high) - 1)).alias("__at"))
    hits = wide.join(counts, (F.col("__own") == F.col("__by")) & (F.col("__at") == F.col("__order"))).groupBy(*key).agg(F.sum("__n").alias("n"))
    return left.join(hits, list(key), "left").withColumn("n", F.coalesce("n", F.lit(0)))

"""Pairs of consecutive readings, what lies between them, and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def pairs(readings: DataFrame, gap: int | None = 8, cell: str = "cell", order: str = "ord", value: str = "value") -> DataFrame:
    """One row per reading and its predecessor in the cell: interval_id, cell, ord_start, ord_end, gap, start, end, delta, before2, before3.

    gap: only pairs exactly so many slots apart; None for all. before2 and before3 are the readings
    one and two before the start, wherever they lie. Readings with a null value don't count; a cell's
    readings need distinct ordinals. One window per cell gives all of it.
    """
    w = Window.partitionBy(cell).orderBy(order)
    r = readings.where(F.col(value).isNotNull()).select(
        F.col(cell).alias("cell"), F.col(order).alias("ord_end"), F.col(value).alias("end"),
        *[F.lag(value, k).over(w).alias(n) for k, n in ((1, "start"), (2, "before2"), (3, "before3"))],
        *[F.lag(order, k).over(w).alias(n) for k, n in ((1, "ord_start"), (2, "ord_before2"), (3, "ord_before3"))],
    )
    r = r.where(F.col("ord_start").isNotNull()).withColumn("gap", F.col("ord_end") - F.col("ord_start"))
    if gap is not None:
        r = r.where(F.col("gap") == gap)
    return r.withColumn("delta", F.col("end") - F.col("start")).withColumn("interval_id", F.concat_ws("_", "cell", "ord_start", "ord_end"))


def counts_between(rows: DataFrame, gap: int = 8, cell: str = "cell", order: str = "ord", value: str = "value") -> DataFrame:
    """rows with rows_between and readings_between: rows and non-null values of the cell at ordinals strictly between ord - gap and ord.

    A range frame over the cell's window; no join.
    """
    w = Window.partitionBy(cell).orderBy(order).rangeBetween(-(gap - 1), -1)
    return rows.withColumns({"rows_between": F.count(F.lit(1)).over(w), "readings_between": F.count(value).over(w)})


def history(intervals: DataFrame) -> DataFrame:
    """intervals with 13 columns of thermal history, from the start and the two readings before it."""
    last = ("start", "before2", "before3")
    return intervals.withColumns({
        "change_last": F.col("start") - F.col("before2"),
        "change_before": F.col("before2") - F.col("before3"),
        "before1": F.col("start"),
        "last_change": F.col("start") - F.col("before2"),
        "change_before_last": F.col("before2") - F.col("before3"),
        "mean_last2": S.row_mean("start", "before2"),
        "mean_last3": S.row_mean(*last),
        "max_last3": S.row_max(*last),
        "min_last3": S.row_min(*last),
        "range_last3": S.row_max(*last) - S.row_min(*last),
        "std_last3": S.row_std(*last),
        "slope_last3": S.slope("start", "before3"),
        "earlier_readings": S.row_count("before2", "before3"),
    })


def baselines(intervals: DataFrame) -> DataFrame:
    """intervals with the predictions p_last, p_mean2 and p_extrapolated."""
    return intervals.withColumns({
        "p_last": S.baseline_last("start"),
        "p_mean2": S.baseline_mean_of_two("start", "before2"),
        "p_extrapolated": S.baseline_extrapolated("start", "before2"),
    })

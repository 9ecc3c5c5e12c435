"""Five-minute records to slots as mergeable partial aggregates, and slots to intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .windows import MINUTES, first_by, last_by, total

#: Feeding-mode codes; any other is "other". Fixed values.
MODES = tuple(range(18))


def mark_changes(records: DataFrame, mode: str, cell: str = "cell", ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """records with changed: 1 where the mode differs from the cell's record before and both are there.

    tie: columns that order records of one moment.
    """
    before = F.lag(mode).over(Window.partitionBy(cell).orderBy(ts, *tie))
    return records.withColumn("changed", S.flag(before.isNotNull() & F.col(mode).isNotNull() & (before != F.col(mode))))


def electrical(records: DataFrame) -> DataFrame:
    """records with the computed signals: power, resistive power, excess power, difference and ratio of resistances."""
    out = records.withColumns({"power_mw": F.col("imfc") * F.col("umfc") / 1000, "i2r_mw": F.col("imfc") * F.col("imfc") * F.col("rmfc") / 1e6, "r_diff": F.col("rmfc") - F.col("rkfc"), "r_ratio": S.ratio("rmfc", "rkfc")})
    return out.withColumns({"i2_diff_mw": F.col("imfc") * F.col("imfc") * F.col("r_diff") / 1e6, "feed_clean": S.without_sentinel("pal2o3fc")})


def slot_partials(records: DataFrame, signals: Sequence[str], states: Sequence[str] = (), modes: Sequence[str] = (), changes: str | None = None, cell: str = "cell", order: str = "ord", ts: str = "ts") -> DataFrame:
    """One row per cell and slot: records; signal__{mean,std,count,min,max,first,last}; state__{active,fraction,any}; mode__{records,fraction}; changes.

    These merge exactly into any longer period (see merge()); Spark aggregates before the shuffle.
    """
    exprs = [F.count(F.lit(1)).alias("records")]
    for s in signals:
        exprs += [F.avg(s).alias(f"{s}__mean"), F.stddev_samp(s).alias(f"{s}__std"), F.count(s).alias(f"{s}__count"), F.min(s).alias(f"{s}__min"), F.max(s).alias(f"{s}__max"), first_by(s, ts).alias(f"{s}__first"), last_by(s, ts).alias(f"{s}__last")]
    for s in states:
        on = S.flag(F.col(s) > 0)
        exprs += [F.sum(on).alias(f"{s}__active"), F.avg(on.cast("double")).alias(f"{s}__fraction"), F.max(on).alias(f"{s}__any")]
    for m in modes:
        exprs += [F.sum(m).alias(f"{m}__records"), F.avg(F.col(m).cast("double")).alias(f"{m}__fraction")]
    if changes:
        exprs.append(F.sum(changes).alias("changes"))
    return records.groupBy(cell, order).agg(*exprs)


def pooled(count: Column, mean: Column, std: Column) -> tuple[Column, Column, Column]:
    """Count, mean and sample standard deviation of all records behind a group's partials (aggregate expressions)."""
    n, m, s = F.coalesce(count, F.lit(0)).cast("double"), F.coalesce(mean, F.lit(0.0)), F.coalesce(std, F.lit(0.0))
    count_, sum_ = F.sum(n), F.sum(n * m)
    squares = F.sum(s * s * F.greatest(n - 1, F.lit(0.0)) + m * m * n)
    variance = S.ratio(squares - S.ratio(sum_ * sum_, count_), count_ - 1)
    return count_, S.ratio(sum_, count_), F.sqrt(F.when(variance < 0, 0.0).otherwise(variance))


def merge(window: DataFrame, signals: Sequence[str], by: str = "interval_id", step: str = "offset", last: int = 7, recent: int = 3) -> DataFrame:
    """One row per group with signal_{mean,std,min,max,first,last,change,recent_mean} from the slots' partials.

    first and last are those of the first and the last slot of the window, so null if that slot is missing.
    """
    exprs = []
    for s in signals:
        n, mean, std = pooled(F.col(f"{s}__count"), F.col(f"{s}__mean"), F.col(f"{s}__std"))
        first, end = F.max(F.when(F.col(step) == 1, F.col(f"{s}__first"))), F.max(F.when(F.col(step) == last, F.col(f"{s}__last")))
        late = F.col(step) > last - recent
        weighted = F.col(f"{s}__mean") * F.col(f"{s}__count")
        exprs += [mean.alias(f"{s}_mean"), std.alias(f"{s}_std"), F.min(f"{s}__min").alias(f"{s}_min"), F.max(f"{s}__max").alias(f"{s}_max"), first.alias(f"{s}_first"), end.alias(f"{s}_last"), (end - first).alias(f"{s}_change")]
        exprs.append(S.ratio(total(weighted, late), total(f"{s}__count", late)).alias(f"{s}_recent_mean"))
    return window.groupBy(by).agg(*exprs)


def state_features(window: DataFrame, states: Sequence[str], by: str = "interval_id", step: str = "offset", last: int = 7, recent: int = 3) -> DataFrame:
    """One row per group with state_{minutes,fraction,slots,recent_fraction}."""
    late = F.col(step) > last - recent
    exprs = []
    for s in states:
        active = total(f"{s}__active")
        exprs += [(active * MINUTES).alias(f"{s}_minutes"), S.ratio(active, total("records")).alias(f"{s}_fraction"), total(f"{s}__any").alias(f"{s}_slots"), S.ratio(total(f"{s}__active", late), total("records", late)).alias(f"{s}_recent_fraction")]
    return window.groupBy(by).agg(*exprs)


def mode_features(window: DataFrame, modes: Sequence[str], by: str = "interval_id") -> DataFrame:
    """One row per group with mode_{minutes,fraction} and the number of mode changes."""
    exprs = [total("changes").alias("changes")]
    for m in modes:
        exprs += [(total(f"{m}__records") * MINUTES).alias(f"{m}_minutes"), S.ratio(total(f"{m}__records"), total("records")).alias(f"{m}_fraction")]
    return window.groupBy(by).agg(*exprs)


def coverage(window: DataFrame, by: str = "interval_id", least: float = 0.80) -> DataFrame:
    """One row per group: records, expected, coverage, slots found, the lowest coverage of a slot and the number of slots below least."""
    own = F.coalesce(F.col("records"), F.lit(0)) / F.col("expected")
    return window.groupBy(by).agg(
        total("records").alias("records"), total("expected").alias("expected"), S.ratio(total("records"), total("expected")).alias("coverage"),
        F.count("records").alias("slots_found"), F.min(own).alias("min_coverage"), F.sum(S.flag(own < least)).alias("low_slots"),
    )


def eligible(features: DataFrame, least: float = 0.80, slots: int = 6) -> DataFrame:
    return features.where((F.col("coverage") >= least) & (F.col("slots_found") >= slots))

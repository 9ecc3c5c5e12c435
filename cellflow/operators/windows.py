"""The slots before a target: expansion, joins and conditional aggregates over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

MINUTES, HOURS = 5.0, 5.0 / 60.0


def expand(intervals: DataFrame, n: int, backward: bool = False, key: str = "interval_id") -> DataFrame:
    """One row per interval and slot: offset 1..n forward from the start, or lag 1..n backward from the target.

    Columns key, cell, ord, offset (or lag), and the slot's expected records.
    """
    step = "lag" if backward else "offset"
    order = F.col("ord_end") - F.col(step) if backward else F.col("ord_start") + F.col(step)
    out = intervals.select(key, "cell", "ord_start", "ord_end", F.explode(F.sequence(F.lit(1), F.lit(n))).alias(step)).withColumn("ord", order)
    return out.withColumn("expected", S.expected_records(S.slot_of_order("ord"))).drop("ord_start", "ord_end")


def join_slots(expanded: DataFrame, slots: DataFrame) -> DataFrame:
    """expanded with the columns of slots (one row per cell and ord) and found; a missing slot stays, with nulls.

    An equi-join on (cell, ord), in place of a range join. Null keys match nothing.
    """
    return expanded.join(slots.withColumn("found", F.lit(True)), ["cell", "ord"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def total(c: Column | str, where: Column | None = None) -> Column:
    """Sum over a group, 0 where nothing is there."""
    c = S.col(c)
    return F.coalesce(F.sum(c if where is None else F.when(where, c)), F.lit(0.0))


def last_by(c: str, order: str) -> Column:
    """The last value that isn't missing."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def first_by(c: str, order: str) -> Column:
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


#: Aggregates by name, over a column and the column that orders it. Sums of nothing are 0, all others null.
AGGREGATES = {
    "sum": lambda c, o: total(c),
    "mean": lambda c, o: F.avg(c),
    "max": lambda c, o: F.max(c),
    "min": lambda c, o: F.min(c),
    "std": lambda c, o: F.stddev_samp(c),
    "count": lambda c, o: F.count(c),
    "last": last_by,
    "first": first_by,
}


def aggregate(window: DataFrame, matrix: dict[str, Sequence[str]], by: str = "interval_id", order: str = "ord") -> DataFrame:
    """One row per group with column_function for each column of matrix that the window has."""
    exprs = [AGGREGATES[f](c, order).alias(f"{c}_{f}") for c, functions in matrix.items() if c in window.columns for f in functions]
    return window.groupBy(by).agg(*exprs)


#: Aggregates of the columns of a slot-level window. Fixed values.
MATRIX = {
    "found": ("sum",), "tb": ("count",), "tbd": ("last",), "tbc": ("last",), "rth": ("sum", "mean", "max", "min", "last"), "rth_positive": ("sum",), "rth_negative": ("sum",),
    "hb": ("count",), "hbd": ("last",), "hbc": ("last",), "hm": ("count",), "hmd": ("last",), "hmc": ("last",), "bath_off": ("mean", "min", "max", "last"), "bath_low": ("sum",),
    "metal_off": ("mean", "min", "max", "last"), "alf3": ("count", "last"), "alf3d": ("last",), "rc": ("sum", "mean", "max", "min", "last"), "rc_positive": ("sum",), "rc_negative": ("sum",),
    "ndalf3": ("sum", "max", "last"), "amna2co3": ("sum", "max"), "ndal2o3": ("sum", "mean", "max", "last"), "ntea": ("sum", "max", "last"), "dtea": ("sum", "max"), "sea": ("sum", "max", "last"),
    "with_effect": ("sum",), "wrmi": ("mean", "max", "min", "last"), "smrwfc": ("mean", "max", "last"), "v_acd": ("mean", "max", "min", "std", "last", "sum"), "imm": ("mean", "max", "min", "std", "last", "sum"),
    "power": ("mean", "max", "min", "std", "last", "sum"), "rkm": ("mean", "last"), "rrm": ("mean", "last"), "mblthe": ("sum", "max", "min"), "mblc": ("sum", "max", "min"), "agebsq": ("last",),
}


def window_inputs(window: DataFrame) -> DataFrame:
    """window with what follows from its columns, as far as it has them: signed parts of rth and rc, power, effects, heights off target."""
    have = set(window.columns)
    wanted = {
        "rth_positive": (("rth",), lambda: S.positive_part("rth")), "rth_negative": (("rth",), lambda: S.negative_part("rth")),
        "rc_positive": (("rc",), lambda: S.positive_part("rc")), "rc_negative": (("rc",), lambda: S.negative_part("rc")),
        "power": (("imm", "v_acd"), lambda: F.col("imm") * F.col("v_acd")),
        "with_effect": (("ntea",), lambda: S.flag(F.col("ntea") > 0)),
        "bath_off": (("hbd", "hbc"), lambda: F.col("hbd") - F.col("hbc")), "bath_low": (("hbd", "hbc"), lambda: S.nullable_flag(F.col("hbd") - F.col("hbc") < 0)),
        "metal_off": (("hmd", "hmc"), lambda: F.col("hmd") - F.col("hmc")),
    }
    return window.withColumns({n: make() for n, (needs, make) in wanted.items() if set(needs) <= have})


def pivot_lags(window: DataFrame, columns: Sequence[str], lags: int = 7, by: str = "interval_id", step: str = "lag") -> DataFrame:
    """One row per group with column_lagK for each of the lags; one conditional aggregate each, so no pivot shuffle."""
    return window.groupBy(by).agg(*[F.max(F.when(F.col(step) == k, F.col(c))).alias(f"{c}_lag{k}") for c in columns for k in range(1, lags + 1)])


def ratios(features: DataFrame) -> DataFrame:
    """features with the derived flags, shares and interactions, for the input columns that it has."""
    none = F.lit(0.0)
    wanted = {
        "manual_active": (("rth_sum",), lambda: S.flag(F.coalesce("rth_sum", none) != 0)),
        "had_effect": (("ntea_sum",), lambda: S.flag(F.coalesce("ntea_sum", none) > 0)),
        "had_soda": (("amna2co3_sum",), lambda: S.flag(F.coalesce("amna2co3_sum", none) > 0)),
        "bath_moved": (("mblc_sum",), lambda: S.flag(F.coalesce("mblc_sum", none) != 0)),
        "low_last": (("bath_off_last",), lambda: S.nullable_flag(F.col("bath_off_last") < 0)),
        "low_share": (("bath_low_sum", "found_sum"), lambda: S.ratio("bath_low_sum", "found_sum")),
        "phase": (("agebsq_last",), lambda: S.life_phase("agebsq_last")),
        "resistance_gap": (("rrm_mean", "rkm_mean"), lambda: F.col("rrm_mean") - F.col("rkm_mean")),
        "effect_energy": (("dtea_sum", "sea_sum"), lambda: F.coalesce("dtea_sum", none) * F.coalesce("sea_sum", none)),
        "off_target": (("tbd_last", "tbc_last"), lambda: F.col("tbd_last") - F.col("tbc_last")),
        "rth_per_height": (("rth_sum", "hbd_last"), lambda: S.ratio("rth_sum", "hbd_last")),
        "rth_per_liquid": (("rth_sum", "hbd_last", "hmd_last"), lambda: S.ratio("rth_sum", F.col("hbd_last") + F.col("hmd_last"))),
        "rc_per_height": (("rc_sum", "hbd_last"), lambda: S.ratio("rc_sum", "hbd_last")),
        "power_sum": (("rc_sum", "rth_sum"), lambda: F.col("rc_sum") + F.col("rth_sum")),
        "power_positive": (("rc_positive_sum", "rth_positive_sum"), lambda: F.col("rc_positive_sum") + F.col("rth_positive_sum")),
        "power_negative": (("rc_negative_sum", "rth_negative_sum"), lambda: F.col("rc_negative_sum") + F.col("rth_negative_sum")),
        "start_by_chemistry": (("start", "alf3d_last"), lambda: F.col("start") * F.col("alf3d_last")),
        "start_by_rth": (("start", "rth_sum"), lambda: F.col("start") * F.col("rth_sum")),
    }
    return features.withColumns({n: make() for n, (needs, make) in wanted.items() if set(needs) <= set(features.columns)})

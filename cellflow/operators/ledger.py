"""Backward-looking features at several scales over the slots before a target.

Two ways give the same columns. over_slots() reads each scale as a range frame of the cell's window over the
slot partials, so nothing is expanded or joined: one shuffle and one sort per cell, of as many rows
as there are slots and targets. features() and what builds on it aggregate rows that windows.expand()
has made, in one conditional aggregation whatever the number of scales.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .windows import HOURS, MINUTES

SIZES = (1, 2, 3, 6, 12, 21)
BANDS = {"lag1": (1, 1), "lag2_3": (2, 3), "lag4_6": (4, 6), "lag7_12": (7, 12), "lag13_21": (13, 21)}
CUMULATIVE = {f"{n}st": (1, n) for n in SIZES}
#: Integrals and minutes are null below this share of expected records.
COMPLETE = 0.80


class Span:
    """Aggregates of the slots of a span of lags: each is made once, under a name, and used by that name."""

    def __init__(self, name: str, first: int, last: int, aggregate: Callable[[Callable, Column], Column]):
        self.name, self.first, self.last, self.aggregate, self.made = name, first, last, aggregate, {}

    def _get(self, f: Callable, c: str, value: Column) -> Column:
        alias = f"__{f.__name__}__{c}__{self.name}"
        self.made.setdefault(alias, self.aggregate(f, value).alias(alias))
        return F.col(alias)

    def total(self, c: str, value: Column | None = None) -> Column:
        return F.coalesce(self._get(F.sum, c, F.col(c) if value is None else value), F.lit(0.0))

    def count(self, c: str) -> Column:
        return self._get(F.count, c, F.col(c))

    def max(self, c: str, value: Column | None = None) -> Column:
        return self._get(F.max, c, F.col(c) if value is None else value)

    def min(self, c: str) -> Column:
        return self._get(F.min, c, F.col(c))


def _grouped(name: str, first: int, last: int) -> Span:
    inside = F.col("lag").between(first, last)
    return Span(name, first, last, lambda f, value: f(F.when(inside, value)))


def _framed(name: str, first: int, last: int) -> Span:
    frame = Window.partitionBy("cell").orderBy("ord").rangeBetween(-last, -first)
    return Span(name, first, last, lambda f, value: f(value).over(frame))


def _columns(span: Span, expected: Column, signals: Sequence[str], integrals: Sequence[str] = (), signed: Sequence[str] = (), extremes: Sequence[str] = (), states: Sequence[str] = (), modes: Sequence[str] = (), changes: bool = False) -> list[Column]:
    """Of one span: coverage and found; signals' mean, integral, signed integrals and extremes; states' minutes; modes' fraction; changes.

    A signed integral adds up the positive (negative) slot means. Integrals, minutes and changes are
    null where the span's coverage is below COMPLETE.
    """
    name = span.name
    cover = S.ratio(span.total("records"), expected)
    complete = cover >= COMPLETE
    out = [cover.alias(f"{name}_coverage"), span.count("records").alias(f"{name}_found")]
    for s in signals:
        mean, count = F.col(f"{s}__mean"), F.col(f"{s}__count")
        whole = span.total(f"{s}__whole", mean * count)
        out.append(S.ratio(whole, span.total(f"{s}__count")).alias(f"{s}_{name}_mean"))
        if s in integrals:
            out.append(F.when(complete, whole * HOURS).alias(f"{s}_{name}_integral"))
        if s in signed:  # of the slots' means
            out.append(F.when(complete, span.total(f"{s}__above", S.positive_part(mean) * count) * HOURS).alias(f"{s}_{name}_positive_integral"))
            out.append(F.when(complete, span.total(f"{s}__below", S.negative_part(mean) * count) * HOURS).alias(f"{s}_{name}_negative_integral"))
        if s in extremes:
            out += [span.max(f"{s}__max").alias(f"{s}_{name}_max"), span.min(f"{s}__min").alias(f"{s}_{name}_min")]
    out += [F.when(complete, span.total(f"{s}__active") * MINUTES).alias(f"{s}_{name}_minutes") for s in states]
    out += [S.ratio(span.total(f"{m}__records"), span.total("records")).alias(f"{m}_{name}_fraction") for m in modes]
    if changes:
        out.append(F.when(complete, span.total("changes")).alias(f"changes_{name}"))
    return out


def _contrasts(frame: DataFrame, signals: Sequence[str]) -> DataFrame:
    """frame with the contrasts of means 1 vs 6 and 3 vs 12 that its columns allow."""
    pairs = [(s, a, b) for s in signals for a, b in ((1, 6), (3, 12)) if {f"{s}_{a}st_mean", f"{s}_{b}st_mean"} <= set(frame.columns)]
    return frame.withColumns({f"{s}_{a}st_vs_{b}st": F.col(f"{s}_{a}st_mean") - F.col(f"{s}_{b}st_mean") for s, a, b in pairs})


def _beside(targets: DataFrame, slots: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Slots and targets one under the other: cell, ord, key (null for a slot) and the slots' columns (null for a target)."""
    mine = targets.select("cell", F.col("ord_end").alias("ord"), key, *[F.lit(None).cast(slots.schema[c].dataType).alias(c) for c in columns])
    return slots.select("cell", "ord", F.lit(None).cast(targets.schema[key].dataType).alias(key), *columns).unionByName(mine)


def over_slots(targets: DataFrame, slots: DataFrame, spans: dict[str, tuple[int, int]], signals: Sequence[str], contrasts: bool = False, expected: Callable[[Column], Column] = lambda order: S.expected_records(S.slot_of_order(order)), key: str = "interval_id", **more) -> DataFrame:
    """One row per target with the columns of each span of lags; see _columns().

    targets: key (never null), cell, ord_end; slots: one row per cell and ord, of highfreq.slot_partials().
    expected: the records that the slot of an ordinal should have. Targets with a null cell have no slots.
    """
    columns = [c for c in slots.columns if c not in ("cell", "ord")]
    made, wanted = [], []
    for name, (first, last) in spans.items():
        span = _framed(name, first, last)
        due = F.aggregate(F.sequence(F.lit(first), F.lit(last)), F.lit(0.0), lambda total, lag: total + expected(F.col("ord") - lag))
        wanted += _columns(span, due, signals, **more)
        made += span.made.values()
    rows = _beside(targets, slots.where("cell is not null"), key, columns).select(key, "cell", "ord", *made)
    out = rows.where(F.col(key).isNotNull()).select(key, *wanted)
    return _contrasts(out, signals) if contrasts else out


def sequence_over_slots(targets: DataFrame, slots: DataFrame, signals: Sequence[str], states: Sequence[str] = (), modes: Sequence[str] = (), lags: int = 7, expected: Callable[[Column], Column] = lambda order: S.expected_records(S.slot_of_order(order)), key: str = "interval_id") -> DataFrame:
    """sequence() over slots, as over_slots() is features()."""
    columns = [c for c in slots.columns if c not in ("cell", "ord")]
    made, wanted = [], []
    for k in range(1, lags + 1):
        span = _framed(f"lag{k}", k, k)
        wanted.append(S.ratio(span.max("records"), expected(F.col("ord") - k)).alias(f"coverage_lag{k}"))
        wanted += [span.max(f"{s}__mean").alias(f"{s}_lag{k}_mean") for s in signals]
        wanted += [(span.max(f"{s}__active") * MINUTES).alias(f"{s}_lag{k}_minutes") for s in states]
        wanted += [S.ratio(span.max(f"{m}__records"), span.max("records")).alias(f"{m}_lag{k}_fraction") for m in modes]
        made += span.made.values()
    rows = _beside(targets, slots.where("cell is not null"), key, columns).select(key, "cell", "ord", *made)
    return rows.where(F.col(key).isNotNull()).select(key, *wanted)


def features(window: DataFrame, spans: dict[str, tuple[int, int]], signals: Sequence[str], by: str = "interval_id", **more) -> DataFrame:
    """One row per group of lag rows with the columns of each span; see _columns(). The window has its slots' expected records."""
    made, wanted = [], []
    for name, (first, last) in spans.items():
        span = _grouped(name, first, last)
        wanted += _columns(span, span.total("expected"), signals, **more)
        made += span.made.values()
    return window.groupBy(by).agg(*made).select(by, *wanted)


def cumulative(window: DataFrame, signals: Sequence[str], sizes: Sequence[int] = SIZES, contrasts: bool = True, **more) -> DataFrame:
    """features() over the last 1, 2, 3, 6, 12 and 21 slots, and the contrasts of means 1 vs 6 and 3 vs 12."""
    out = features(window, {f"{n}st": (1, n) for n in sizes}, signals, **more)
    return _contrasts(out, signals) if contrasts else out


def bands(window: DataFrame, signals: Sequence[str], spans: dict[str, tuple[int, int]] = BANDS, **more) -> DataFrame:
    """features() over disjoint bands of lags."""
    return features(window, spans, signals, **more)


def sequence(window: DataFrame, signals: Sequence[str], states: Sequence[str] = (), modes: Sequence[str] = (), lags: int = 7, by: str = "interval_id") -> DataFrame:
    """One row per group with the slots' own values in order: signal_lagK_mean, state_lagK_minutes, mode_lagK_fraction, coverage_lagK."""
    at = lambda k, c: F.max(F.when(F.col("lag") == k, c))
    exprs = []
    for k in range(1, lags + 1):
        exprs.append(at(k, S.ratio("records", "expected")).alias(f"coverage_lag{k}"))
        exprs += [at(k, F.col(f"{s}__mean")).alias(f"{s}_lag{k}_mean") for s in signals]
        exprs += [at(k, F.col(f"{s}__active") * MINUTES).alias(f"{s}_lag{k}_minutes") for s in states]
        exprs += [at(k, S.ratio(f"{m}__records", "records")).alias(f"{m}_lag{k}_fraction") for m in modes]
    return window.groupBy(by).agg(*exprs)


def height_interactions(features_: DataFrame, i2r: str, excess: str, rth: str, feed: str, sizes: Sequence[int] = (6, 12, 21)) -> DataFrame:
    """features_ with integrals per bath or liquid height, and excess power times the share of low-bath slots."""
    liquid = F.col("hbd_last") + F.col("hmd_last")
    more = {}
    for n in sizes:
        more |= {
            f"i2r_{n}st_per_liquid": S.ratio(f"{i2r}_{n}st_integral", liquid),
            f"excess_{n}st_per_bath": S.ratio(f"{excess}_{n}st_integral", "hbd_last"),
            f"rth_{n}st_per_bath": S.ratio(f"{rth}_{n}st_integral", "hbd_last"),
            f"feed_{n}st_per_bath": S.ratio(f"{feed}_{n}st_integral", "hbd_last"),
            f"excess_{n}st_by_low": F.col(f"{excess}_{n}st_integral") * F.col("low_share"),
        }
    return features_.withColumns(more)

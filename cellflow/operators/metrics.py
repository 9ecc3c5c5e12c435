"""Error and classification metrics, by segments, groups, bins and overlapping subgroups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .quantiles import with_percentiles

#: Subgroups of an interval; they overlap. Each is a condition on start, end and delta.
REGIMES = {
    "all": "true",
    "cooling": "delta <= -5",
    "stable": "delta > -5 AND delta < 5",
    "heating": "delta >= 5",
    "hot_start": "start >= 970",
    "hot_target": "end >= 970",
    "hot_and_heating": "end >= 970 AND delta >= 5",
}


def errors(frame: DataFrame, predictions: Sequence[str], actual: str = "end") -> DataFrame:
    """frame with error_P and abs_error_P for each prediction."""
    return frame.withColumns({n: e for p in predictions for n, e in ((f"error_{p}", F.col(p) - F.col(actual)), (f"abs_error_{p}", F.abs(F.col(p) - F.col(actual))))})


def long(frame: DataFrame, predictions: Sequence[str], actual: str = "end", keep: Sequence[str] = ()) -> DataFrame:
    """A row per row and prediction: keep, variant, predicted, error (rows without one are left out)."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("variant"), F.col(p).cast("double").alias("predicted")) for p in predictions]))
    out = frame.select(*keep, F.col(actual).alias("__actual"), each.alias("__e")).select(*keep, "__e.variant", "__e.predicted", (F.col("__e.predicted") - F.col("__actual")).alias("error"))
    return out.where(F.col("error").isNotNull())


#: Percentiles of a summary.
LEVELS = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def summary(error: str = "error") -> list[Column]:
    """Aggregates of an error column: rows, mae, rmse, bias and percent within 3, 5 and 10."""
    a = F.abs(error)
    within = lambda k: (F.avg(F.when(a <= k, 100.0).when(a.isNotNull(), 0.0))).alias(f"within_{k}_pct")
    return [F.count(error).alias("rows"), F.avg(a).alias("mae"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"), F.avg(error).alias("bias"), within(3), within(5), within(10)]


def by(long_: DataFrame, *groups: str) -> DataFrame:
    """summary() and the percentiles of absolute errors (median, p75, p90, p95) per group."""
    return with_percentiles(long_, F.abs("error"), LEVELS, groups, summary())


def by_regime(frame: DataFrame, predictions: Sequence[str], actual: str = "end", regimes: dict[str, str] = REGIMES, keep: Sequence[str] = ()) -> DataFrame:
    """Metrics by variant and overlapping subgroup; a row counts in each subgroup it is in, and empty subgroups have no row."""
    names = F.filter(F.array(*[F.when(F.expr(c), n) for n, c in regimes.items()]), lambda x: x.isNotNull())
    tagged = frame.withColumn("regime", F.explode(names))
    return by(long(tagged, predictions, actual, ["regime", *keep]), "regime", "variant", *keep)


def by_bin(long_: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Rows and mae for each label, in order, also for labels without rows (0 and null), and for a missing label if there is one."""
    got = long_.groupBy(column).agg(F.count("error").alias("rows"), F.avg(F.abs("error")).alias("mae"))
    every = long_.sparkSession.createDataFrame([(l, i) for i, l in enumerate(labels)], f"__label string, position int")
    out = every.join(got, F.col("__label").eqNullSafe(F.col(column)), "full").select(F.coalesce("__label", column).alias(column), "position", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "mae")
    return out


def by_each(long_: DataFrame, columns: Sequence[str], least: int = 1) -> DataFrame:
    """Metrics grouped by each of the columns in turn, null as a group of its own: grouping, value, rows, mae, bias. Groups of fewer than least rows are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("value")) for c in columns]))
    got = long_.withColumn("__g", each).groupBy("__g.grouping", "__g.value").agg(F.count("error").alias("rows"), F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"))
    return got.where(F.col("rows") >= least)


def weighted_mean(metrics: DataFrame, value: str, rows: str, *groups: str) -> DataFrame:
    """Mean of a metric over its rows, weighted by rows."""
    return metrics.groupBy(*groups).agg(F.sum(rows).alias(rows), S.ratio(F.sum(F.col(value) * F.col(rows)), F.sum(rows)).alias(value))


def wide(metrics: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """metrics pivoted: a row per row, a column per listed value."""
    return metrics.groupBy(row).agg(*[F.max(F.when(F.col(column) == v, F.col(value))).alias(v) for v in values])


def improvement(metrics: DataFrame, base: str, value: str = "mae", variant: str = "variant") -> DataFrame:
    """Each variant with its metric, the base variant's, and the percent by which it is below. The base's row is broadcast."""
    b = metrics.where(F.col(variant) == base).select(F.col(value).alias("base")).groupBy().agg(F.max("base").alias("base"))
    return metrics.join(F.broadcast(b)).select(variant, value, "base", S.improvement("base", value).alias("improvement_pct"))


def best(metrics: DataFrame, value: str, *groups: str, variant: str = "variant") -> DataFrame:
    """The variant with the smallest metric in each group; the first by name of equals."""
    return metrics.groupBy(*groups).agg(F.min_by(F.struct(variant, value), F.struct(value, variant)).alias("b")).select(*groups, f"b.{variant}", f"b.{value}")


def shrunk_residuals(history: DataFrame, cell: str, residual: str, rows: float = 20.0) -> DataFrame:
    """Per cell: its mean residual's deviation from that of all, times n / (n + rows): cell, n, deviation."""
    all_ = history.groupBy().agg(F.avg(residual).alias("__all"))
    each = history.groupBy(cell).agg(F.avg(residual).alias("__mean"), F.count(residual).alias("n")).join(F.broadcast(all_))
    return each.select(cell, "n", ((F.col("__mean") - F.col("__all")) * F.col("n") / (F.col("n") + rows)).alias("deviation"))


def calibrated(frame: DataFrame, deviations: DataFrame, cell: str, prediction: str, share: float = 0.80) -> DataFrame:
    """frame with prediction_calibrated: the cell's deviation added by share, nothing for a cell without history."""
    return frame.join(deviations.select(cell, "deviation"), cell, "left").withColumn(f"{prediction}_calibrated", F.col(prediction) + share * F.coalesce("deviation", F.lit(0.0)))


# classification


def confusion(frame: DataFrame, actual: str, predicted: str, probability: str | None = None, *groups: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, specificity, accuracy, and the Brier score where there is a probability. Rates of nothing are 0."""
    a, p = F.col(actual).cast("int"), F.col(predicted).cast("int")
    count = lambda x, y: F.sum(F.when((a == x) & (p == y), 1).otherwise(0)).alias(("t" if x == y else "f") + ("p" if y else "n"))
    more = [F.avg(F.pow(F.col(probability) - a, 2)).alias("brier")] if probability else []
    c = frame.groupBy(*groups).agg(count(1, 1), count(0, 1), count(1, 0), count(0, 0), *more)
    rate = lambda x, *of: F.coalesce(S.ratio(x, sum((F.col(o) for o in of), F.lit(0))), F.lit(0.0))
    c = c.withColumns({"precision": rate("tp", "tp", "fp"), "recall": rate("tp", "tp", "fn"), "specificity": rate("tn", "tn", "fp"), "f1": rate(2 * F.col("tp"), "tp", "tp", "fp", "fn")})
    return c.withColumn("accuracy", rate(F.col("tp") + F.col("tn"), "tp", "fp", "fn", "tn"))


def best_threshold(frame: DataFrame, actual: str, probability: str, thresholds: Sequence[float] = tuple(k / 100 for k in range(5, 96))) -> DataFrame:
    """The threshold with the largest (F1, precision, threshold): one row. Thresholds are exploded onto counts per probability, not onto rows."""
    per = frame.groupBy(F.col(probability).alias("__p")).agg(F.sum(F.col(actual).cast("int")).alias("__pos"), F.count(F.lit(1)).alias("__n"))
    t = per.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    hit = F.col("__p") >= F.col("threshold")
    c = t.groupBy("threshold").agg(F.sum(F.when(hit, F.col("__pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("__n") - F.col("__pos")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("__pos")).otherwise(0)).alias("fn"))
    c = c.withColumns({"precision": F.coalesce(S.ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "f1": F.coalesce(S.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))})
    top = F.max(F.struct("f1", "precision", "threshold")).alias("b")
    return c.groupBy().agg(top).select("b.threshold", "b.f1", "b.precision")


#: Ranges of probabilities within which, and then over which, running sums go.
RANGES = 4096


def ranking(frame: DataFrame, actual: str, probability: str) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision (step sums): one row.

    Rows are counted per probability first. Running sums go within RANGES even ranges of
    probabilities and over the ranges' totals, so no task has all probabilities. Two numbers reach the driver.
    """
    per = frame.groupBy(F.col(probability).cast("double").alias("p")).agg(F.sum(F.col(actual).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    low, high = per.agg(F.min("p"), F.max("p")).first()
    cell = F.coalesce(F.least(F.floor(F.try_divide(F.col("p") - F.lit(low), F.lit(high) - F.lit(low)) * RANGES), F.lit(RANGES - 1)), F.lit(RANGES)).cast("int")
    per = per.withColumn("range", cell if low is not None else F.lit(0))
    totals = per.groupBy("range").agg(F.sum("pos").alias("range_pos"), F.sum("n").alias("range_n"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("range", F.coalesce(F.sum("range_pos").over(above), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("range_n").over(above), F.lit(0)).alias("n_above"), F.sum("range_pos").over(every).alias("all_pos"), F.sum(F.col("range_n") - F.col("range_pos")).over(every).alias("all_neg"))
    down = Window.partitionBy("range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = per.join(F.broadcast(totals), "range")  # RANGES + 1 rows at most
    r = r.select("pos", (F.col("n") - F.col("pos")).alias("neg"), (F.sum("pos").over(down) + F.col("pos_above")).alias("tp"), (F.sum("n").over(down) + F.col("n_above")).alias("all"), "all_pos", "all_neg")
    auc = F.sum((F.col("tp") - F.col("pos") / 2) * F.col("neg"))
    return r.groupBy().agg(S.ratio(auc, F.max(F.col("all_pos") * F.col("all_neg"))).alias("auc"), F.sum(S.ratio(F.col("pos") * F.col("tp"), F.col("all") * F.col("all_pos"))).alias("average_precision"))


def class_recalls(frame: DataFrame, actual: str, predicted: str, classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Per actual class: rows, how many were predicted as each class, and the recall."""
    counts = [F.sum(F.when(F.col(predicted) == k, 1).otherwise(0)).alias(f"as_{k}") for k in classes]
    return frame.groupBy(actual).agg(F.count(F.lit(1)).alias("rows"), *counts, F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("recall"))


def prevalence(frame: DataFrame, label: str, classes: Sequence) -> DataFrame:
    return frame.groupBy().agg(*[F.avg(F.when(F.col(label) == k, 1.0).otherwise(0.0)).alias(f"share_{k}") for k in classes])


def hot_cases(long_: DataFrame, condition: Column) -> DataFrame:
    """Of the rows that meet the condition, by variant: rows, percent predicted too low, too low by 5 or more, p90 of absolute errors."""
    part = long_.where(condition)
    pct = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return with_percentiles(part, F.abs("error"), {"p90": 0.9}, ["variant"], [F.count(F.lit(1)).alias("rows"), pct(F.col("error") < 0).alias("under_pct"), pct(F.col("error") <= -5).alias("under_5_pct")])


def side_by_side(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Rows that two results share by keys; columns that both have get the suffixes."""
    both = [c for c in a.columns if c in b.columns and c not in keys]
    named = lambda f, s: f.select(*keys, *[F.col(c).alias(c + s if c in both else c) for c in f.columns if c not in keys])
    return named(a, suffixes[0]).join(named(b, suffixes[1]), list(keys))


def extremes(metrics: DataFrame, value: str, n: int, worst: bool = True) -> DataFrame:
    """The n rows with the largest (or smallest) value, the first by the other columns of equals."""
    others = [c for c in metrics.columns if c != value]
    return metrics.orderBy(F.desc_nulls_last(value) if worst else F.asc_nulls_last(value), *others).limit(n)


def largest_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of two results: rows on both sides and on one, and the largest absolute difference of each column."""
    j = a.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in columns], F.lit(1).alias("__in_a")).join(b.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns], F.lit(1).alias("__in_b")), list(keys), "full")
    both = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()
    return j.groupBy().agg(F.sum(S.flag(both)).alias("matched"), F.sum(S.flag(~both)).alias("unmatched"), *[F.max(F.abs(F.col(f"__a_{c}") - F.col(f"__b_{c}"))).alias(f"max_diff_{c}") for c in columns])


def top_contributions(frame: DataFrame, columns: Sequence[str], key: str, n: int = 3) -> DataFrame:
    """key and the names and values of the n columns with the largest absolute values, the first by name of equals."""
    items = F.array_sort(F.array(*[F.struct((-F.abs(F.coalesce(F.col(c), F.lit(0.0)))).alias("o"), F.lit(c).alias("name"), F.col(c).alias("v")) for c in columns]))
    return frame.select(key, *[x.alias(f"{w}_{k + 1}") for k in range(n) for w, x in (("name", F.get(items, F.lit(k))["name"]), ("value", F.get(items, F.lit(k))["v"]))])

"""Profiles of tables: types, nulls, duplicates, cadence, coverage, codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .quantiles import percentiles, with_percentiles


def _unpivot(agg: DataFrame, names: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One row per name of an aggregate that has name__field columns."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"`{n}__{f}`").cast(t).alias(f) for f, t in fields.items()]) for n in names]))
    return agg.select(rows.alias("r")).select("r.*")


def profile(frame: DataFrame, examples: int = 5) -> DataFrame:
    """Per column: type, rows, nulls, null share, distinct values, the first examples in order, and whether its values look like numbers (80 % or more).

    One scan: values are counted by column and value, summed up before the shuffle; examples are cut down to a few per
    task before they meet.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in frame.columns])).alias("e")
    counts = frame.select(each).groupBy("e.column", "e.v").agg(F.count(F.lit(1)).alias("n"))
    there = F.when(F.col("v").isNotNull(), F.col("n"))
    out = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("v").alias("distinct_values"),
        S.ratio(F.sum(F.when(S.decimal_comma("v").isNotNull(), F.col("n")).otherwise(F.when(F.col("v").isNotNull(), 0))), F.sum(there)).alias("numeric_share"),
    )
    every = frame.sparkSession.createDataFrame([(n, t) for n, t in frame.dtypes], "column string, type string")  # also of a table without rows
    out = every.join(out, "column", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("rows", "nulls", "distinct_values")})
    out = out.select("column", "rows", "nulls", "distinct_values", "numeric_share", "type", S.ratio(F.col("nulls") * 100, "rows").alias("null_pct"), F.coalesce(F.col("numeric_share") >= 0.8, F.lit(False)).alias("looks_numeric"))
    if not examples:
        return out
    first = F.row_number().over(Window.partitionBy("column").orderBy("v"))
    picked = counts.where("v is not null").select("column", "v", first.alias("nth")).where(F.col("nth") <= examples)
    return out.join(picked.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("examples")), "column", "left")


def null_shares(frame: DataFrame, top: int | None = None) -> DataFrame:
    """column and null_pct, the largest first by then name; only the first top of them if given."""
    agg = frame.agg(*[(F.avg(F.when(F.col(f"`{c}`").isNull(), 100.0).otherwise(0.0))).alias(f"{c}__null_pct") for c in frame.columns])
    out = _unpivot(agg, frame.columns, {"null_pct": "double"}).orderBy(F.desc("null_pct"), "column")
    return out.limit(top) if top else out


def constant_columns(frame: DataFrame) -> DataFrame:
    """Columns with at most one distinct value that isn't null, and how many they have."""
    ends = [(F.min(f"`{c}`"), F.max(f"`{c}`")) for c in frame.columns]
    agg = frame.agg(*[F.when(low.isNull(), 0).when(low == high, 1).otherwise(2).alias(f"{c}__distinct_values") for c, (low, high) in zip(frame.columns, ends, strict=True)])
    return _unpivot(agg, frame.columns, {"distinct_values": "long"}).where("distinct_values <= 1")


def encoding(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: nulls, zeros, positives, negatives."""
    exprs = [F.count_if(test(F.col(c))).alias(f"{c}__{n}") for c in columns for n, test in (("nulls", lambda x: x.isNull()), ("zeros", lambda x: x == 0), ("positives", lambda x: x > 0), ("negatives", lambda x: x < 0))]
    return _unpivot(frame.agg(*exprs), columns, dict.fromkeys(("nulls", "zeros", "positives", "negatives"), "long"))


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    """Values with their number of rows, null included, most frequent first."""
    return frame.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.col(column).asc_nulls_last())


def quantiles(frame: DataFrame, column: str, at: Sequence[float] = (0.01, 0.5, 0.99), *groups: str) -> DataFrame:
    """count, mean, std, min, max and exact quantiles (linear between ranks)."""
    names = {f"p{round(p * 100):02d}": p for p in at}
    return with_percentiles(frame, F.col(column), names, groups, [F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")])


def duplicates(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, keys, extra rows beyond the first of a key, rows of keys that come twice or more. Null keys are equal."""
    n = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") - 1).alias("extra"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("affected"))


def gaps(frame: DataFrame, cell: str = "cell", ts: str = "ts") -> DataFrame:
    """frame with gap_s: seconds since the cell's row before."""
    w = Window.partitionBy(cell).orderBy(ts)
    return frame.withColumn("gap_s", _seconds(F.col(ts)) - _seconds(F.lag(ts).over(w)))


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def shared_gap_hour(frame: DataFrame, least_s: float, cell: str = "cell", ts: str = "ts") -> DataFrame:
    """The hour in which most cells end a gap of at least least_s seconds, the earliest of equals: hour, cells."""
    hours = gaps(frame, cell, ts).where(F.col("gap_s") >= least_s).groupBy(F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(F.countDistinct(cell).alias("cells"))
    return hours.orderBy(F.desc("cells"), "hour").limit(1)


def cell_rows(frame: DataFrame, cell: str = "cell") -> DataFrame:
    """One row: cells, and the smallest, median and largest number of rows of a cell."""
    return frame.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("cells"), F.min("n").alias("min_rows"), F.median("n").alias("median_rows"), F.max("n").alias("max_rows"))


def ambiguous(frame: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return frame.groupBy(key).agg(F.countDistinct(value).alias("distinct_values")).where("distinct_values > 1")


def month_coverage(frame: DataFrame, ts: str, cell: str, cells: int, per_day: int = 288) -> DataFrame:
    """Per month: rows, cells, rows that a full grid would have, and the share of them."""
    m = frame.groupBy(S.month(ts).alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(cell).alias("cells"), F.max(F.last_day(ts)).alias("__end"))
    m = m.withColumn("expected", S.expected_month_rows("__end", cells, per_day)).drop("__end")
    return m.withColumn("coverage", S.ratio("rows", "expected"))


def code_profile(events: DataFrame, code: str, ts: str, cell: str, value: str, codes: Sequence | None = None) -> DataFrame:
    """Per code: rows, cells, first and last moment, values that are there, their mean, median and 90th percentile."""
    e = events.where(F.col(code).isin(*codes)) if codes else events
    return with_percentiles(e, F.col(value), {"median_value": 0.5, "p90_value": 0.9}, [code], [F.count(F.lit(1)).alias("rows"), F.countDistinct(cell).alias("cells"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(value).alias("with_value"), F.avg(value).alias("mean_value")])


def condition_counts(frame: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """One row: how many rows meet each condition."""
    return frame.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()])


def month_quality(features: DataFrame, day: str = "op_date", coverage: str = "coverage") -> DataFrame:
    """Per month: rows, mean and lowest coverage, rows with coverage of 80 % or more."""
    return features.groupBy(S.month(day).alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.avg(coverage).alias("mean_coverage"), F.min(coverage).alias("min_coverage"), F.sum(S.flag(F.col(coverage) >= 0.8)).alias("covered"))


def of_month(frame: DataFrame, month: str, day: str = "op_date") -> DataFrame:
    """Rows whose operating day lies in a month (yyyy-MM); a range of days, so a scan can skip what lies outside."""
    first = F.lit(f"{month}-01").cast("date")
    return frame.where((F.col(day) >= first) & (F.col(day) < F.add_months(first, 1)))


def segment_ranges(frame: DataFrame, segment: str, day: str) -> DataFrame:
    return frame.groupBy(segment).agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def reference_values(frame: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """One row: the median of numbers, the most frequent value of texts (the smallest of equals)."""
    out = frame.sparkSession.range(1).drop("id")
    for c in numbers:
        out = out.join(F.broadcast(percentiles(frame, F.col(c), {c: 0.5}).drop("g")), how="left")  # a row each
    for c in texts:
        top = frame.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n")).agg(F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias(c))
        out = out.join(F.broadcast(top))
    return out


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per Parquet file: file, rows, column, type and nulls, from the footers alone (null where a file has no such statistics).

    Footers are read through Spark's file system, so any store does; one at a time, as an audit has a file per month.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
        try:
            blocks = list(reader.getFooter().getBlocks())
            rows, nulls, types = sum(b.getRowCount() for b in blocks), {}, {}
            for b in blocks:
                for c in b.getColumns():
                    name, told = c.getPath().toDotString(), c.getStatistics()
                    types[name] = str(c.getPrimitiveType().getPrimitiveTypeName())
                    known = told is not None and told.isNumNullsSet()
                    nulls[name] = nulls.get(name, 0) + told.getNumNulls() if known and nulls.get(name, 0) is not None else None
            out += [(path.rsplit("/", 1)[-1], rows, name, types[name], nulls[name]) for name in types]
        finally:
            reader.close()
    return spark.createDataFrame(out, "file string, rows long, column string, type string, nulls long")


def leaf_files(frame: DataFrame) -> list[str]:
    """Paths of the files that a scan reads."""
    return sorted(frame.inputFiles())

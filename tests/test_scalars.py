import datetime as dt
import math

from pyspark.sql import functions as F

from cellflow.functions import scalars as S


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").select("i", expr.alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_decimal_text(spark):
    assert column(spark, ["956,0", "1.234,5", "x", None, " 7 ", "1d", "-,5", "1e3", ""], "string", S.decimal_comma("c")) == [956.0, None, None, None, 7.0, None, -0.5, 1000.0, None]


def test_numbers_and_dates(spark):
    assert column(spark, ["1.5", "NaN", "x", None], "string", S.number("c")) == [1.5, None, None, None]
    assert column(spark, ["31/01/2024", "2024-01-31", "32/01/2024", None], "string", S.day_first_date("c")) == [dt.date(2024, 1, 31), None, None, None]
    assert column(spark, ["12.0", " 7 ", "x.0", None], "string", S.plain_id("c")) == ["12", "7", "x", None]


def test_slots(spark):
    times = [dt.datetime(2024, 3, 1, h, m) for h, m in ((0, 59), (1, 0), (5, 59), (6, 0), (9, 59), (10, 0), (21, 59), (22, 0))]
    assert column(spark, times, "timestamp_ntz", S.slot("c")) == [5, 6, 6, 1, 1, 2, 4, 5]
    assert column(spark, times, "timestamp_ntz", S.operating_date("c")) == [dt.date(2024, 2, 29)] * 3 + [dt.date(2024, 3, 1)] * 5
    orders = column(spark, times, "timestamp_ntz", S.absolute_order(S.operating_date("c"), S.slot("c")))
    assert orders == sorted(orders)
    assert column(spark, orders, "long", S.slot_of_order("c")) == [5, 6, 6, 1, 1, 2, 4, 5]
    assert column(spark, orders, "long", S.date_of_order("c")) == [dt.date(2024, 2, 29)] * 3 + [dt.date(2024, 3, 1)] * 5
    assert column(spark, [0, -5], "long", S.slot_of_order("c")) == [6, 1]
    starts = column(spark, [1, 5, 6], "int", S.slot_start(F.lit("2024-03-01").cast("date"), "c"))
    assert starts == [dt.datetime(2024, 3, 1, 6), dt.datetime(2024, 3, 1, 22), dt.datetime(2024, 3, 2, 1)]


def test_parts_keep_missing(spark):
    values = [-3.0, 0.0, 4.0, None]
    assert column(spark, values, "double", S.negative_part("c")) == [-3.0, 0.0, 0.0, None]
    assert column(spark, values, "double", S.positive_part("c")) == [0.0, 0.0, 4.0, None]


def test_sentinel_ratio_finite(spark):
    assert column(spark, [9999.0, 1.0, None], "double", S.without_sentinel("c")) == [None, 1.0, None]
    assert column(spark, [0.0, 2.0, None], "double", S.ratio(F.lit(1.0), "c")) == [None, 0.5, None]
    assert column(spark, [math.inf, -math.inf, math.nan, 1.0, None], "double", S.finite("c")) == [None, None, None, 1.0, None]


def test_row_statistics(spark):
    f = spark.createDataFrame([(1.0, 2.0, 6.0), (None, 2.0, None), (None, None, None)], "a double, b double, c double")
    got = f.select(S.row_mean("a", "b", "c"), S.row_std("a", "b", "c"), S.row_max("a", "b", "c"), S.row_min("a", "b", "c"), S.row_count("a", "b", "c"), S.slope("a", "c")).collect()
    assert [tuple(r) for r in got] == [(3.0, math.sqrt(7), 6.0, 1.0, 3, -2.5), (2.0, None, 2.0, 2.0, 1, None), (None, None, None, None, 0, None)]


def test_bins_close_on_the_right(spark):
    assert column(spark, [955.0, 955.5, 965.0, 985.1, None], "double", S.error_range("c")) == ["<=955", "955-965", "955-965", ">985", None]
    assert column(spark, [100.0, 1200.0, 1201.0], "double", S.life_phase("c")) == ["start", "stable", "end"]


def test_labels_and_weights(spark):
    assert column(spark, [-5.0, -4.9, 4.9, 5.0, None], "double", S.direction("c")) == [0, 1, 1, 2, None]
    assert column(spark, [969.0, 970.0], "double", S.sample_weight(F.lit(6.0), "c")) == [3.0, 4.0]
    assert column(spark, [969.0, 970.0], "double", S.sample_weight(F.lit(6.0), "c", "none")) == [1.0, 1.0]
    f = spark.createDataFrame([(0.4, 0.4, 0.2), (0.1, 0.2, 0.7)], "a double, b double, c double")
    assert [r[0] for r in f.select(S.argmax("a", "b", "c")).collect()] == [0, 2]


def test_flags(spark):
    assert column(spark, [1.0, -1.0, None], "double", S.flag(F.col("c") > 0)) == [1, 0, 0]
    assert column(spark, [1.0, -1.0, None], "double", S.nullable_flag(F.col("c") > 0)) == [1, 0, None]
    f = spark.createDataFrame([("a",), ("z",), (None,)], "k string").select(*S.one_hot("k", ["a", "b"], "m"))
    assert [tuple(r) for r in f.collect()] == [(1, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_split_keeps_undated_rows_in_training(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1), None]
    got = column(spark, days, "date", S.chronological_split("c", dt.date(2024, 2, 1), dt.date(2024, 3, 1)))
    assert got == ["train", "validation", "test", "train"]


def test_baselines(spark):
    f = spark.createDataFrame([(10.0, 8.0), (10.0, None)], "a double, b double")
    got = f.select(S.baseline_mean_of_two("a", "b"), S.baseline_extrapolated("a", "b")).collect()
    assert [tuple(r) for r in got] == [(9.0, 12.0), (10.0, 10.0)]

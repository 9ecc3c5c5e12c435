import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellflow.operators import asof, audit, contracts, highfreq, intervals, ledger, metrics, quantiles, resample, windows


def readings(spark, rows):
    return spark.createDataFrame(rows, "cell long, ord long, value double")


def test_pairs_take_the_exact_gap_and_the_history(spark):
    got = intervals.pairs(readings(spark, [(1, 1, 10.0), (1, 9, 11.0), (1, 17, 12.0), (1, 26, 13.0), (2, 9, 5.0), (1, 12, None)])).orderBy("ord_end").collect()
    assert [(r["interval_id"], r["start"], r["end"], r["before2"], r["before3"]) for r in got] == [("1_1_9", 10.0, 11.0, None, None), ("1_9_17", 11.0, 12.0, 10.0, None)]
    assert len(intervals.pairs(readings(spark, [(1, 1, 10.0), (1, 9, 11.0), (1, 26, 13.0)]), None).collect()) == 2


def test_counts_between_are_open(spark):
    rows = readings(spark, [(1, o, 1.0 if o in (1, 9) else None) for o in range(1, 10)])
    last = intervals.counts_between(rows).where("ord = 9").first()
    assert (last["rows_between"], last["readings_between"]) == (7, 0)


def test_sum_of_nothing_is_zero_and_the_rest_null(spark):
    f = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "interval_id string, ord int, x double")
    r = windows.aggregate(f, {"x": ("sum", "mean", "min", "max", "last", "count"), "absent": ("sum",)}).first()
    assert tuple(r) == ("a", 0.0, None, None, None, None, 0)


def test_pooled_partials_equal_the_raw_records(spark):
    rng = random.Random(3)
    raw = [(1, o, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=60 * i), rng.uniform(-5, 5) if rng.random() < 0.8 else None) for i, o in enumerate(sorted(rng.randrange(1, 8) for _ in range(60)))]
    raw.append((1, 20, dt.datetime(2024, 1, 5), 3.0))  # a slot with one record
    f = spark.createDataFrame(raw, "cell long, ord long, ts timestamp_ntz, x double")
    p = highfreq.slot_partials(f, ["x"]).withColumn("interval_id", F.lit("i")).withColumn("offset", F.col("ord"))
    values = [r[3] for r in raw if r[3] is not None]
    for rows in (p, p.orderBy(F.desc("ord"))):
        r = highfreq.merge(rows, ["x"]).first()
        assert math.isclose(r["x_mean"], statistics.fmean(values)) and math.isclose(r["x_std"], statistics.stdev(values))


def test_mode_changes_need_both_sides(spark):
    f = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, i), m) for i, m in enumerate([1, 1, 2, None, 2])], "cell long, ts timestamp_ntz, mode int")
    assert highfreq.mark_changes(f, "mode").agg(F.sum("changed")).first()[0] == 1


def test_asof_nearest_takes_the_earlier_of_equals(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(1, 7, at(100)), (2, 7, at(1000)), (3, 8, at(100)), (4, None, at(100))], "id long, cell long, ts timestamp_ntz")
    right = spark.createDataFrame([(7, at(130), 2.0), (7, at(70), 1.0), (7, at(1061), 3.0), (None, at(100), 4.0)], "cell long, ts timestamp_ntz, v double")
    got = {r["id"]: (r["v"], r["offset_s"]) for r in asof.nearest(left, right, ["cell"], "ts", 60, ["v"], ["id"]).collect()}
    assert got == {1: (1.0, -30.0), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_asof_backward_reaches_its_own_order(spark):
    left = spark.createDataFrame([(1, 4), (1, 5), (1, 2), (2, 9), (None, 9)], "cell long, ord long")
    got = {(r["cell"], r["ord"]): (r["chem_1"], r["chem_2"], r["age_1"]) for r in asof.backward(left, spark.createDataFrame([(1, 3, 0.3), (1, 5, 0.5)], "cell long, ord long, chem double"), "cell", "ord", "chem", "ord").collect()}
    assert got == {(1, 4): (0.3, None, 1), (1, 5): (0.5, 0.3, 0), (1, 2): (None, None, None), (2, 9): (None, None, None), (None, 9): (None, None, None)}


def test_coverage_decides_integrals(spark):
    def window(found):
        return spark.createDataFrame([("i", k, 1 if k <= found else None, 1, 2.0 if k <= found else None, 1 if k <= found else None) for k in range(1, 6)], "interval_id string, lag int, records int, expected int, x__mean double, x__count int")

    for found, whole in ((3, None), (4, 8 * 5 / 60)):
        r = ledger.features(window(found), {"all": (1, 5)}, ["x"], integrals=["x"]).first()
        assert r["all_coverage"] == found / 5 and r["x_all_mean"] == 2.0 and r["x_all_integral"] == whole


def test_empty_bins_stay(spark):
    f = spark.createDataFrame([("a", 1.0), ("a", -3.0), (None, 2.0)], "bin string, error double")
    got = {r["bin"]: (r["rows"], r["mae"]) for r in metrics.by_bin(f, "bin", ("a", "b")).collect()}
    assert got == {"a": (2, 2.0), "b": (0, None), None: (1, 2.0)}


def test_percentiles_are_interpolated(spark):
    f = spark.createDataFrame([("p", float(x)) for x in (1, 2, 3, 10)], "variant string, error double")
    assert math.isclose(metrics.by(f, "variant").first()["p90"], 7.9)


def test_threshold_ties_prefer_precision_then_the_higher(spark):
    f = spark.createDataFrame([(1, 0.9), (1, 0.9), (0, 0.1)], "y int, p double")
    assert tuple(metrics.best_threshold(f, "y", "p").first()) == (0.9, 1.0, 1.0)


def test_ranking_counts_ties_half(spark):
    f = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert metrics.ranking(f, "y", "p").first()["auc"] == 0.875


def test_duplicates(spark):
    f = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "k int")
    assert tuple(audit.duplicates(f, ["k"]).first()) == (6, 3, 3, 5)


def test_shared_gap_hour_takes_the_earliest(spark):
    rows = [(c, dt.datetime(2024, 1, 1, h)) for c, hs in ((1, (0, 5)), (2, (0, 5)), (3, (0, 8)), (4, (0, 8))) for h in hs]
    got = audit.shared_gap_hour(spark.createDataFrame(rows, "cell long, ts timestamp_ntz"), 3600).first()
    assert tuple(got) == (dt.datetime(2024, 1, 1, 5), 2)


def test_contracts(spark):
    f = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, x double")
    with pytest.raises(contracts.ContractError):
        contracts.require_unique(f, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.joined(f.select("k"), f, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.require(f, {"small": "x < 3"})
    assert contracts.require(f, {"there": "x > 0"}).count() == 2
    assert contracts.violations(f, {"never": "x > NULL"}).first()["violations"] == 2
    with pytest.raises(contracts.ContractError):
        contracts.require_features(["a", "target_b"], ["target"])


def test_resampling_is_deterministic(spark):
    f = spark.createDataFrame([(i, i % 5, float(i % 7), float(i % 3)) for i in range(200)], "k int, cell int, a double, b double")
    one, two = (resample.sample(x, "k", 20).select("k").collect() for x in (f, f.orderBy(F.desc("k"))))
    assert sorted(one) == sorted(two) and len(one) == 20
    low, mean, high = resample.paired_bootstrap(f, "k", "a", "b", 100).first()
    assert low < mean < high and abs(mean - (sum(i % 7 for i in range(200)) - sum(i % 3 for i in range(200))) / 200) < 0.1
    assert resample.cluster_bootstrap(f, "cell", "a", "b", 50).first()[0] is not None
    p = resample.permuted(f, "k", "a", 1)
    assert sorted(r["a"] for r in p.collect()) == sorted(r["a"] for r in f.collect())


def test_no_slot_outside_of_the_window_counts(spark):
    pairs = intervals.pairs(readings(spark, [(1, 1, 1.0), (1, 9, 2.0)]))
    ordinals = {r["ord"] for r in windows.expand(pairs, 7).collect()}
    assert ordinals == set(range(2, 9))
    assert {r["ord"] for r in windows.expand(pairs, 21, backward=True).collect()} == set(range(-12, 9))


def test_resampling_defaults_are_whole(spark, monkeypatch):
    assert resample.sample(spark.range(9000), "id").count() == 8000
    f = spark.createDataFrame([(i, i % 5, float(i % 7), float(i % 3)) for i in range(20)], "k int, cell int, a double, b double")
    monkeypatch.setattr(resample, "_interval", lambda estimates, names: estimates)
    assert resample.paired_bootstrap(f, "k", "a", "b").count() == resample.cluster_bootstrap(f, "cell", "a", "b").count() == 3000


def test_asof_nearest_against_all_pairs(spark):
    rng = random.Random(3)
    t = dt.datetime(2024, 1, 1)
    left = [(i, rng.choice([1, 1, 1, 2, None]), t + dt.timedelta(seconds=rng.randrange(4000)) if rng.random() < 0.95 else None) for i in range(300)]
    right = [(rng.choice([1, 1, 2, None]), t + dt.timedelta(seconds=rng.randrange(4000)), float(rng.randrange(5)) if rng.random() < 0.9 else None) for _ in range(300)]
    got = asof.nearest(spark.createDataFrame(left, "id long, cell long, ts timestamp_ntz"), spark.createDataFrame(right, "cell long, ts timestamp_ntz, ts2 double").withColumnRenamed("ts2", "v"), ["cell"], "ts", 30, ["v"]).collect()
    assert len(got) == 300
    for r in got:
        near = [((abs((b - r["ts"]).total_seconds()), b, v is not None, v or 0), b, v) for c, b, v in right if c is not None and c == r["cell"] and r["ts"] and abs((b - r["ts"]).total_seconds()) <= 30]
        if near:
            _, b, v = min(near, key=lambda x: x[0])
            assert (r["v"], r["matched_ts"], r["offset_s"]) == (v, b, (b - r["ts"]).total_seconds())
        else:
            assert r["v"] is None and r["offset_s"] is None


def test_percentiles_of_any_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "CELLS", 8)
    rng = random.Random(4)
    levels = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    for make in (lambda: rng.gauss(0, 1), lambda: rng.choice([1.0, 1.0, 2.0]), lambda: 5.0, lambda: 10 ** rng.uniform(-9, 9) * rng.choice([-1, 1]), lambda: rng.choice([float("inf"), 1.0, 0.0])):
        rows = [(rng.choice(["x", "x", "x", "y", None]), make() if rng.random() < 0.9 else None) for _ in range(200)] + [("z", None), ("w", 1.5)]
        frame = spark.createDataFrame(rows, "k string, v double")
        got = {r["k"]: r for r in quantiles.with_percentiles(frame, F.col("v"), levels, ["k"], [F.count("v").alias("n")]).collect()}
        for k in {k for k, _ in rows}:
            v = [x for j, x in rows if j == k and x is not None]
            assert got[k]["n"] == len(v)
            for name, p in levels.items():
                if not v:
                    assert got[k][name] is None
                elif name in "ae":
                    assert got[k][name] == (min(v) if name == "a" else max(v))
                elif not any(map(math.isinf, v)):
                    assert math.isclose(got[k][name], np.percentile(v, 100 * p), rel_tol=1e-9, abs_tol=1e-12), (k, name)
        whole = quantiles.with_percentiles(frame.where("k = 'x'"), F.col("v"), {"c": 0.5}, [], [F.count("v").alias("n")]).first()
        assert whole["n"] == got["x"]["n"] and (whole["c"] == got["x"]["c"] or math.isclose(whole["c"], got["x"]["c"], rel_tol=1e-9))
    assert quantiles.with_percentiles(frame.limit(0), F.col("v"), levels, ["k"], [F.count("v").alias("n")]).count() == 0


def test_ledger_over_slots_equals_the_expanded_ledger(spark):
    rng = random.Random(8)
    slots = [(c, o, rng.randrange(1, 60), rng.gauss(0, 5) if rng.random() < 0.8 else None, rng.randrange(30), rng.random(), rng.random(), rng.randrange(9), rng.randrange(9), rng.randrange(4)) for c in (1, 2) for o in range(1, 70) if rng.random() < 0.85]
    slots = spark.createDataFrame(slots, "cell long, ord long, records long, x__mean double, x__count long, x__max double, x__min double, st__active long, md__records long, changes long")
    targets = spark.createDataFrame([(f"{c}_{o}", c, o - 8, o) for c in (1, 2, 3) for o in range(5, 80, 3)], "interval_id string, cell long, ord_start long, ord_end long")
    more = {"integrals": ["x"], "signed": ["x"], "extremes": ["x"], "states": ["st"], "modes": ["md"], "changes": True}
    expanded = windows.join_slots(windows.expand(targets, 21, backward=True), slots)
    for spans, contrasts in ((ledger.CUMULATIVE, True), (ledger.BANDS, False)):
        want = ledger.features(expanded, spans, ["x"], **more)
        got = ledger.over_slots(targets, slots, spans, ["x"], contrasts=contrasts, **more)
        if contrasts:
            want = ledger.cumulative(expanded, ["x"], **more)
        assert got.columns == want.columns
        for a, b in zip(got.orderBy("interval_id").collect(), want.orderBy("interval_id").collect(), strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    got = ledger.sequence_over_slots(targets, slots, ["x"], ["st"], ["md"]).orderBy("interval_id")
    want = ledger.sequence(expanded, ["x"], ["st"], ["md"]).orderBy("interval_id")
    assert got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    plan = ledger.over_slots(targets, slots, ledger.CUMULATIVE, ["x"], **more)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_profile_counts_by_column_and_value(spark):
    frame = spark.createDataFrame([("1,5", 1, None), ("2", 1, None), ("x", None, None), (None, 1, None), ("2", 1, None)], "t string, k int, nothing double")
    got = {r["column"]: r for r in audit.profile(frame, 2).collect()}
    assert [(got[c]["rows"], got[c]["nulls"], got[c]["distinct_values"], got[c]["examples"], got[c]["looks_numeric"], got[c]["type"]) for c in frame.columns] == [
        (5, 1, 3, "1,5, 2", False, "string"), (5, 1, 1, "1", True, "int"), (5, 5, 0, None, False, "double"),
    ]
    assert math.isclose(got["t"]["numeric_share"], 0.75) and got["nothing"]["numeric_share"] is None
    assert audit.profile(frame.limit(0), 2).count() == 3
    assert {r["column"]: r["distinct_values"] for r in audit.constant_columns(frame).collect()} == {"k": 1, "nothing": 0}

"""Registered queries on sources and sinks, and on expressions and joins that the others don't have.

What is written goes to the folder of spark.checkpoint.dir and is read again.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..config import Config, resolve
from ..functions import scalars as S
from ..operators import audit, contracts, highfreq, intervals, metrics, models, windows
from ..sources import io
from .registry import HOT, PARTIALS, PREDICTED, PREDICTIONS, all_pairs, errors, forward, partials, predicted, query, r, rs
from .registry import FORWARD as FORWARD_SQL

MONTHS = (date(1996, 1, 1), date(1996, 3, 1))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, 'orders_' || strftime(o_orderdate, '%Y-%m') || '.parquet' AS name, count(*) AS rows, " + rs(price="sum(o_totalprice)") + " FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01' GROUP BY 1, 2")
def month_files(spark, sf):
    """A file for each month, found again by name, all of them read."""
    folder = io.scratch(spark, "months")
    orders = io.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    for m in io.months(*MONTHS):
        io.write_parquet(audit.of_month(orders, f"{m:%Y-%m}", "o_orderdate"), f"{folder}/orders_{m:%Y-%m}.parquet")
    found = io.month_files(spark, folder, *MONTHS, prefix="orders")
    out = None
    for m, path in found.items():
        part = io.parquet(spark, path, ["o_totalprice"]).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("price"))
        part = part.select(F.lit(f"{io.month_of(path):%Y-%m}").alias("month"), F.lit(path.rsplit("/", 1)[-1]).alias("name"), "rows", "price")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT l_linenumber % 2 AS part, CAST(count(*) AS BIGINT) AS rows, " + rs(keys="sum(l_suppkey)", quantity="sum(l_quantity)") + " FROM lineitem GROUP BY 1")
def type_drift(spark, sf):
    """Files whose columns differ in type, put together."""
    line = io.table(spark, sf, "lineitem")
    folder, paths = io.scratch(spark, "drift"), []
    for k, kind in ((0, "bigint"), (1, "double")):
        paths.append(f"{folder}/{k}")
        io.write_parquet(line.where(F.col("l_linenumber") % 2 == k).select((F.col("l_linenumber") % 2).cast("bigint").alias("part"), F.col("l_suppkey").cast(kind).alias("l_suppkey"), F.col("l_quantity").cast("double").alias("l_quantity")), paths[-1])
    both = io.drifting(spark, paths, {"part": "bigint", "l_suppkey": "bigint", "l_quantity": "double"})
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_suppkey").cast("double").alias("keys"), F.sum("l_quantity").alias("quantity"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS \"Cuba\", 'G' || n_regionkey AS \"Grupo\" FROM nation")
def lookup_csv(spark, sf):
    """A semicolon file with a byte-order mark and spaces about names."""
    path = io.scratch(spark, "lookup")
    n = io.table(spark, sf, "nation")
    lines = n.select(F.lit(1).alias("o"), F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat(F.lit("G"), F.col("n_regionkey").cast("string")), "n_name").alias("value"))
    head = spark.createDataFrame([(0, "﻿ Cuba ; Grupo;Sala")], "o int, value string")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return io.lookup_csv(spark, path, ["Cuba", "Grupo"])


@query(f"WITH {PREDICTED} SELECT segment, variant, count(*) AS rows, {r('avg(abs(error))', 'mae')} FROM er GROUP BY segment, variant")
def csv_round_trip(spark, sf):
    """Metrics written as CSV with a byte-order mark, and read again."""
    path = io.scratch(spark, "csv")
    m = errors(spark, sf).groupBy("segment", "variant").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs("error")).alias("mae"))
    io.write_csv(m, path, mark=True)
    return io.written_csv(spark, path, "segment string, variant string, rows long, mae double")


@query("""SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS BIGINT) AS place, line FROM (SELECT -3 AS o, '# Regions' AS line UNION ALL SELECT -2.5, '' UNION ALL SELECT -2, '## Names' UNION ALL SELECT -1.5, '' UNION ALL SELECT -1, '| r_regionkey | shown |' UNION ALL SELECT -0.5, '|---|---|'
UNION ALL SELECT r_regionkey, '| ' || r_regionkey || ' | \\|' || r_name || '\\| |' FROM region)""")
def markdown_report(spark, sf):
    shown = io.table(spark, sf, "region").orderBy("r_regionkey").select("r_regionkey", F.concat(F.lit("|"), "r_name", F.lit("|")).alias("shown"))
    lines = io.report("Regions", {"Names": shown}).rstrip("\n").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "place long, line string")


@query(f"""WITH {PREDICTED} SELECT count(*) AS rows, 0.0 AS largest_difference, {r('avg(c0 + c1 * start)', 'mean_prediction')} FROM pr, (SELECT regr_intercept("end", start) AS c0, regr_slope("end", start) AS c1 FROM pr WHERE segment = 'train') WHERE segment = 'test'""")
def model_round_trip(spark, sf):
    """A fitted model, saved and loaded, predicts the same."""
    path = io.scratch(spark, "model")
    p = predicted(spark, sf).select("interval_id", "segment", "start", "end")
    m = models.fit(p.where("segment = 'train'"), "end", ["start"], kind="linear")
    m.save(path)
    again = models.Fitted.load(spark, path)
    both = again.transform(m.transform(p.where("segment = 'test'")).withColumnRenamed("predicted", "first"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("predicted") - F.col("first"))).alias("largest_difference"), F.avg("predicted").alias("mean_prediction"))


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY o_orderkey LIMIT 300")
def first_rows(spark, sf):
    """The sample that goes beside a table: its first rows in order of keys."""
    path = io.scratch(spark, "first")
    io.write_csv(io.sample(io.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")), ["o_orderkey"], 300), path)
    return io.written_csv(spark, path, "o_orderkey long, o_custkey long, day date")


@query("SELECT 'ledger_sizes' AS name, '1,2,3,12' AS value UNION ALL SELECT 'min_slots', '4' UNION ALL SELECT 'shrink_rows', '20.0' UNION ALL SELECT 'resolved', 'below/data.parquet' UNION ALL SELECT 'absolute', '/data.parquet' UNION ALL SELECT 'columns', 'r_regionkey,r_name' UNION ALL SELECT 'months', '1995-11,1995-12,1996-01'")
def configuration(spark, sf):
    """Defaults with a file's entries, paths taken from a folder, a scan's columns, months in order."""
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as f:  # read on the driver alone
        f.write("min_slots: 4\nledger_sizes: [1, 2, 3, 12]\n")
        f.flush()
        c = Config.load(f.name)
    columns = [x for x in io.columns_of(spark, f"{sf}/region.parquet") if x in ("r_regionkey", "r_name")]
    rows = {
        "ledger_sizes": ",".join(map(str, c.ledger_sizes)), "min_slots": str(c.min_slots), "shrink_rows": str(c.shrink_rows), "resolved": str(resolve("below/data.parquet", "/base").relative_to("/base")), "absolute": str(resolve("/data.parquet", "/base")),
        "columns": ",".join(columns), "months": ",".join(f"{m:%Y-%m}" for m in io.months(date(1995, 11, 5), date(1996, 1, 2))),
    }
    return spark.createDataFrame(list(rows.items()), "name string, value string")


# expressions


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN round(value, 6) + 0.0 ELSE CAST(event_id AS DOUBLE) END AS number, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END AS moment FROM events""")
def coercing_casts(spark, sf):
    e = io.table(spark, sf, "events")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).when(k == 1, F.col("value").cast("string")).otherwise(F.col("event_id").cast("string"))
    moment = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("32/13/2024"))
    return e.select("event_id", S.number(text).alias("number"), S.timestamp(moment).alias("moment"))


ELECTRIC = "SELECT event_id, value AS imfc, user_id % 7 AS umfc, value / 10 AS rmfc, CAST(user_id % 5 AS DOUBLE) AS rkfc, CASE WHEN user_id % 3 = 0 THEN 9999.0 ELSE value END AS pal2o3fc FROM events"


@query(f"SELECT event_id, " + rs(power_mw="imfc * umfc / 1000", i2r_mw="imfc * imfc * rmfc / 1e6", r_diff="rmfc - rkfc", r_ratio="rmfc / nullif(rkfc, 0)", i2_diff_mw="imfc * imfc * (rmfc - rkfc) / 1e6", feed_clean="nullif(pal2o3fc, 9999)") + f" FROM ({ELECTRIC})")
def electrical_signals(spark, sf):
    e = io.table(spark, sf, "events").selectExpr("event_id", "value AS imfc", "user_id % 7 AS umfc", "value / 10 AS rmfc", "CAST(user_id % 5 AS DOUBLE) AS rkfc", "CASE WHEN user_id % 3 = 0 THEN CAST(9999 AS DOUBLE) ELSE value END AS pal2o3fc")
    return highfreq.electrical(e).select("event_id", "power_mw", "i2r_mw", "r_diff", "r_ratio", "i2_diff_mw", "feed_clean")


@query("SELECT " + ", ".join(f"CAST(sum(CAST(code = {k} AS INT)) AS BIGINT) AS m_{k}" for k in highfreq.MODES) + ", CAST(sum(CAST(code NOT BETWEEN 0 AND 17 AS INT)) AS BIGINT) AS m_other FROM (SELECT CASE WHEN user_id % 21 < 20 THEN user_id % 21 END AS code FROM events)")
def mode_codes(spark, sf):
    coded = io.table(spark, sf, "events").select(F.when(F.col("user_id") % 21 < 20, F.col("user_id") % 21).alias("code"))
    flags = coded.select(*S.one_hot("code", highfreq.MODES, "m"))
    return flags.agg(*[F.sum(c).alias(c) for c in flags.columns])


@query(f"WITH {PREDICTED} SELECT interval_id, " + rs(none="1.0", heating="CASE WHEN delta > 5 THEN 4.0 ELSE 1.0 END", hot="CASE WHEN \"end\" >= 300 THEN 4.0 ELSE 1.0 END", both="CASE WHEN \"end\" >= 300 THEN 4.0 WHEN delta > 5 THEN 3.0 ELSE 1.0 END") + " FROM pr")
def weight_strategies(spark, sf):
    return predicted(spark, sf).select("interval_id", *[S.sample_weight("delta", "end", k, HOT).alias(k) for k in S.WEIGHTS])


#: Stand-ins of the slot-level columns, from the partials of a slot. A missing slot leaves all of them null.
SLOT_COLUMNS = {
    "tb": "value__mean", "tbd": "value__last", "tbc": "value__first", "rth": "centred__mean", "hb": "value__std", "hbd": "value__max", "hbc": "value__mean", "hm": "centred__std", "hmd": "value__mean", "hmc": "value__last",
    "alf3": "CASE WHEN is_error__any > 0 THEN value__min END", "alf3d": "value__min", "rc": "centred__last", "ndalf3": "is_click__active", "amna2co3": "is_error__active", "ndal2o3": "m_view__records", "ntea": "is_error__active", "dtea": "is_error__fraction",
    "sea": "m_other__fraction", "wrmi": "centred__first", "smrwfc": "m_click__fraction", "v_acd": "value__mean / 97", "imm": "value__max / 13", "rkm": "centred__min", "rrm": "centred__max", "mblthe": "changes", "mblc": "centred__min", "agebsq": "value__max * 3",
}
_DERIVED = {"rth_positive": "greatest(rth, 0)", "rth_negative": "least(rth, 0)", "rc_positive": "greatest(rc, 0)", "rc_negative": "least(rc, 0)", "power": "imm * v_acd", "with_effect": "CAST(coalesce(ntea, 0) > 0 AS INT)", "bath_off": "hbd - hbc", "bath_low": "CAST(hbd - hbc < 0 AS INT)", "metal_off": "hmd - hmc", "found": "CAST(records IS NOT NULL AS INT)"}
_FUNCTIONS = {
    "sum": "coalesce(sum({c}), 0.0)", "mean": "avg({c})", "max": "max({c})", "min": "min({c})", "std": "stddev_samp({c})", "count": "count({c})", "last": "arg_max({c}, ord) FILTER ({c} IS NOT NULL)",
}
# greatest and least ignore nulls, so the signed parts are guarded
_SLOTS_SQL = FORWARD_SQL + ", ww AS (SELECT interval_id, ord, records, " + ", ".join(f"{e} AS {c}" for c, e in SLOT_COLUMNS.items()) + " FROM wn), wd AS (SELECT *, " + ", ".join((f"CASE WHEN {c.split('_')[0]} IS NOT NULL THEN {e} END" if c.endswith(("positive", "negative")) else e) + f" AS {c}" for c, e in _DERIVED.items()) + " FROM ww)"
_MATRIX_SQL = ", ".join(f'{_FUNCTIONS[f].format(c=c)} AS "{c}_{f}"' for c, fs in windows.MATRIX.items() for f in fs)


def slot_matrix(spark, sf):
    w = forward(spark, sf)
    w = w.select("interval_id", "ord", F.col("found").cast("int").alias("found"), *[F.expr(e).cast("double").alias(c) for c, e in SLOT_COLUMNS.items()])
    return windows.aggregate(windows.window_inputs(w), windows.MATRIX)


@query(f"WITH {_SLOTS_SQL}, fe AS (SELECT interval_id, {_MATRIX_SQL} FROM wd GROUP BY interval_id) SELECT interval_id, " + ", ".join(r(f'"{c}_{f}"', f"{c}_{f}") for c, fs in windows.MATRIX.items() for f in fs) + " FROM fe")
def window_matrix(spark, sf):
    """All 38 columns of a slot window by all their functions."""
    out = slot_matrix(spark, sf)
    return out.select("interval_id", *[F.col(c).cast("double").alias(c) for c in out.columns if c != "interval_id"])


_RATIOS_SQL = {
    "manual_active": "CAST(coalesce(rth_sum, 0) <> 0 AS BIGINT)", "had_effect": "CAST(coalesce(ntea_sum, 0) > 0 AS BIGINT)", "had_soda": "CAST(coalesce(amna2co3_sum, 0) > 0 AS BIGINT)", "bath_moved": "CAST(coalesce(mblc_sum, 0) <> 0 AS BIGINT)", "low_last": "CAST(bath_off_last < 0 AS BIGINT)",
    "phase": "CASE WHEN agebsq_last <= 100 THEN 'start' WHEN agebsq_last <= 1200 THEN 'stable' WHEN agebsq_last > 1200 THEN 'end' END",
}
_SHARES_SQL = {
    "low_share": "bath_low_sum / nullif(found_sum, 0)", "resistance_gap": "rrm_mean - rkm_mean", "effect_energy": "coalesce(dtea_sum, 0) * coalesce(sea_sum, 0)", "off_target": "tbd_last - tbc_last", "rth_per_height": "rth_sum / nullif(hbd_last, 0)", "rth_per_liquid": "rth_sum / nullif(hbd_last + hmd_last, 0)",
    "rc_per_height": "rc_sum / nullif(hbd_last, 0)", "power_sum": "rc_sum + rth_sum", "power_positive": "rc_positive_sum + rth_positive_sum", "power_negative": "rc_negative_sum + rth_negative_sum", "start_by_chemistry": "start * alf3d_last", "start_by_rth": "start * rth_sum",
}


@query(f"WITH {_SLOTS_SQL}, fe AS (SELECT interval_id, {_MATRIX_SQL} FROM wd GROUP BY interval_id), fs AS (SELECT fe.*, start FROM fe JOIN ivall USING (interval_id)) SELECT interval_id, " + ", ".join(f"{e} AS {n}" for n, e in _RATIOS_SQL.items()) + ", " + rs(**_SHARES_SQL) + " FROM fs")
def derived_ratios(spark, sf):
    """Flags, shares and interactions that follow from the window's aggregates."""
    f = slot_matrix(spark, sf).join(all_pairs(spark, sf).select("interval_id", "start"), "interval_id")
    return windows.ratios(f).select("interval_id", *_RATIOS_SQL, *_SHARES_SQL)


# filters, joins and orders


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-02'")
def month_filter(spark, sf):
    return audit.of_month(io.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "1996-02", "day")


@query(f"""WITH {PREDICTED}, m AS (SELECT segment, variant, gap = 8 AS exact, before2 IS NULL AS young, count(*) AS rows, avg(abs(error)) AS mae FROM er GROUP BY ALL), k AS (SELECT segment, variant, gap = 8 AS exact, before2 IS NULL AS young, count(*) AS rows, avg(error) AS bias FROM er WHERE "end" >= 300 GROUP BY ALL)
SELECT segment, variant, exact, young, m.rows AS rows_all, {r('mae', 'mae')}, k.rows AS rows_hot, {r('bias', 'bias')} FROM m JOIN k USING (segment, variant, exact, young)""")
def side_by_side(spark, sf):
    """Two results joined by four keys, with suffixes where both have a column."""
    e = errors(spark, sf, "gap", "before2", "end").withColumns({"exact": F.col("gap") == 8, "young": F.col("before2").isNull()})
    keys = ["segment", "variant", "exact", "young"]
    a = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs("error")).alias("mae"))
    b = e.where(F.col("end") >= HOT).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg("error").alias("bias"))
    return metrics.side_by_side(a, b, keys, ("_all", "_hot"))


@query(f"""WITH {PREDICTED}, c AS (SELECT cell, count(*) AS rows, avg(abs(error)) AS mae FROM er WHERE variant = 'p_mean2' GROUP BY cell), w AS (SELECT 'worst' AS side, * FROM c ORDER BY mae DESC, cell LIMIT 10), b AS (SELECT 'best' AS side, * FROM c ORDER BY mae, cell LIMIT 10)
SELECT side, cell, rows, {r('mae', 'mae')} FROM (SELECT * FROM w UNION ALL SELECT * FROM b)""")
def worst_and_best_cells(spark, sf):
    e = errors(spark, sf, "cell").where("variant = 'p_mean2'")
    c = e.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs("error")).alias("mae"))
    return metrics.extremes(c, "mae", 10).select(F.lit("worst").alias("side"), "*").unionByName(metrics.extremes(c, "mae", 10, worst=False).select(F.lit("best").alias("side"), "*"))


@query("SELECT 'c_mktsegment' AS \"column\", array_to_string(list_sort(list(DISTINCT c_mktsegment))[1:5], ', ') AS examples FROM customer UNION ALL SELECT 'c_nationkey', array_to_string(list_sort(list(DISTINCT CAST(c_nationkey AS VARCHAR)))[1:5], ', ') FROM customer")
def profile_examples(spark, sf):
    return audit.profile(io.table(spark, sf, "customer").select("c_mktsegment", "c_nationkey"), 5).select("column", "examples")


@query(f"""WITH {PREDICTED} SELECT interval_id FROM (SELECT interval_id, start / 500 AS a, CASE WHEN before2 IS NULL THEN 'NaN'::DOUBLE ELSE 1 - start / 500 END AS b FROM pr) WHERE isnan(b)""")
def finite_predictions(spark, sf):
    p = predicted(spark, sf).withColumns({"a": F.col("start") / 500, "b": F.when(F.col("before2").isNull(), F.lit(float("nan"))).otherwise(1 - F.col("start") / 500)})
    return contracts.probabilities(p, ["a", "b"]).select("interval_id")


@query("SELECT c_mktsegment, rows, CAST(row_number() OVER (ORDER BY rows DESC, c_mktsegment) AS BIGINT) AS place FROM (SELECT c_mktsegment, count(*) AS rows FROM customer GROUP BY 1)")
def value_order(spark, sf):
    """The order of value counts, by the place of each row."""
    rows = audit.value_counts(io.table(spark, sf, "customer"), "c_mktsegment").collect()
    return spark.createDataFrame([(x["c_mktsegment"], x["rows"], i + 1) for i, x in enumerate(rows)], "c_mktsegment string, rows long, place long")

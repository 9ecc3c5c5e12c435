"""Registered queries over the bundled tables, each with the SQL of the same result.

The bundled tables stand in for the pot-room data: users are cells, events are records with a
value and a kind, the last purchase or view of a cell in a slot is its reading. Doubles are
rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, audit, contracts, highfreq, intervals, ledger, metrics, windows
from ..sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VALIDATION, TEST = date(2024, 1, 15), date(2024, 1, 22)
PREDICTIONS = ("p_last", "p_mean2", "p_extrapolated")
HOT = 300.0
MODES = ("m_click", "m_view", "m_other")
STATES = ("is_error", "is_click")
SIGNALS = ("value", "centred")
REGIMES = {"all": "true", "cooling": "delta <= -5", "stable": "delta > -5 AND delta < 5", "heating": "delta >= 5", "hot_start": "start >= 300", "hot_target": "end >= 300", "hot_and_heating": "end >= 300 AND delta >= 5"}


def tidy(frame: DataFrame) -> DataFrame:
    """Doubles rounded, whole numbers as long."""
    fix = {"double": lambda c: F.round(c, 6) + F.lit(0.0), "int": lambda c: c.cast("long"), "tinyint": lambda c: c.cast("long")}
    return frame.select(*[fix[t](F.col(f"`{n}`")).alias(n) if t in fix else F.col(f"`{n}`") for n, t in frame.dtypes])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(expr: str, name: str) -> str:
    return f'round(CAST({expr} AS DOUBLE), 6) + 0.0 AS "{name}"'


def rs(**named: str) -> str:
    return ", ".join(r(e, n) for n, e in named.items())


# the views on which the queries stand, and their SQL

LOG = """lg0 AS (SELECT event_id, user_id AS cell, ts, value, event_type AS kind,
  CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 1 WHEN hour(ts) BETWEEN 10 AND 13 THEN 2 WHEN hour(ts) BETWEEN 14 AND 17 THEN 3
       WHEN hour(ts) BETWEEN 18 AND 21 THEN 4 WHEN hour(ts) IN (22, 23, 0) THEN 5 ELSE 6 END AS slot,
  CASE WHEN hour(ts) < 6 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS op_date FROM events),
lg AS (SELECT *, CAST(date_diff('day', DATE '2000-01-01', op_date) * 6 + slot AS BIGINT) AS ord FROM lg0)"""
READINGS = LOG + """, rd AS (SELECT cell, ord, arg_max(value, ts) AS value FROM lg WHERE kind IN ('purchase', 'view') GROUP BY cell, ord)"""
PAIRS = READINGS + """, sq AS (SELECT cell, ord AS ord_end, value AS "end", lag(value, 1) OVER w AS start, lag(value, 2) OVER w AS before2, lag(value, 3) OVER w AS before3,
  lag(ord, 1) OVER w AS ord_start, lag(ord, 2) OVER w AS ord_before2, lag(ord, 3) OVER w AS ord_before3 FROM rd WINDOW w AS (PARTITION BY cell ORDER BY ord)),
ivall AS (SELECT *, ord_end - ord_start AS gap, "end" - start AS delta, concat_ws('_', cell, ord_start, ord_end) AS interval_id,
  DATE '2000-01-01' + CAST(floor((ord_end - 1) / 6) AS INTEGER) AS day FROM sq WHERE ord_start IS NOT NULL),
iv AS (SELECT * FROM ivall WHERE gap = 8)"""
MEAN2 = "CASE WHEN before2 IS NULL THEN start ELSE (start + before2) / 2 END"
PREDICTED = PAIRS + f""", pr AS (SELECT *, start AS p_last, {MEAN2} AS p_mean2, coalesce(2 * start - before2, start) AS p_extrapolated,
  CASE WHEN day >= DATE '2024-01-22' THEN 'test' WHEN day >= DATE '2024-01-15' THEN 'validation' ELSE 'train' END AS segment FROM ivall),
er AS (SELECT *, predicted - "end" AS error FROM (SELECT *, unnest(['p_last', 'p_mean2', 'p_extrapolated']) AS variant, unnest([p_last, p_mean2, p_extrapolated]) AS predicted FROM pr))"""
PARTIALS = LOG + """, rc AS (SELECT *, value - 245 AS centred, CAST(kind = 'error' AS INT) AS is_error, CAST(kind = 'click' AS INT) AS is_click, CAST(kind = 'click' AS INT) AS m_click,
  CAST(kind = 'view' AS INT) AS m_view, CAST(kind NOT IN ('click', 'view') AS INT) AS m_other, CASE WHEN lag(kind) OVER w <> kind THEN 1 ELSE 0 END AS changed
  FROM lg WINDOW w AS (PARTITION BY cell ORDER BY ts, event_id)),
pt AS (SELECT cell, ord, count(*) AS records, """ + ", ".join(
    f"avg({s}) AS {s}__mean, stddev_samp({s}) AS {s}__std, count({s}) AS {s}__count, min({s}) AS {s}__min, max({s}) AS {s}__max, arg_min({s}, ts) AS {s}__first, arg_max({s}, ts) AS {s}__last" for s in SIGNALS
) + ", " + ", ".join(f"sum({s}) AS {s}__active, avg({s}) AS {s}__fraction, max({s}) AS {s}__any" for s in STATES) + ", " + ", ".join(
    f"sum({m}) AS {m}__records, avg({m}) AS {m}__fraction" for m in MODES
) + ", sum(changed) AS changes FROM rc GROUP BY cell, ord)"""
EXPECTED = "CASE ((ord - 1) % 6) + 1 WHEN 5 THEN 36 WHEN 6 THEN 60 ELSE 48 END"


def _joined_sql(step: str, n: int, order: str, expected: str) -> str:
    """Partials of the slots before (lag) or after (offset): the view wn."""
    views = PARTIALS + PAIRS[len(LOG):]
    return f"""{views}, ex AS (SELECT interval_id, cell, {step}, {order} AS ord FROM (SELECT interval_id, cell, ord_start, ord_end, unnest(range(1, {n + 1})) AS {step} FROM ivall)),
wn AS (SELECT ex.*, {expected.replace("(ord -", "(ex.ord -")} AS expected, pt.* EXCLUDE (cell, ord) FROM ex LEFT JOIN pt ON ex.cell = pt.cell AND ex.ord = pt.ord)"""


FORWARD = _joined_sql("offset_", 7, "ord_start + offset_", EXPECTED)
LEDGER = _joined_sql("lag_", 21, "ord_end - lag_", "1")


def log(spark, sf):
    return io.slot_log(spark, sf)


def readings(spark, sf):
    return log(spark, sf).where(F.col("kind").isin("purchase", "view")).groupBy("cell", "ord").agg(F.max_by("value", "ts").alias("value"))


def all_pairs(spark, sf):
    return intervals.pairs(readings(spark, sf), None).withColumn("day", S.date_of_order("ord_end"))


def predicted(spark, sf):
    out = intervals.baselines(all_pairs(spark, sf))
    return out.withColumn("segment", S.chronological_split("day", VALIDATION, TEST))


def errors(spark, sf, *keep):
    return metrics.long(predicted(spark, sf), PREDICTIONS, "end", ["segment", *keep])


def records(spark, sf):
    e = io.table(spark, sf, "events").select("event_id", F.col("user_id").alias("cell"), "ts", "value", F.col("event_type").alias("kind"))
    e = e.withColumn("ord", S.absolute_order(S.operating_date("ts"), S.slot("ts"))).withColumn("centred", F.col("value") - 245)
    e = e.withColumns({"is_error": S.flag(F.col("kind") == "error"), "is_click": S.flag(F.col("kind") == "click")})
    return highfreq.mark_changes(e.select("*", *S.one_hot("kind", ["click", "view"], "m")), "kind", tie=["event_id"])


def partials(spark, sf):
    return highfreq.slot_partials(records(spark, sf), SIGNALS, STATES, MODES, "changed")


def forward(spark, sf):
    return windows.join_slots(windows.expand(all_pairs(spark, sf), 7), partials(spark, sf))


def backward(spark, sf):
    return windows.join_slots(windows.expand(all_pairs(spark, sf), 21, backward=True), partials(spark, sf)).withColumn("expected", F.lit(1))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error metrics of the baselines over pairs of readings eight slots apart."""
    pairs = intervals.baselines(intervals.pairs(readings(spark, sf_dir)))
    return metrics.by(metrics.long(pairs, PREDICTIONS), "variant")


SUMMARY = "count(error) AS rows, " + rs(
    mae="avg(abs(error))", rmse="sqrt(avg(error * error))", bias="avg(error)", median="quantile_cont(abs(error), 0.5)", p75="quantile_cont(abs(error), 0.75)", p90="quantile_cont(abs(error), 0.9)", p95="quantile_cont(abs(error), 0.95)",
    within_3_pct="avg(CASE WHEN abs(error) <= 3 THEN 100.0 ELSE 0 END)", within_5_pct="avg(CASE WHEN abs(error) <= 5 THEN 100.0 ELSE 0 END)", within_10_pct="avg(CASE WHEN abs(error) <= 10 THEN 100.0 ELSE 0 END)",
)


# time, cleaning, scalar expressions


@query(f"WITH {LOG} SELECT event_id, cell, ts, CAST(slot AS BIGINT) AS slot, op_date, ord, CAST(((ord - 1) % 6) + 1 AS BIGINT) AS slot_again, CAST({EXPECTED} AS BIGINT) AS expected, DATE '2000-01-01' + CAST(floor((ord - 1) / 6) AS INTEGER) AS day_again FROM lg")
def slot_ordinal(spark, sf):
    e = io.table(spark, sf, "events").select("event_id", F.col("user_id").alias("cell"), "ts").withColumns({"slot": S.slot("ts"), "op_date": S.operating_date("ts")})
    e = e.withColumn("ord", S.absolute_order("op_date", "slot"))
    return e.withColumns({"slot_again": S.slot_of_order("ord"), "expected": S.expected_records("slot"), "day_again": S.date_of_order("ord")})


@query(f"""WITH {LOG} SELECT DISTINCT op_date, CAST(slot AS BIGINT) AS slot, CAST(op_date AS TIMESTAMP) + to_hours(CASE slot WHEN 1 THEN 6 WHEN 2 THEN 10 WHEN 3 THEN 14 WHEN 4 THEN 18 WHEN 5 THEN 22 ELSE 25 END) AS starts FROM lg""")
def slot_starts(spark, sf):
    return log(spark, sf).select("op_date", "slot").distinct().withColumn("starts", S.slot_start("op_date", "slot"))


@query(f"""WITH {LOG}, o AS (SELECT min(op_date) AS origin FROM lg) SELECT event_id, CAST(date_diff('day', origin, op_date) * 6 + slot AS BIGINT) AS relative_ord FROM lg, o""")
def relative_ordinal(spark, sf):
    e = io.table(spark, sf, "events").select("event_id", S.slot("ts").alias("slot"), S.operating_date("ts").alias("op_date"))
    origin = log(spark, sf).agg(F.min("op_date").alias("origin"))
    return e.join(F.broadcast(origin)).select("event_id", (F.datediff("op_date", "origin") * 6 + F.col("slot")).cast("long").alias("relative_ord"))


@query("""SELECT o_orderkey, text, CAST(replace(text, ',', '.') AS DOUBLE) AS parsed, dated, CAST(o_orderdate AS DATE) AS parsed_day, flawed, TRY_CAST(replace(flawed, ',', '.') AS DOUBLE) AS parsed_flawed FROM
(SELECT o_orderkey, o_orderdate, replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '.', ',') AS text, strftime(o_orderdate, '%d/%m/%Y') AS dated,
 CASE WHEN o_orderkey % 3 = 0 THEN 'x' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS VARCHAR) || ',5' END AS flawed FROM orders)""")
def decimal_comma_cast(spark, sf):
    o = io.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    o = o.select("o_orderkey", F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("text"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("dated"),
                 F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), key)).when(F.col("o_orderkey") % 3 == 1, F.concat(key, F.lit(",5"))).alias("flawed"))
    return o.withColumns({"parsed": S.decimal_comma("text"), "parsed_day": S.day_first_date("dated"), "parsed_flawed": S.decimal_comma("flawed")})


@query("SELECT event_id, " + rs(positive="greatest(value - 245, 0)", negative="least(value - 245, 0)", cleaned="CASE WHEN value > 480 THEN NULL ELSE value END", per_slot="value / nullif(user_id % 4, 0)", share="value / 490")
       + ", CAST(event_type = 'click' AS BIGINT) AS m_click, CAST(event_type = 'view' AS BIGINT) AS m_view, CAST(event_type NOT IN ('click', 'view') AS BIGINT) AS m_other, trim(CAST(user_id AS VARCHAR)) AS id, strftime(ts, '%Y-%m') AS month FROM events")
def scalar_flags(spark, sf):
    e = io.table(spark, sf, "events")
    c = F.col("value") - 245
    marked = F.when(F.col("value") > 480, float(S.SENTINEL)).otherwise(F.col("value"))
    return e.select("event_id", S.positive_part(c).alias("positive"), S.negative_part(c).alias("negative"), S.without_sentinel(marked).alias("cleaned"), S.ratio("value", F.col("user_id") % 4).alias("per_slot"), S.finite(F.col("value") / 490).alias("share"),
                    *S.one_hot("event_type", ["click", "view"], "m"), S.plain_id(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".0"))).alias("id"), S.month("ts").alias("month"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 100 THEN 'start' WHEN o_totalprice <= 1200 THEN 'stable' ELSE 'end' END AS phase, CASE WHEN o_totalprice % 1000 <= 955 THEN '<=955' WHEN o_totalprice % 1000 <= 965 THEN '955-965' WHEN o_totalprice % 1000 <= 975 THEN '965-975' WHEN o_totalprice % 1000 <= 985 THEN '975-985' ELSE '>985' END AS range_,
CAST(CASE WHEN o_totalprice - 200000 <= -5 THEN 0 WHEN o_totalprice - 200000 >= 5 THEN 2 ELSE 1 END AS BIGINT) AS way FROM orders""")
def bins_and_labels(spark, sf):
    return io.table(spark, sf, "orders").select("o_orderkey", S.life_phase("o_totalprice").alias("phase"), S.error_range(F.col("o_totalprice") % 1000).alias("range_"), S.direction(F.col("o_totalprice") - 200000).alias("way"))


@query(f"WITH {PAIRS} SELECT interval_id, " + rs(
    change_last="start - before2", change_before="before2 - before3", before1="start", last_change="start - before2", change_before_last="before2 - before3", mean_last2=MEAN2,
    mean_last3="(start + coalesce(before2, 0) + coalesce(before3, 0)) / (1 + CAST(before2 IS NOT NULL AS INT) + CAST(before3 IS NOT NULL AS INT))", max_last3="greatest(start, before2, before3)", min_last3="least(start, before2, before3)", range_last3="greatest(start, before2, before3) - least(start, before2, before3)",
    std_last3="(SELECT stddev_samp(x) FROM unnest([start, before2, before3]) t(x))", slope_last3="(start - before3) / 2") + ", CAST(before2 IS NOT NULL AS BIGINT) + CAST(before3 IS NOT NULL AS BIGINT) AS earlier_readings FROM ivall")
def thermal_history(spark, sf):
    h = intervals.history(all_pairs(spark, sf))
    return h.select("interval_id", "change_last", "change_before", "before1", "last_change", "change_before_last", "mean_last2", "mean_last3", "max_last3", "min_last3", "range_last3", "std_last3", "slope_last3", "earlier_readings")


@query(f"""WITH {PREDICTED} SELECT interval_id, """ + rs(weight="CASE WHEN \"end\" >= 300 THEN 4.0 WHEN delta > 5 THEN 3.0 ELSE 1.0 END", general="p_last + 0.5 * (p_mean2 - p_last) + 2 * (0.3 - 0.25) - 0.5", balanced="p_last + 0.5 * (p_mean2 - p_last) + 2 * (0.3 - 0.25) - 0.5 - 0.25 * 0.1 + 0.25 * 0.2", blended="p_last + 0.5 * 0.5 * (p_mean2 - p_last) + 0.5 * (p_extrapolated - p_last) + 1 * (0.3 - 0.25) + 1.5 - 0.5 * 0.1 + 2 * 0.2") + " FROM pr")
def combined_predictions(spark, sf):
    p = predicted(spark, sf).withColumn("corr", F.col("p_mean2") - F.col("p_last")).withColumn("half", F.col("corr") * 0.5).withColumn("wcorr", F.col("p_extrapolated") - F.col("p_last"))
    hot, base, cool, heat = F.lit(0.3), F.lit(0.25), F.lit(0.1), F.lit(0.2)
    return p.select("interval_id", S.sample_weight("delta", "end", "both", HOT).alias("weight"), S.combined("p_last", "corr", hot, base, 0.5, 2.0, -0.5).alias("general"), S.balanced("p_last", "half", hot, base, cool, heat).alias("balanced"),
                    S.blended("p_last", "half", "wcorr", hot, base, cool, heat, 0.5, 1.0, 1.5, 0.5, 2.0).alias("blended"))


# joins


@query("""SELECT c.c_custkey, n.n_name, r.r_name, n.n_nationkey IS NOT NULL AS matched FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def lookup_join(spark, sf):
    n = io.table(spark, sf, "nation").join(io.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    c = io.table(spark, sf, "customer").withColumn("n_nationkey", F.col("c_nationkey"))
    n = n.select("n_nationkey", "n_name", "r_name", F.lit(True).alias("__in"))
    return contracts.joined(c, n, ["n_nationkey"]).select("c_custkey", "n_name", "r_name", F.coalesce("__in", F.lit(False)).alias("matched"))


@query(f"WITH {PAIRS} SELECT interval_id, cell, ord_start, ord_end, gap, " + rs(start="start", end='"end"', before2="before2", before3="before3", delta="delta") + ", ord_before2, ord_before3 FROM iv")
def interval_pairs(spark, sf):
    return intervals.pairs(readings(spark, sf)).select("interval_id", "cell", "ord_start", "ord_end", "gap", "start", "end", "before2", "before3", "delta", "ord_before2", "ord_before3")


@query(f"""WITH {READINGS} SELECT cell, ord, count(*) OVER w AS rows_between, count(CASE WHEN value > 245 THEN value END) OVER w AS readings_between FROM rd WINDOW w AS (PARTITION BY cell ORDER BY ord RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def interval_window_counts(spark, sf):
    rows = readings(spark, sf).withColumn("value", F.when(F.col("value") > 245, F.col("value")))
    return intervals.counts_between(rows).select("cell", "ord", "rows_between", "readings_between")


@query(f"""WITH {PAIRS} SELECT interval_id, (SELECT count(*) FROM lg WHERE lg.cell = ivall.cell AND lg.ord > ord_start AND lg.ord < ord_end) AS n FROM ivall""")
def range_count(spark, sf):
    p = all_pairs(spark, sf)
    return asof.range_count(p, log(spark, sf), "cell", "ord", "ord_start", "ord_end", 400, ["interval_id"]).select("interval_id", "n")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('click', 'view')), q AS (SELECT user_id, ts, value FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
m AS (SELECT l.event_id, arg_min(struct_pack(v := q.value, t := q.ts), (abs(epoch_us(q.ts) - epoch_us(l.ts)), q.ts)) AS b, min(abs(epoch_us(q.ts) - epoch_us(l.ts))) AS a FROM l JOIN q ON l.user_id = q.user_id AND abs(epoch_us(q.ts) - epoch_us(l.ts)) <= 3600000000 GROUP BY l.event_id)
SELECT l.event_id, l.user_id, round(b.v, 6) + 0.0 AS value, b.t AS matched_ts, round((epoch_us(b.t) - epoch_us(l.ts)) / 1e6, 6) + 0.0 AS offset_s FROM l LEFT JOIN m USING (event_id)""")
def asof_nearest(spark, sf):
    e = io.table(spark, sf, "events")
    left = e.where(F.col("event_type").isin("click", "view")).select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type").isin("purchase", "error", "signup")).select("user_id", "ts", "value")
    return asof.nearest(left, right, ["user_id"], "ts", 3600, ["value"]).drop("ts")


@query(f"""WITH {READINGS}, c AS (SELECT cell, ord, arg_max(value, ts) AS chem FROM lg WHERE kind = 'error' GROUP BY cell, ord), h AS (SELECT cell, ord, chem AS v1, lag(chem, 1) OVER w AS v2, lag(chem, 2) OVER w AS v3 FROM c WINDOW w AS (PARTITION BY cell ORDER BY ord))
SELECT rd.cell, rd.ord, {rs(chem_1="h.v1", chem_2="h.v2", chem_3="h.v3")}, rd.ord - h.ord AS age_1 FROM rd ASOF LEFT JOIN h ON rd.cell = h.cell AND rd.ord >= h.ord""")
def asof_backward_history(spark, sf):
    chem = log(spark, sf).where("kind = 'error'").groupBy("cell", "ord").agg(F.max_by("value", "ts").alias("chem"))
    return asof.backward(readings(spark, sf).select("cell", "ord"), chem, "cell", "ord", "chem", "ord").withColumn("age_1", F.col("age_1").cast("long"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)")
def anti_missing_cells(spark, sf):
    bought = io.table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return io.table(spark, sf, "customer").select("c_custkey").distinct().join(bought, "c_custkey", "left_anti")


# slots to intervals

MATRIX = {"value__mean": ("sum", "mean", "max", "min", "std", "last", "first", "count"), "is_error__active": ("sum", "max"), "records": ("sum",)}


@query(f"WITH {FORWARD} SELECT interval_id, " + rs(value__mean_sum="coalesce(sum(value__mean), 0)", value__mean_mean="avg(value__mean)", value__mean_max="max(value__mean)", value__mean_min="min(value__mean)", value__mean_std="stddev_samp(value__mean)", value__mean_last="arg_max(value__mean, ord) FILTER (value__mean IS NOT NULL)", value__mean_first="arg_min(value__mean, ord) FILTER (value__mean IS NOT NULL)")
       + ", count(value__mean) AS value__mean_count, " + rs(is_error__active_sum="coalesce(sum(is_error__active), 0.0)") + ", CAST(max(is_error__active) AS BIGINT) AS is_error__active_max, " + rs(records_sum="coalesce(sum(records), 0.0)") + " FROM wn GROUP BY interval_id")
def window_expand_agg(spark, sf):
    return windows.aggregate(forward(spark, sf), MATRIX)


@query(f"WITH {PARTIALS} SELECT cell, ord, records, " + ", ".join(rs(**{f"{s}__{k}": f"{s}__{k}" for k in ("mean", "std")}) + f", {s}__count, " + rs(**{f"{s}__{k}": f"{s}__{k}" for k in ("min", "max", "first", "last")}) for s in SIGNALS) + ", "
       + ", ".join(f"CAST({s}__active AS BIGINT) AS {s}__active, {r(f'{s}__fraction', f'{s}__fraction')}, CAST({s}__any AS BIGINT) AS {s}__any" for s in STATES) + ", " + ", ".join(f"CAST({m}__records AS BIGINT) AS {m}__records, {r(f'{m}__fraction', f'{m}__fraction')}" for m in MODES) + ", CAST(changes AS BIGINT) AS changes FROM pt")
def slot_partials(spark, sf):
    return partials(spark, sf)


def _pooled_sql(s: str) -> str:
    late = "CASE WHEN offset_ > 4 THEN"
    return rs(**{
        f"{s}_mean": f"avg(x.{s})", f"{s}_std": f"stddev_samp(x.{s})", f"{s}_min": f"min(x.{s})", f"{s}_max": f"max(x.{s})",
        f"{s}_first": f"max(CASE WHEN offset_ = 1 THEN {s}__first END)", f"{s}_last": f"max(CASE WHEN offset_ = 7 THEN {s}__last END)", f"{s}_change": f"max(CASE WHEN offset_ = 7 THEN {s}__last END) - max(CASE WHEN offset_ = 1 THEN {s}__first END)",
        f"{s}_recent_mean": f"sum({late} x.{s} END) / nullif(count({late} x.{s} END), 0)",
    })


#: The SQL takes the raw records, so that merged partials are held against them.
@query(f"WITH {FORWARD} SELECT interval_id, " + ", ".join(map(_pooled_sql, SIGNALS)) + " FROM wn LEFT JOIN (SELECT cell, ord, value, centred FROM rc) x ON wn.cell = x.cell AND wn.ord = x.ord GROUP BY interval_id")
def pooled_merge(spark, sf):
    return highfreq.merge(forward(spark, sf), SIGNALS)


@query(f"WITH {FORWARD} SELECT interval_id, " + ", ".join(rs(**{f"{s}_minutes": f"coalesce(sum({s}__active), 0) * 5.0", f"{s}_fraction": f"sum({s}__active) / nullif(sum(records), 0)", f"{s}_slots": f"coalesce(sum({s}__any), 0.0)", f"{s}_recent_fraction": f"sum(CASE WHEN offset_ > 4 THEN {s}__active END) / nullif(sum(CASE WHEN offset_ > 4 THEN records END), 0)"}) for s in STATES) + " FROM wn GROUP BY interval_id")
def state_minutes(spark, sf):
    return highfreq.state_features(forward(spark, sf), STATES)


@query(f"WITH {FORWARD} SELECT interval_id, {r('coalesce(sum(changes), 0.0)', 'changes')}, " + ", ".join(rs(**{f"{m}_minutes": f"coalesce(sum({m}__records), 0) * 5.0", f"{m}_fraction": f"sum({m}__records) / nullif(sum(records), 0)"}) for m in MODES) + " FROM wn GROUP BY interval_id")
def mode_onehot_fraction(spark, sf):
    return highfreq.mode_features(forward(spark, sf), MODES)


@query(f"WITH {PARTIALS} SELECT cell, CAST(sum(changed) AS BIGINT) AS changes FROM rc GROUP BY cell")
def change_flags(spark, sf):
    return records(spark, sf).groupBy("cell").agg(F.sum("changed").alias("changes"))


COVERAGE = rs(records="coalesce(sum(records), 0.0)", expected="sum(expected) + 0.0", coverage="coalesce(sum(records), 0.0) / sum(expected)") + ", count(records) AS slots_found, " + r("min(coalesce(records, 0) / expected)", "min_coverage") + ", CAST(sum(CASE WHEN coalesce(records, 0) / expected < 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS low_slots"


@query(f"WITH {FORWARD} SELECT interval_id, {COVERAGE} FROM wn GROUP BY interval_id")
def coverage(spark, sf):
    return highfreq.coverage(forward(spark, sf))


@query(f"WITH {LEDGER} SELECT interval_id, {COVERAGE} FROM wn WHERE lag_ <= 7 GROUP BY interval_id HAVING sum(records) / sum(expected) >= 0.8 AND count(records) >= 6")
def coverage_eligibility(spark, sf):
    return highfreq.eligible(highfreq.coverage(backward(spark, sf).where("lag <= 7")))


def _ledger_sql(spans: dict[str, tuple[int, int]], states=STATES, modes=MODES, contrasts=False) -> str:
    out = []
    for n, (a, b) in spans.items():
        i = f"lag_ BETWEEN {a} AND {b}"
        t = lambda e, i=i: f"coalesce(sum(CASE WHEN {i} THEN {e} END), 0.0)"
        cov = f"{t('records')} / nullif({t('expected')}, 0)"
        ok = lambda e, cov=cov: f"CASE WHEN {cov} >= 0.8 THEN {e} END"
        out += [r(cov, f"{n}_coverage"), f'count(CASE WHEN {i} THEN records END) AS "{n}_found"']
        for s in SIGNALS:
            out += [r(f"{t(f'{s}__mean * {s}__count')} / nullif({t(f'{s}__count')}, 0)", f"{s}_{n}_mean"), r(ok(t(f"{s}__mean * {s}__count") + " * 5.0 / 60"), f"{s}_{n}_integral")]
            if s == "centred":
                out += [r(ok(t(f"greatest({s}__mean, 0) * {s}__count") + " * 5.0 / 60"), f"{s}_{n}_positive_integral"), r(ok(t(f"least({s}__mean, 0) * {s}__count") + " * 5.0 / 60"), f"{s}_{n}_negative_integral")]
            if s == "value":
                out += [r(f"max(CASE WHEN {i} THEN {s}__max END)", f"{s}_{n}_max"), r(f"min(CASE WHEN {i} THEN {s}__min END)", f"{s}_{n}_min")]
        out += [r(ok(t(f"{s}__active") + " * 5.0"), f"{s}_{n}_minutes") for s in states]
        out += [r(f"{t(f'{m}__records')} / nullif({t('records')}, 0)", f"{m}_{n}_fraction") for m in modes]
        out.append(r(ok(t("changes")), f"changes_{n}"))
    if contrasts:
        mean = lambda s, k: f"coalesce(sum(CASE WHEN lag_ <= {k} THEN {s}__mean * {s}__count END), 0.0) / nullif(coalesce(sum(CASE WHEN lag_ <= {k} THEN {s}__count END), 0.0), 0)"
        out += [r(f"{mean(s, a)} - {mean(s, b)}", f"{s}_{a}st_vs_{b}st") for s in SIGNALS for a, b in ((1, 6), (3, 12))]
    return ", ".join(out)


FAMILY = {"integrals": SIGNALS, "signed": ("centred",), "extremes": ("value",), "states": STATES, "modes": MODES, "changes": True}


@query(f"WITH {LEDGER} SELECT interval_id, {_ledger_sql({f'{n}st': (1, n) for n in ledger.SIZES}, contrasts=True)} FROM wn GROUP BY interval_id")
def ledger_windows(spark, sf):
    return ledger.over_slots(all_pairs(spark, sf), partials(spark, sf), ledger.CUMULATIVE, SIGNALS, contrasts=True, expected=lambda order: F.lit(1.0), **FAMILY)


@query(f"WITH {LEDGER} SELECT interval_id, {_ledger_sql(ledger.BANDS)} FROM wn GROUP BY interval_id")
def ledger_bands(spark, sf):
    return ledger.over_slots(all_pairs(spark, sf), partials(spark, sf), ledger.BANDS, SIGNALS, expected=lambda order: F.lit(1.0), **FAMILY)


@query(f"WITH {LEDGER} SELECT interval_id, " + ", ".join(rs(**{f"coverage_lag{k}": f"max(CASE WHEN lag_ = {k} THEN records / expected END)", **{f"{s}_lag{k}_mean": f"max(CASE WHEN lag_ = {k} THEN {s}__mean END)" for s in SIGNALS}, **{f"{s}_lag{k}_minutes": f"max(CASE WHEN lag_ = {k} THEN {s}__active END) * 5.0" for s in STATES}, **{f"{m}_lag{k}_fraction": f"max(CASE WHEN lag_ = {k} THEN {m}__records / records END)" for m in MODES}}) for k in range(1, 8)) + " FROM wn GROUP BY interval_id")
def sequence_pivot(spark, sf):
    return ledger.sequence_over_slots(all_pairs(spark, sf), partials(spark, sf), SIGNALS, STATES, MODES, expected=lambda order: F.lit(1.0))


@query(f"WITH {LEDGER} SELECT interval_id, " + rs(**{f"{c}_lag{k}": f"max(CASE WHEN lag_ = {k} THEN {c} END)" for c in ("value__max", "value__min") for k in range(1, 8)}) + " FROM wn GROUP BY interval_id")
def lag_pivot(spark, sf):
    return windows.pivot_lags(backward(spark, sf), ["value__max", "value__min"])


def _heights_sql() -> str:
    whole = lambda s, n: f"CASE WHEN sum(CASE WHEN lag_ <= {n} THEN records ELSE 0 END) / sum(CASE WHEN lag_ <= {n} THEN expected ELSE 0 END) >= 0.8 THEN coalesce(sum(CASE WHEN lag_ <= {n} THEN {s}__mean * {s}__count END), 0.0) * 5.0 / 60 END"
    one = lambda n: {f"i2r_{n}st_per_liquid": f"({whole('value', n)}) / nullif(h + h / 2, 0)", f"excess_{n}st_per_bath": f"({whole('centred', n)}) / nullif(h, 0)", f"rth_{n}st_per_bath": f"({whole('value', n)}) / nullif(h, 0)", f"feed_{n}st_per_bath": f"({whole('value', n)}) / nullif(h, 0)", f"excess_{n}st_by_low": f"({whole('centred', n)}) * 0.25"}
    return ", ".join(rs(**one(n)) for n in (6, 12, 21))


@query(f"WITH {LEDGER}, hh AS (SELECT interval_id, CAST(CAST(floor(start) AS BIGINT) % 5 AS DOUBLE) AS h FROM ivall) SELECT interval_id, {_heights_sql()} FROM wn JOIN hh USING (interval_id) GROUP BY interval_id, h")
def height_interactions(spark, sf):
    f = ledger.features(backward(spark, sf), {"6st": (1, 6), "12st": (1, 12), "21st": (1, 21)}, SIGNALS, integrals=SIGNALS)
    h = all_pairs(spark, sf).select("interval_id", (F.floor("start") % 5).cast("double").alias("hbd_last"))
    f = f.join(h, "interval_id").withColumns({"hmd_last": F.col("hbd_last") / 2, "low_share": F.lit(0.25)})
    out = ledger.height_interactions(f, "value", "centred", "value", "value")
    return out.select("interval_id", *[c for c in out.columns if "_per_" in c or c.endswith("_by_low")])


# splits, metrics


@query(f"WITH {PREDICTED} SELECT interval_id, segment, {rs(p_last='p_last', p_mean2='p_mean2', p_extrapolated='p_extrapolated')} FROM pr")
def chrono_split(spark, sf):
    return predicted(spark, sf).select("interval_id", "segment", *PREDICTIONS)


@query(f"WITH {PREDICTED} SELECT segment, variant, {SUMMARY} FROM er GROUP BY segment, variant")
def baseline_metrics(spark, sf):
    return metrics.by(errors(spark, sf), "segment", "variant")


@query(f"WITH {PREDICTED} SELECT variant, {SUMMARY} FROM er WHERE gap = 8 GROUP BY variant")
def flagship(spark, sf):
    return entry(spark, sf)


@query(f"WITH {PREDICTED} SELECT interval_id, " + rs(**{f"{k}_{p}": e for p in PREDICTIONS for k, e in (("error", f'{p} - "end"'), ("abs_error", f'abs({p} - "end")'))}) + " FROM pr")
def row_errors_wide(spark, sf):
    return metrics.errors(predicted(spark, sf), PREDICTIONS).select("interval_id", *[f"{k}_{p}" for p in PREDICTIONS for k in ("error", "abs_error")])


@query(f"""WITH {PREDICTED}, tg AS (SELECT *, unnest([CASE WHEN true THEN 'all' END, CASE WHEN delta <= -5 THEN 'cooling' END, CASE WHEN delta > -5 AND delta < 5 THEN 'stable' END, CASE WHEN delta >= 5 THEN 'heating' END, CASE WHEN start >= 300 THEN 'hot_start' END, CASE WHEN "end" >= 300 THEN 'hot_target' END, CASE WHEN "end" >= 300 AND delta >= 5 THEN 'hot_and_heating' END]) AS regime FROM er)
SELECT regime, variant, {SUMMARY} FROM tg WHERE regime IS NOT NULL GROUP BY regime, variant""")
def regime_masks(spark, sf):
    return metrics.by_regime(predicted(spark, sf), PREDICTIONS, regimes=REGIMES)


@query(f"""WITH {PREDICTED}, g AS (SELECT unnest(['segment', 'kind']) AS "grouping", unnest([segment, CASE WHEN before2 IS NULL THEN NULL WHEN delta > 0 THEN 'up' ELSE 'down' END]) AS value, error FROM er)
SELECT "grouping", value, count(*) AS rows, {rs(mae="avg(abs(error))", bias="avg(error)")} FROM g GROUP BY 1, 2 HAVING count(*) >= 100""")
def subgroup_metrics(spark, sf):
    p = predicted(spark, sf).withColumn("kind", F.when(F.col("before2").isNotNull(), F.when(F.col("delta") > 0, "up").otherwise("down")))
    return metrics.by_each(metrics.long(p, PREDICTIONS, "end", ["segment", "kind"]), ["segment", "kind"], 100)


@query(f"""WITH {PREDICTED}, b AS (SELECT CASE WHEN "end" <= 100 THEN '<=100' WHEN "end" <= 300 THEN '100-300' WHEN "end" <= 450 THEN '300-450' WHEN "end" <= 900 THEN '450-900' ELSE '>900' END AS bin, error FROM er),
l AS (SELECT unnest(['<=100', '100-300', '300-450', '450-900', '>900']) AS bin, unnest([0, 1, 2, 3, 4]) AS position) SELECT bin, CAST(position AS BIGINT) AS position, count(error) AS rows, {r("avg(abs(error))", "mae")} FROM l LEFT JOIN b USING (bin) GROUP BY bin, position""")
def binned_error(spark, sf):
    labels = ("<=100", "100-300", "300-450", "450-900", ">900")
    p = predicted(spark, sf).withColumn("bin", S.right_closed("end", (100, 300, 450, 900), labels))
    return metrics.by_bin(metrics.long(p, PREDICTIONS, "end", ["bin"]), "bin", labels)


@query(f"""WITH {PREDICTED}, m AS (SELECT segment, variant, count(*) AS rows, avg(abs(error)) AS mae FROM er GROUP BY 1, 2) SELECT variant, CAST(sum(rows) AS BIGINT) AS rows, {r("sum(mae * rows) / sum(rows)", "mae")} FROM m GROUP BY variant""")
def weighted_fold_mae(spark, sf):
    return metrics.weighted_mean(metrics.by(errors(spark, sf), "segment", "variant"), "mae", "rows", "variant").select("variant", "rows", "mae")


@query(f"""WITH {PREDICTED}, m AS (SELECT segment, variant, avg(abs(error)) AS mae FROM er GROUP BY 1, 2) SELECT segment, {rs(**{p: f"max(CASE WHEN variant = '{p}' THEN mae END)" for p in PREDICTIONS})} FROM m GROUP BY segment""")
def variant_pivot(spark, sf):
    return metrics.wide(metrics.by(errors(spark, sf), "segment", "variant"), "segment", "variant", PREDICTIONS, "mae")


@query(f"""WITH {PREDICTED}, m AS (SELECT variant, avg(abs(error)) AS mae FROM er GROUP BY 1), b AS (SELECT mae AS base FROM m WHERE variant = 'p_mean2') SELECT variant, {rs(mae="mae", base="base", improvement_pct="(base - mae) * 100 / nullif(base, 0)")} FROM m, b""")
def relative_improvement(spark, sf):
    return metrics.improvement(metrics.by(errors(spark, sf), "variant"), "p_mean2")


@query(f"""WITH {PREDICTED}, m AS (SELECT segment, variant, avg(abs(error)) AS mae FROM er GROUP BY 1, 2) SELECT segment, arg_min(variant, (mae, variant)) AS variant, {r("min(mae)", "mae")} FROM m GROUP BY segment""")
def best_variant(spark, sf):
    return metrics.best(metrics.by(errors(spark, sf), "segment", "variant"), "mae", "segment")


@query(f"""WITH {PREDICTED}, h AS (SELECT cell, "end" - p_mean2 AS residual FROM pr WHERE segment = 'train'), a AS (SELECT avg(residual) AS m FROM h) SELECT cell, count(residual) AS n, {r("(avg(residual) - max(m)) * count(residual) / (count(residual) + 20.0)", "deviation")} FROM h, a GROUP BY cell""")
def shrunk_group_residual(spark, sf):
    train = predicted(spark, sf).where("segment = 'train'").withColumn("residual", F.col("end") - F.col("p_mean2"))
    return metrics.shrunk_residuals(train, "cell", "residual")


@query(f"""WITH {PREDICTED}, h AS (SELECT cell, "end" - p_mean2 AS residual FROM pr WHERE segment = 'train'), a AS (SELECT avg(residual) AS m FROM h), d AS (SELECT cell, (avg(residual) - max(m)) * count(residual) / (count(residual) + 20.0) AS deviation FROM h, a GROUP BY cell) SELECT interval_id, {r("p_mean2 + 0.8 * coalesce(deviation, 0)", "p_mean2_calibrated")} FROM pr LEFT JOIN d USING (cell) WHERE segment = 'test'""")
def cell_calibration(spark, sf):
    p = predicted(spark, sf)
    d = metrics.shrunk_residuals(p.where("segment = 'train'").withColumn("residual", F.col("end") - F.col("p_mean2")), "cell", "residual")
    return metrics.calibrated(p.where("segment = 'test'"), d, "cell", "p_mean2").select("interval_id", "p_mean2_calibrated")


def classified(spark, sf):
    p = predicted(spark, sf)
    return p.withColumns({"hot": F.col("end") >= HOT, "probability": F.col("p_mean2") / 500, "hot_before": F.col("start") > HOT})


CLASSIFIED = PREDICTED + """, cl AS (SELECT *, CAST("end" >= 300 AS INT) AS hot, p_mean2 / 500 AS probability, CAST(start > 300 AS INT) AS hot_before FROM pr)"""


@query(f"""WITH {CLASSIFIED}, c AS (SELECT segment, CAST(sum(hot * hot_before) AS BIGINT) AS tp, CAST(sum((1 - hot) * hot_before) AS BIGINT) AS fp, CAST(sum(hot * (1 - hot_before)) AS BIGINT) AS fn, CAST(sum((1 - hot) * (1 - hot_before)) AS BIGINT) AS tn, avg((probability - hot) ** 2) AS brier FROM cl GROUP BY segment)
SELECT segment, tp, fp, fn, tn, {rs(brier="brier", precision="coalesce(tp / nullif(tp + fp, 0), 0)", recall="coalesce(tp / nullif(tp + fn, 0), 0)", specificity="coalesce(tn / nullif(tn + fp, 0), 0)", f1="coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", accuracy="(tp + tn) / (tp + tn + fp + fn)")} FROM c""")
def confusion_metrics(spark, sf):
    return metrics.confusion(classified(spark, sf), "hot", "hot_before", "probability", "segment")


@query(f"""WITH {CLASSIFIED}, t AS (SELECT k / 100.0 AS threshold FROM range(5, 96) q(k)), c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, sum(CASE WHEN probability >= CAST(threshold AS DOUBLE) THEN hot ELSE 0 END) AS tp, sum(CASE WHEN probability >= CAST(threshold AS DOUBLE) THEN 1 - hot ELSE 0 END) AS fp, sum(CASE WHEN probability < CAST(threshold AS DOUBLE) THEN hot ELSE 0 END) AS fn FROM cl, t GROUP BY 1),
s AS (SELECT threshold, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision FROM c) SELECT {rs(threshold="threshold", f1="f1", precision="precision")} FROM s ORDER BY s.f1 DESC, s.precision DESC, s.threshold DESC LIMIT 1""")
def threshold_grid_f1(spark, sf):
    return metrics.best_threshold(classified(spark, sf), "hot", "probability")


@query(f"""WITH {CLASSIFIED}, p AS (SELECT hot, probability FROM cl), a AS (SELECT (SELECT sum(CASE WHEN x.probability > y.probability THEN 1.0 WHEN x.probability = y.probability THEN 0.5 ELSE 0 END) FROM p x, p y WHERE x.hot = 1 AND y.hot = 0) / nullif((SELECT sum(hot) FROM p) * (SELECT sum(1 - hot) FROM p), 0) AS auc),
g AS (SELECT probability, sum(hot) AS pos, count(*) AS n FROM p GROUP BY 1), w AS (SELECT pos, sum(pos) OVER o AS tp, sum(n) OVER o AS al, sum(pos) OVER () AS allpos FROM g WINDOW o AS (ORDER BY probability DESC)) SELECT {rs(auc="max(auc)", average_precision="sum(CAST(pos * tp AS DOUBLE) / nullif(al * allpos, 0))")} FROM w, a""")
def ranking_metrics(spark, sf):
    return metrics.ranking(classified(spark, sf), "hot", "probability")


@query(f"""WITH {PREDICTED}, c AS (SELECT CASE WHEN delta <= -5 THEN 0 WHEN delta >= 5 THEN 2 ELSE 1 END AS way, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS guess FROM (SELECT delta, start / 500 AS a, 0.2 AS b, 1 - start / 500 AS c FROM pr))
SELECT CAST(way AS BIGINT) AS way, count(*) AS rows, CAST(sum(CAST(guess = 0 AS INT)) AS BIGINT) AS as_0, CAST(sum(CAST(guess = 1 AS INT)) AS BIGINT) AS as_1, CAST(sum(CAST(guess = 2 AS INT)) AS BIGINT) AS as_2, {r("avg(CAST(guess = way AS INT))", "recall")} FROM c GROUP BY way""")
def class_argmax_recall(spark, sf):
    p = predicted(spark, sf).withColumns({"way": S.direction("delta"), "guess": S.argmax(F.col("start") / 500, F.lit(0.2), 1 - F.col("start") / 500)})
    return metrics.class_recalls(p, "way", "guess")


@query(f"""WITH {PREDICTED} SELECT {rs(**{f"share_{k}": f"avg(CASE WHEN {c} THEN 1.0 ELSE 0 END)" for k, c in ((0, "delta <= -5"), (1, "delta > -5 AND delta < 5"), (2, "delta >= 5"))})} FROM pr""")
def class_prevalence(spark, sf):
    return metrics.prevalence(predicted(spark, sf).withColumn("way", S.direction("delta")), "way", (0, 1, 2))


@query(f"""WITH {PREDICTED} SELECT variant, count(*) AS rows, {rs(under_pct="avg(CASE WHEN error < 0 THEN 100.0 ELSE 0 END)", under_5_pct="avg(CASE WHEN error <= -5 THEN 100.0 ELSE 0 END)", p90="quantile_cont(abs(error), 0.9)")} FROM er WHERE "end" >= 300 GROUP BY variant""")
def hot_case_errors(spark, sf):
    return metrics.hot_cases(metrics.long(predicted(spark, sf).withColumn("target", F.col("end")), PREDICTIONS, "end", ["target"]), F.col("target") >= HOT)


@query(f"""WITH {PREDICTED}, a AS (SELECT interval_id, p_last FROM pr WHERE segment <> 'train'), b AS (SELECT interval_id, p_mean2 AS p_last FROM pr WHERE segment <> 'test') SELECT count(CASE WHEN a.interval_id IS NOT NULL AND b.interval_id IS NOT NULL THEN 1 END) AS matched, count(CASE WHEN a.interval_id IS NULL OR b.interval_id IS NULL THEN 1 END) AS unmatched, {r("max(abs(a.p_last - b.p_last))", "max_diff_p_last")} FROM a FULL JOIN b ON a.interval_id = b.interval_id""")
def result_difference(spark, sf):
    p = predicted(spark, sf)
    return metrics.largest_difference(p.where("segment <> 'train'").select("interval_id", "p_last"), p.where("segment <> 'test'").select("interval_id", F.col("p_mean2").alias("p_last")), ["interval_id"], ["p_last"])


@query(f"""WITH {PAIRS}, x AS (SELECT interval_id, list_sort([{{o: -abs(coalesce(start - 245, 0)), name: 'start', v: start - 245}}, {{o: -abs(coalesce(before2 - 245, 0)), name: 'before2', v: before2 - 245}}, {{o: -abs(coalesce(before3 - 245, 0)), name: 'before3', v: before3 - 245}}, {{o: -abs(coalesce(delta, 0)), name: 'delta', v: delta}}]) AS l FROM ivall)
SELECT interval_id, {", ".join(f'l[{k}].name AS name_{k}, {r(f"l[{k}].v", f"value_{k}")}' for k in (1, 2, 3))} FROM x""")
def top3_contributions(spark, sf):
    p = all_pairs(spark, sf).withColumns({c: F.col(c) - 245 for c in ("start", "before2", "before3")})
    return metrics.top_contributions(p, ["start", "before2", "before3", "delta"], "interval_id")


@query(f"WITH {PREDICTED} SELECT segment, count(*) AS rows, min(day) AS first_day, max(day) AS last_day FROM pr GROUP BY segment")
def segment_ranges(spark, sf):
    return audit.segment_ranges(predicted(spark, sf), "segment", "day")


# audits and contracts


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS extra, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS affected FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def dup_audit(spark, sf):
    return audit.duplicates(io.table(spark, sf, "events"), ["user_id", "event_type"])


GAPS = """gp AS (SELECT user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap_s FROM events)"""


@query(f"WITH {GAPS} SELECT user_id, count(gap_s) AS gaps, round(median(gap_s), 3) AS median_s, {r('max(gap_s)', 'max_s')} FROM gp GROUP BY user_id")
def cadence_gaps(spark, sf):
    return audit.gaps(io.table(spark, sf, "events"), "user_id").groupBy("user_id").agg(F.count("gap_s").alias("gaps"), F.round(F.median("gap_s"), 3).alias("median_s"), F.max("gap_s").alias("max_s"))


@query(f"WITH {GAPS} SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS cells FROM gp WHERE gap_s >= 7200 GROUP BY 1 ORDER BY cells DESC, hour LIMIT 1")
def shared_gap_hour(spark, sf):
    return audit.shared_gap_hour(io.table(spark, sf, "events"), 7200, "user_id")


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    one = "SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT CAST({c} AS VARCHAR)) AS distinct_values, {s}, '{t}' AS type, round((count(*) - count({c})) * 100.0 / count(*), 6) + 0.0 AS null_pct, {looks} AS looks_numeric FROM {table}"
    share = "avg(CASE WHEN regexp_full_match(CAST({c} AS VARCHAR), '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?') THEN 1.0 WHEN {c} IS NOT NULL THEN 0 END)"
    return " UNION ALL ".join(one.format(c=c, t=t, table=table, s=r(share.format(c=c), "numeric_share"), looks=f"coalesce({share.format(c=c)} >= 0.8, false)") for c, t in columns.items())


@query(_profile_sql("customer", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_mktsegment": "string"}))
def column_profile(spark, sf):
    return audit.profile(io.table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("int"), "c_mktsegment"), 0)


@query("SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return audit.value_counts(io.table(spark, sf, "events"), "event_type")


@query("SELECT event_type, count(value) AS count, " + rs(mean="avg(value)", std="stddev_samp(value)", min="min(value)", max="max(value)", p01="quantile_cont(value, 0.01)", p50="quantile_cont(value, 0.5)", p99="quantile_cont(value, 0.99)") + " FROM events GROUP BY event_type")
def describe_quantiles(spark, sf):
    return audit.quantiles(io.table(spark, sf, "events"), "value", (0.01, 0.5, 0.99), "event_type")


@query(f"WITH {PAIRS} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {r(f'avg(CASE WHEN "{c}" IS NULL THEN 100.0 ELSE 0 END)', "null_pct")} FROM ivall""" for c in ("start", "end", "before2", "before3")))
def null_shares(spark, sf):
    return audit.null_shares(all_pairs(spark, sf).select("start", "end", "before2", "before3"))


@query("SELECT 'flat' AS \"column\", CAST(1 AS BIGINT) AS distinct_values UNION ALL SELECT 'nothing', 0")
def constant_columns(spark, sf):
    return audit.constant_columns(io.table(spark, sf, "events").select("ts", "value", F.lit(1).alias("flat"), F.lit(None).cast("double").alias("nothing")))


@query(f"WITH {PAIRS} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls, count(CASE WHEN {c} = 0 THEN 1 END) AS zeros, count(CASE WHEN {c} > 0 THEN 1 END) AS positives, count(CASE WHEN {c} < 0 THEN 1 END) AS negatives FROM ivall""" for c in ("delta", "before2")))
def encoding_review(spark, sf):
    return audit.encoding(all_pairs(spark, sf), ["delta", "before2"])


@query("SELECT count(*) AS cells, min(n) AS min_rows, " + r("median(n)", "median_rows") + ", max(n) AS max_rows FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def cell_rows(spark, sf):
    return audit.cell_rows(io.table(spark, sf, "events"), "user_id")


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS distinct_values FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def ambiguous_mapping(spark, sf):
    return audit.ambiguous(io.table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT user_id) AS cells, CAST(day(last_day(max(ts))) * 150 * 288 AS BIGINT) AS expected, " + r("count(*) / (day(last_day(max(ts))) * 150 * 288)", "coverage") + " FROM events GROUP BY 1")
def month_coverage(spark, sf):
    return audit.month_coverage(io.table(spark, sf, "events"), "ts", "user_id", 150)


@query("SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS cells, min(ts) AS first_ts, max(ts) AS last_ts, count(value) AS with_value, " + rs(mean_value="avg(value)", median_value="quantile_cont(value, 0.5)", p90_value="quantile_cont(value, 0.9)") + " FROM events WHERE event_type IN ('error', 'signup') GROUP BY event_type")
def event_code_profile(spark, sf):
    return audit.code_profile(io.table(spark, sf, "events"), "event_type", "ts", "user_id", "value", ["error", "signup"])


@query("SELECT count(*) AS rows, count(CASE WHEN event_type = 'error' THEN 1 END) AS error_rows, count(CASE WHEN event_type = 'error' AND value > 245 THEN 1 END) AS high_errors, count(CASE WHEN value > 245 AND user_id % 2 = 0 THEN 1 END) AS high_even FROM events")
def overlap_counts(spark, sf):
    return audit.condition_counts(io.table(spark, sf, "events"), {"rows": "true", "error_rows": "event_type = 'error'", "high_errors": "event_type = 'error' AND value > 245", "high_even": "value > 245 AND user_id % 2 = 0"})


@query(f"WITH {FORWARD}, c AS (SELECT interval_id, max(day) AS day, sum(coalesce(records, 0)) / sum(expected) AS coverage FROM wn JOIN (SELECT interval_id, day FROM ivall) USING (interval_id) GROUP BY 1) SELECT strftime(day, '%Y-%m') AS month, count(*) AS rows, {rs(mean_coverage='avg(coverage)', min_coverage='min(coverage)')}, CAST(sum(CAST(coverage >= 0.8 AS INT)) AS BIGINT) AS covered FROM c GROUP BY 1")
def month_quality(spark, sf):
    days = all_pairs(spark, sf).select("interval_id", "day")
    return audit.month_quality(highfreq.coverage(forward(spark, sf)).join(days, "interval_id"), "day")


@query(f"""WITH {PREDICTED}, k AS (SELECT CASE WHEN delta > 0 THEN 'up' ELSE 'down' END AS way, start, before2 FROM pr WHERE segment = 'train') SELECT {rs(start="median(start)", before2="median(before2)")}, (SELECT way FROM k GROUP BY way ORDER BY count(*) DESC, way LIMIT 1) AS way FROM k""")
def reference_values(spark, sf):
    p = predicted(spark, sf).where("segment = 'train'").withColumn("way", F.when(F.col("delta") > 0, "up").otherwise("down"))
    return audit.reference_values(p, ["start", "before2"], ["way"])


@query(f"""WITH {PAIRS} SELECT rule, (SELECT count(*) FROM ivall) AS rows, violations FROM (SELECT 'start_before_end' AS rule, 0 AS violations UNION ALL SELECT 'gap_of_eight', count(*) FROM ivall WHERE gap <> 8 UNION ALL SELECT 'has_start', 0 UNION ALL SELECT 'has_end', 0 UNION ALL SELECT 'delta', 0)""")
def interval_contract(spark, sf):
    return contracts.violations(all_pairs(spark, sf), contracts.INTERVALS)


@query(f"""WITH {PAIRS}, ex AS (SELECT ord_start, ord_end, ord_start + unnest(range(1, 8)) AS ord FROM ivall) SELECT 'before_target' AS rule, count(*) AS rows, count(CASE WHEN ord >= ord_end THEN 1 END) AS violations FROM ex UNION ALL SELECT 'after_start', count(*), 0 FROM ex""")
def leakage_check(spark, sf):
    p = all_pairs(spark, sf)
    return contracts.violations(windows.expand(p, 7).join(p.select("interval_id", "ord_start", "ord_end"), "interval_id"), contracts.LEAKAGE)


@query("SELECT user_id, event_type, count(*) AS rows FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return contracts.repeated_keys(io.table(spark, sf, "events"), ["user_id", "event_type"])


@query(f"""WITH {PREDICTED} SELECT interval_id FROM (SELECT interval_id, start / 500 AS a, 1 - start / 500 + CASE WHEN before2 IS NULL THEN 0.1 ELSE 0 END AS b FROM pr) WHERE abs(a + b - 1) > 1e-6""")
def probability_check(spark, sf):
    p = predicted(spark, sf).withColumns({"a": F.col("start") / 500, "b": 1 - F.col("start") / 500 + F.when(F.col("before2").isNull(), 0.1).otherwise(0.0)})
    return contracts.probabilities(p, ["a", "b"]).select("interval_id")


@query("""SELECT 'events.parquet' AS file, (SELECT count(*) FROM events) AS rows, "column", (SELECT count(*) FROM events) - n AS nulls FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value']) AS "column", unnest([count(event_id), count(ts), count(user_id), count(event_type), count(value)]) AS n FROM events)""")
def footer_nulls(spark, sf):
    found = audit.footers(spark, audit.leaf_files(io.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")))
    return found.select(F.lit("events.parquet").alias("file"), "rows", "column", "nulls").where(F.col("column").isin("event_id", "ts", "user_id", "event_type", "value"))


@query("""SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS rows, """ + rs(quantity="sum(l_quantity)", revenue="sum(l_extendedprice * (1 - l_discount))") + """ FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2""")
def pushed_month_rollup(spark, sf):
    part = io.between(io.parquet(spark, f"{sf}/lineitem.parquet", ["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"]), "l_shipdate", "1996-01-01", "1997-01-01")
    return part.groupBy("l_suppkey", S.month("l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))

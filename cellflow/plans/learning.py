"""Registered queries on resampling and models.

Least squares has a closed form, so linear models are held against SQL; other learners have none.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import functions as F

from ..functions import families
from ..functions import scalars as S
from ..operators import intervals, metrics, models, resample
from ..operators.quantiles import with_percentiles
from ..sources import io
from .registry import HOT, PREDICTED, PREDICTIONS, all_pairs, predicted, query, r, rs

SEED = 42


def _uniform_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0"


def _poisson_sql(u: str) -> str:
    upto, term, out = 0.0, math.exp(-1.0), ""
    for k in range(12):
        upto += term
        out += f" WHEN {u} < CAST({upto!r} AS DOUBLE) THEN {k}"
        term *= 1.0 / (k + 1)
    return f"CASE{out} ELSE 12 END"


def _bootstrap_sql(units: str) -> str:
    return f"""{units}, rp AS (SELECT rr, s, n, {_uniform_sql(f"k || '|' || rr || '|{SEED}'")} AS u FROM un, range(3000) t(rr)),
es AS (SELECT rr, sum(s * w) / nullif(sum(n * w), 0) AS diff FROM (SELECT rr, s, n, {_poisson_sql('u')} AS w FROM rp) GROUP BY rr)
SELECT {rs(diff_low="quantile_cont(diff, 0.025)", diff_mean="avg(diff)", diff_high="quantile_cont(diff, 0.975)")} FROM es"""


DIFFERENCE = 'abs(p_last - "end") - abs(p_mean2 - "end")'


@query(f"SELECT o_orderkey, {r('o_totalprice', 'o_totalprice')} FROM orders ORDER BY md5(o_orderkey || '|{SEED}'), o_orderkey LIMIT 8000")
def hash_sample(spark, sf):
    return resample.sample(io.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query(_bootstrap_sql(f"WITH {PREDICTED}, un AS (SELECT CAST(floor({_uniform_sql(f"interval_id || '|{SEED}'")} * {resample.BUCKETS}) AS BIGINT) AS k, sum({DIFFERENCE}) AS s, count(*) AS n FROM pr GROUP BY 1)"))
def bootstrap_interval(spark, sf):
    return resample.paired_bootstrap(metrics.errors(predicted(spark, sf), PREDICTIONS), "interval_id", "error_p_last", "error_p_mean2", seed=SEED)


@query(_bootstrap_sql(f"""WITH {PREDICTED}, cl AS (SELECT cell, sum({DIFFERENCE}) AS s, count(*) AS n FROM pr GROUP BY cell), un AS (SELECT k, sum(s) AS s, CAST(sum(n) AS BIGINT) AS n FROM (SELECT s, n,
CASE WHEN (SELECT count(*) FROM cl) > {resample.BUCKETS} THEN CAST(floor({_uniform_sql(f"cell || '|{SEED}'")} * {resample.BUCKETS}) AS BIGINT) ELSE cell END AS k FROM cl) GROUP BY k)"""))
def cluster_bootstrap_interval(spark, sf):
    return resample.cluster_bootstrap(metrics.errors(predicted(spark, sf), PREDICTIONS), "cell", "error_p_last", "error_p_mean2", seed=SEED)


FORMULA = {"start": 0.6, "before2": 0.3, "before3": 0.1}


def _permutation_sql() -> str:
    """The rise in mean absolute error of a fixed formula, for each column and repeat."""
    terms = lambda given: " + ".join(f"{w} * {'g.v' if c == given else f'a.{c}'}" for c, w in FORMULA.items())
    each = []
    for c in FORMULA:
        for k in range(3):
            seed = SEED + 10 * k
            each.append(f"""SELECT '{c}' AS feature, avg(abs({terms(c)} - a."end")) - (SELECT avg(abs({' + '.join(f'{w} * {n}' for n, w in FORMULA.items())} - "end")) FROM fr) AS rise
FROM (SELECT *, row_number() OVER (ORDER BY md5(interval_id || '|{seed}'), interval_id) AS k FROM fr) a JOIN (SELECT {c} AS v, row_number() OVER (ORDER BY md5(interval_id || '|{seed + 1}'), interval_id) AS k FROM fr) g USING (k)""")
    return f"WITH {PREDICTED}, fr AS (SELECT * FROM pr WHERE before3 IS NOT NULL) SELECT feature, {r('avg(rise)', 'rise')} FROM ({' UNION ALL '.join(each)}) GROUP BY feature"


@query(_permutation_sql())
def permutation_importance(spark, sf):
    frame = predicted(spark, sf).where("before3 IS NOT NULL").select("interval_id", *FORMULA, "end")
    told = F.avg(F.abs(sum((F.col(c) * w for c, w in FORMULA.items()), F.lit(0.0)) - F.col("end")))
    rises = resample.permutation_importance(frame, "interval_id", list(FORMULA), lambda f: f.agg(told).first()[0], seed=SEED)
    return spark.createDataFrame(rises, "feature string, rise double")


# linear models


def model_rows(spark, sf):
    return predicted(spark, sf).select("interval_id", "cell", "day", "segment", "start", "before2", "before3", "end", "delta", "p_mean2")


def parts(spark, sf):
    rows = model_rows(spark, sf)
    return rows.where("segment = 'train'"), rows.where("segment = 'test'")


def plain(long_):
    """Rows, mae, rmse and bias by variant, to four places: the solver's steps are not those of the closed form."""
    found = {"mae": F.avg(F.abs("error")), "rmse": F.sqrt(F.avg(F.col("error") * F.col("error"))), "bias": F.avg("error")}
    return long_.groupBy("variant").agg(F.count("error").alias("rows"), *[F.round(c, 4).alias(n) for n, c in found.items()])


PLAIN = "count(error) AS rows, " + ", ".join(f'round({e}, 4) + 0.0 AS "{n}"' for n, e in {"mae": "avg(abs(error))", "rmse": "sqrt(avg(error * error))", "bias": "avg(error)"}.items())


def _two(y: str, a: str, b: str, source: str) -> str:
    """Least squares of y on a and b: one row c0, c1, c2."""
    return f"""SELECT my - c1 * ma - c2 * mb AS c0, c1, c2 FROM (SELECT my, ma, mb, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS c1, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS c2 FROM
(SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, covar_pop(a, b) AS sab, var_pop(a) AS saa, var_pop(b) AS sbb FROM (SELECT {y} AS y, {a} AS a, {b} AS b FROM {source})))"""


FULL = "tr AS (SELECT * FROM pr WHERE segment = 'train' AND before3 IS NOT NULL), te AS (SELECT * FROM pr WHERE segment = 'test' AND before3 IS NOT NULL)"


@query(f"""WITH {PREDICTED}, {FULL}, m2 AS ({_two('"end"', "start", "before2", "tr")}), md AS ({_two("delta", "start - before2", "before2 - before3", "tr")}),
al AS (SELECT 'ar2' AS variant, c0 + c1 * start + c2 * before2 - "end" AS error FROM te, m2 UNION ALL SELECT 'delta_history', start + c0 + c1 * (start - before2) + c2 * (before2 - before3) - "end" FROM te, md) SELECT variant, {PLAIN} FROM al GROUP BY variant""")
def autoregressive_linear(spark, sf):
    train, test = (intervals.history(f).where("before3 IS NOT NULL") for f in parts(spark, sf))
    fitted = models.autoregressive(train, history=["change_last", "change_before"])
    return plain(metrics.long(fitted["delta_history"].transform(fitted["ar2"].transform(test)), ["ar2", "delta_history"], "end"))


@query(f"""WITH {PREDICTED}, {FULL}, ab AS (SELECT regr_intercept("end", before2) AS c0, regr_slope("end", before2) AS c1 FROM tr), de AS (SELECT regr_intercept(delta, before2) AS c0, regr_slope(delta, before2) AS c1 FROM tr),
al AS (SELECT 'by_absolute' AS variant, c0 + c1 * before2 - "end" AS error FROM te, ab UNION ALL SELECT 'by_delta', start + c0 + c1 * before2 - "end" FROM te, de) SELECT variant, {PLAIN} FROM al GROUP BY variant""")
def target_strategies(spark, sf):
    train, test = (f.where("before3 IS NOT NULL") for f in parts(spark, sf))
    names = [f"by_{strategy}" for strategy in models.STRATEGIES]
    for strategy, name in zip(models.STRATEGIES, names, strict=True):
        test = models.fit_target(train, "end", "start", strategy, ["before2"], kind="linear", out=name).transform(test)
    return plain(metrics.long(test, names, "end"))


WEIGHTED = """SELECT my - c1 * mx AS c0, c1 FROM (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, (sum(w * x * y) / sum(w) - sum(w * x) * sum(w * y) / sum(w) ** 2) / (sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) AS c1
FROM (SELECT start AS x, "end" AS y, CASE WHEN "end" >= 300 THEN 4.0 WHEN delta > 5 THEN 3.0 ELSE 1.0 END AS w FROM pr WHERE segment = 'train'))"""


@query(f"""WITH {PREDICTED}, m AS ({WEIGHTED}) SELECT 'weighted' AS variant, {PLAIN} FROM (SELECT c0 + c1 * start - "end" AS error FROM pr, m WHERE segment = 'test')""")
def weighted_linear(spark, sf):
    train, test = parts(spark, sf)
    train = train.withColumn("weight", S.sample_weight("delta", "end", "both", HOT))
    return plain(metrics.long(models.fit(train, "end", ["start"], kind="linear", out="weighted", weight="weight").transform(test), ["weighted"], "end"))


@query(f"""WITH {PREDICTED}, m AS (SELECT regr_intercept("end" - p_mean2, start) AS c0, regr_slope("end" - p_mean2, start) AS c1 FROM pr WHERE segment = 'train'),
al AS (SELECT 'p_mean2' AS variant, p_mean2 - "end" AS error FROM pr WHERE segment = 'test' UNION ALL SELECT 'corrected', p_mean2 + c0 + c1 * start - "end" FROM pr, m WHERE segment = 'test') SELECT variant, {PLAIN} FROM al GROUP BY variant""")
def residual_linear(spark, sf):
    train, test = parts(spark, sf)
    scored = models.fit_residual(train, "p_mean2", "end", ["start"], kind="linear").transform(test).withColumn("corrected", F.col("p_mean2") + F.col("correction"))
    return plain(metrics.long(scored, ["p_mean2", "corrected"], "end"))


EDGES = [date(2024, 1, 9), date(2024, 1, 14), date(2024, 1, 19), date(2024, 1, 24)]


def _folds_sql() -> str:
    each = [f"""SELECT {i} AS fold, c0 + c1 * start - "end" AS error FROM pr, (SELECT regr_intercept("end", start) AS c0, regr_slope("end", start) AS c1 FROM pr WHERE day < DATE '{a}') WHERE day >= DATE '{a}' AND day < DATE '{b}'""" for i, (a, b) in enumerate(zip(EDGES[:-1], EDGES[1:], strict=True))]
    return f"WITH {PREDICTED}, al AS ({' UNION ALL '.join(each)}) SELECT CAST(fold AS BIGINT) AS fold, 'linear' AS variant, {PLAIN} FROM al GROUP BY fold"


@query(_folds_sql())
def rolling_linear(spark, sf):
    return models.rolling_validation(model_rows(spark, sf), "day", EDGES, "end", ["start"], ["linear"]).select("fold", "variant", "rows", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias")])


@query(f"""WITH {PREDICTED}, m AS (SELECT regr_slope("end", start) AS c1, avg(start) AS mx FROM pr WHERE segment = 'train'), q AS (SELECT quantile_cont(start, 0.5) AS v FROM pr) SELECT interval_id, {r("c1 * (start - mx)", "share")}, {r("c1 * (start - v)", "effect")} FROM pr, m, q WHERE segment = 'test'""")
def linear_effects(spark, sf):
    train, test = parts(spark, sf)
    m = models.fit(train, "end", ["start"], kind="linear")
    middle = with_percentiles(model_rows(spark, sf), F.col("start"), {"v": 0.5}, [], [F.count(F.lit(1)).alias("n")]).first()["v"]
    effect = models.local_sensitivity(m, test, "interval_id", {"start": middle}).select("interval_id", "effect")
    return models.linear_contributions(m, test, "interval_id").select("interval_id", F.col("start").alias("share")).join(effect, "interval_id")


@query(f"""WITH {PREDICTED}, m AS (SELECT quantile_disc(before2, 0.5) AS v FROM pr WHERE segment = 'train') SELECT interval_id, {r("coalesce(before2, v)", "filled")}, CAST(before2 IS NULL AS DOUBLE) + 0.0 AS missing, CASE WHEN before2 IS NULL THEN 'missing' WHEN delta > 0 THEN 'up' ELSE 'down' END AS way FROM pr, m WHERE segment = 'test'""")
def imputation(spark, sf):
    train, test = parts(spark, sf)
    test = test.withColumn("way", F.when(F.col("before2").isNotNull(), F.when(F.col("delta") > 0, "up").otherwise("down")))
    done = models.imputed(test, models.medians(train, ["before2"]), ["way"])
    return done.select("interval_id", F.col("before2__filled").alias("filled"), F.col("before2__missing").alias("missing"), F.col("way__filled").alias("way"))


@query(f"""WITH {PREDICTED} SELECT 'fold' AS name, max(CASE WHEN segment = 'train' THEN day END) AS last_train, min(CASE WHEN segment = 'test' THEN day END) AS first_test, true AS separate FROM pr""")
def train_test_separation(spark, sf):
    from ..operators import contracts

    train, test = parts(spark, sf)
    contracts.require_separate(train, test, "day")
    return contracts.separation(train, test, "day").select(F.lit("fold").alias("name"), "*")


# names of columns


def _rows_sql(kind: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({i} AS BIGINT) AS place, '{n}' AS name" for k, names in kind.items() for i, n in enumerate(names))


THERMAL = ["start", "before2", "change_last", "mean_last2"]
OFFERED = ["start", "before2", "rth_sum", "hbd_last", "bath_off_mean", "alf3d_last", "imm_mean", "power_sum", "ntea_sum", "effect_energy", "wrmi_mean", "mean_last2", "phase", "unrelated", "change_last"]


@query(_rows_sql({
    "A_thermal": ["start", "before2", "change_last", "mean_last2"], "B_state": ["hbd_last", "bath_off_mean", "phase"], "C_chemistry": ["alf3d_last"], "D_electric": ["imm_mean", "power_sum"], "E_anodic": ["ntea_sum", "effect_energy"], "F_control": ["rth_sum", "wrmi_mean"],
    "numbers": ["l_orderkey", "l_quantity"], "texts": ["l_returnflag"], "union": ["a", "b", "c"], "prefixed": ["h5_feed_feed_clean", "h5_feed_pentefc", "h5_feed_cdordfc", "h5_feed_scdocc"], "allowed": ["start", "rth_sum"],
    "slots": ["cell", "ord", "records", "changes", "s__mean", "s__count", "s__min", "s__max", "t__active", "t__any", "m__records"], "records_first": ["cell", "ts", "talimfc", "pal2o3fc", "imfc"], "records_count": ["58"],
}))
def column_lists(spark, sf):
    from ..operators import contracts

    line = io.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")
    numbers, texts = models.feature_columns(line, exclude=["l_linestatus"])
    needed = families.record_columns()
    try:
        contracts.require_features([*OFFERED, "end_value"], ["end_"])
        allowed = []
    except contracts.ContractError:
        allowed = contracts.require_features(["start", "rth_sum"], ["end_"])
    kinds = models.families(OFFERED, THERMAL) | {
        "numbers": numbers, "texts": texts, "union": families.unique(["a", "b"], ["b", "c", "a"]), "prefixed": list(families.prefixes({"feed": families.SIGNALS["feed"]}).values()), "allowed": allowed,
        "slots": families.slot_columns(["s"], ["t"], ["m"]), "records_first": needed[:5], "records_count": [str(len(needed))],
    }
    return spark.createDataFrame([(k, i, n) for k, names in kinds.items() for i, n in enumerate(names)], "kind string, place long, name string")


# learners without a closed form


@query()
def autoregressive_models(spark, sf):
    train, test = map(intervals.history, parts(spark, sf))
    scored = test
    for model in models.autoregressive(train, history=["change_last", "change_before", "mean_last3", "range_last3"], kind="ridge").values():
        scored = model.transform(scored)
    return metrics.by(metrics.long(scored, ["ar2", "ar3", "delta_history", "p_mean2"], "end"), "variant")


#: Rounds of boosting in registered queries; the operators' default is models.ROUNDS.
ROUNDS = 20


@query()
def residual_correction(spark, sf):
    train, test = parts(spark, sf)
    m = models.fit_residual(train, "p_mean2", "end", ["start", "before2", "before3"], maxIter=ROUNDS)
    scored = m.transform(test).withColumn("corrected", F.col("p_mean2") + F.col("correction"))
    return metrics.by(metrics.long(scored, ["p_mean2", "corrected"], "end"), "variant")


@query()
def rolling_validation(spark, sf):
    return models.rolling_validation(model_rows(spark, sf), "day", EDGES, "end", ["start", "before2"], ["ridge", "elastic"])


@query()
def family_ablation(spark, sf):
    train, test = map(intervals.history, parts(spark, sf))
    by_family = {"A_last": ["start"], "B_before": ["before2", "before3"], "C_changes": ["change_last", "change_before"], "D_means": ["mean_last2", "mean_last3"], "E_range": ["max_last3", "min_last3", "range_last3"], "F_shape": ["std_last3", "slope_last3", "earlier_readings"]}
    return models.ablation(train, test, "end", by_family)


@query()
def hot_classifier(spark, sf):
    train, test = (f.withColumn("hot", S.flag(F.col("end") >= HOT)) for f in parts(spark, sf))
    out = None
    for kind, more in (("logistic", {}), ("trees", {"maxIter": ROUNDS})):
        scored = models.fit(train, "hot", ["start", "before2", "before3"], kind=kind, out="p", classes=True, **more).transform(test)
        part = metrics.ranking(scored, "hot", "p_1").select(F.lit(kind).alias("kind"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def direction_classifier(spark, sf):
    train, test = (f.withColumn("way", S.direction("delta")) for f in parts(spark, sf))
    scored = models.fit(train, "way", ["start", "before2", "before3"], kind="forest", out="p", classes=True).transform(test)
    return metrics.class_recalls(scored.withColumn("guess", S.argmax("p_0", "p_1", "p_2")), "way", "guess")


@query()
def tree_importances(spark, sf):
    train, _ = parts(spark, sf)
    m = models.fit(train, "end", ["start", "before2", "before3"], kind="trees", maxIter=ROUNDS)
    return spark.createDataFrame(models.importances(m), "feature string, gain double")


@query()
def component_prediction(spark, sf):
    train, test = (f.withColumns({"hot": S.flag(F.col("end") >= HOT), "way": S.direction("delta")}) for f in parts(spark, sf))
    numbers = ["start", "before2", "before3"]
    correction = models.fit_residual(train, "p_mean2", "end", numbers, kind="ridge")
    hot = models.fit(train, "hot", numbers, kind="logistic", out="hot_p", classes=True)
    way = models.fit(train, "way", numbers, kind="forest", out="way_p", classes=True)
    share = train.agg(F.avg("hot")).first()[0]
    return metrics.by(metrics.long(models.predict_components(test, correction, hot, way, "p_mean2", share), ["p_mean2", "p_final"], "end"), "variant")


@query()
def local_sensitivity(spark, sf):
    train, test = parts(spark, sf)
    m = models.fit(train, "end", ["start", "before2"], kind="ridge")
    rows = all_pairs(spark, sf)
    return models.local_sensitivity(m, test, "interval_id", models.medians(rows, ["start", "before2"])).groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs("effect")).alias("mean_effect"))

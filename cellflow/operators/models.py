"""Models on features: preparation, regressors, residual correction, folds, ablation, explanation.

The learners are MLlib's. Gradient-boosted trees here take no missing values, so medians and
missing flags stand in; there is no leaf-count or L2 control, so figures are not those of other
boosting libraries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import contracts, metrics


def feature_columns(frame: DataFrame, exclude: Sequence[str] = (), prefixes: Sequence[str] = (), parts: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(number columns, text columns) of frame without the excluded; with prefixes or parts, only names that begin with or have one."""
    chosen = [(n, t) for n, t in frame.dtypes if n not in exclude and (not prefixes or n.startswith(tuple(prefixes))) and (not parts or any(p in n.lower() for p in parts))]
    numbers = [n for n, t in chosen if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    return numbers, [n for n, t in chosen if t == "string"]


def medians(frame: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Medians of the training rows (the lower of the two middle values; by a sketch with a rank error of 1e-4 beyond some 10,000 rows); 0 for a column without values.

    One pass and bounded memory for all columns; a number for each reaches the driver.
    """
    row = frame.agg(*[F.percentile_approx(F.col(c).cast("double"), F.lit(0.5), F.lit(10_000)).alias(c) for c in columns]).first() if columns else {}
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in columns}


def imputed(frame: DataFrame, values: dict[str, float], texts: Sequence[str] = (), flags: bool = True) -> DataFrame:
    """frame with missing numbers replaced, missing texts as 'missing', and a flag column for each number."""
    more = {f"{c}__missing": F.col(c).isNull().cast("double") for c in values} if flags else {}
    more |= {f"{c}__filled": F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()}
    more |= {f"{c}__filled": F.coalesce(F.col(c), F.lit("missing")) for c in texts}
    return frame.withColumns(more)


def stages(values: dict[str, float], texts: Sequence[str] = (), scale: bool = False, flags: bool = True) -> list:
    """Pipeline stages from imputed() columns to the column features; a text unseen in training becomes zeros."""
    numbers = [f"{c}__filled" for c in values] + ([f"{c}__missing" for c in values] if flags else [])
    out = []
    for c in texts:
        out += [StringIndexer(inputCol=f"{c}__filled", outputCol=f"{c}__index", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__index", outputCol=f"{c}__hot", dropLast=True)]
    out.append(VectorAssembler(inputCols=numbers + [f"{c}__hot" for c in texts], outputCol="raw" if scale else "features"))
    if scale:
        out.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return out


#: Boosted trees: rounds, step, and depth (31 leaves at most). The reference's rounds and step.
ROUNDS, STEP, DEPTH = 250, 0.05, 5

REGRESSORS: dict[str, Callable] = {
    "linear": lambda **k: LinearRegression(**k),
    "elastic": lambda **k: LinearRegression(regParam=0.05, elasticNetParam=0.2, **k),
    "ridge": lambda **k: LinearRegression(regParam=0.01, elasticNetParam=0.0, **k),
    "trees": lambda **k: GBTRegressor(**{"maxIter": ROUNDS, "maxDepth": DEPTH, "stepSize": STEP, "seed": 42, **k}),
}
CLASSIFIERS: dict[str, Callable] = {
    "logistic": lambda **k: LogisticRegression(**k),
    "trees": lambda **k: GBTClassifier(**{"maxIter": ROUNDS, "maxDepth": DEPTH, "stepSize": STEP, "seed": 42, **k}),
    "forest": lambda **k: RandomForestClassifier(**{"numTrees": 30, "maxDepth": 5, "seed": 42, **k}),
}


class Fitted:
    """A fitted pipeline with the medians that it fills in."""

    def __init__(self, spark: SparkSession, model: PipelineModel, values: dict[str, float], texts: Sequence[str], out: str):
        self.spark, self.model, self.values, self.texts, self.out = spark, model, values, list(texts), out

    def transform(self, frame: DataFrame) -> DataFrame:
        """frame with the prediction (and for classifiers p_0, p_1, ... per class, two at least) under the model's name."""
        scored = self.model.transform(imputed(frame, self.values, self.texts))
        keep = [F.col(c) for c in frame.columns]
        if "probability" in scored.columns:
            p = vector_to_array("probability")
            n = max(2, self.model.stages[-1].numClasses)  # a class that training did not have gets 0
            return scored.select(*keep, *[F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)).alias(f"{self.out}_{k}") for k in range(n)])
        return scored.select(*keep, F.col("prediction").alias(self.out))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        meta = json.dumps({"values": self.values, "texts": self.texts, "out": self.out})
        self.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> Fitted:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(spark, PipelineModel.load(f"{path}/model"), meta["values"], meta["texts"], meta["out"])


def fit(train: DataFrame, label: str, numbers: Sequence[str], texts: Sequence[str] = (), kind: str = "ridge", out: str = "predicted", weight: str | None = None, classes: bool = False, **parameters) -> Fitted:
    """A regressor (or classifier, with classes) on rows of train that have a label; medians come from train alone.

    parameters go to the learner in place of its defaults, such as maxIter for the rounds of boosted trees.
    """
    rows = train.where(F.col(label).isNotNull()).withColumn("__label", F.col(label).cast("double"))
    values = medians(rows, numbers)
    learner = (CLASSIFIERS if classes else REGRESSORS)[kind](featuresCol="features", labelCol="__label", **({"weightCol": weight} if weight else {}), **parameters)
    linear = kind in ("linear", "elastic", "ridge", "logistic")
    pipeline = Pipeline(stages=[*stages(values, texts, scale=linear), learner])
    return Fitted(train.sparkSession, pipeline.fit(imputed(rows, values, texts)), values, texts, out)


#: What a model is trained on: the target itself, or its change from a value that is known.
STRATEGIES = ("absolute", "delta")


class Target:
    """A regressor of the target or of its change; predictions are of the target in both cases."""

    def __init__(self, model: Fitted, base: str | None):
        self.model, self.base = model, base

    def transform(self, frame: DataFrame) -> DataFrame:
        out = self.model.transform(frame)
        return out.withColumn(self.model.out, F.col(self.model.out) + F.col(self.base)) if self.base else out


def fit_target(train: DataFrame, label: str, base: str, strategy: str, numbers: Sequence[str], texts: Sequence[str] = (), **more) -> Target:
    """fit() by a strategy: absolute trains on label, delta on label minus base, which is added again."""
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    if strategy == "absolute":
        return Target(fit(train, label, numbers, texts, **more), None)
    return Target(fit(train.withColumn("__delta", F.col(label) - F.col(base)), "__delta", numbers, texts, **more), base)


def autoregressive(train: DataFrame, label: str = "end", last: Sequence[str] = ("start", "before2", "before3"), history: Sequence[str] = (), kind: str = "linear") -> dict[str, Target]:
    """Baselines by name: ar2 and ar3 on the last readings, and delta_history on the columns of history."""
    fitted = {f"ar{k}": fit_target(train, label, last[0], "absolute", list(last[:k]), kind=kind, out=f"ar{k}") for k in (2, 3)}
    if history:
        fitted["delta_history"] = fit_target(train, label, last[0], "delta", list(history), kind=kind, out="delta_history")
    return fitted

def fit_residual(train: DataFrame, frozen: str, actual: str, numbers: Sequence[str], texts: Sequence[str] = (), kind: str = "trees", out: str = "correction", weight: str | None = None, **parameters) -> Fitted:
    """A model of what the frozen prediction leaves over."""
    return fit(train.withColumn("__residual", F.col(actual) - F.col(frozen)), "__residual", numbers, texts, kind, out, weight, **parameters)


def folds(frame: DataFrame, day: str, edges: Sequence[date]) -> list[tuple[DataFrame, DataFrame]]:
    """Rolling origin: for each pair of edges, all rows before the first, and the rows between the two."""
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        train, test = frame.where(F.col(day) < F.lit(a)), frame.where((F.col(day) >= F.lit(a)) & (F.col(day) < F.lit(b)))
        contracts.require_separate(train, test, day)
        out.append((train, test))
    return out


def rolling_validation(frame: DataFrame, day: str, edges: Sequence[date], label: str, numbers: Sequence[str], kinds: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """fold, variant and error metrics of each kind of regressor over rolling folds."""
    parts = []
    for i, (train, test) in enumerate(folds(frame, day, edges)):
        for kind in kinds:
            scored = fit(train, label, numbers, texts, kind, kind).transform(test)
            parts.append(metrics.by(metrics.long(scored, [kind], label), "variant").withColumn("fold", F.lit(i)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Families of features in the order in which they are added, by parts of their names. Fixed values.
FAMILIES = {
    "B_state": ("hbd", "hbc", "hmd", "hmc", "hb_", "hm_", "bath_off", "metal_off", "bath_low", "low_share", "agebsq", "phase"),
    "C_chemistry": ("alf3", "ndalf3", "ndal2o3", "amna2co3", "soda"),
    "D_electric": ("imm", "v_acd", "power"),
    "E_anodic": ("ntea", "dtea", "sea", "effect"),
    "F_control": ("wrmi", "smrwfc", "rth", "rc_", "rrm", "rkm", "mbl", "tbd", "tbc", "resistance_gap"),
}


def families(columns: Sequence[str], thermal: Sequence[str], parts: dict[str, Sequence[str]] = FAMILIES) -> dict[str, list[str]]:
    """Columns by family: A_thermal first, then those of columns that have one of a family's parts and are in no family before."""
    out = {"A_thermal": [c for c in thermal if c in columns]}
    for name, wanted in parts.items():
        used = [c for family in out.values() for c in family]
        out[name] = [c for c in columns if c not in used and any(p in c for p in wanted)]
    return out


def ablation(train: DataFrame, test: DataFrame, label: str, families: dict[str, Sequence[str]], kind: str = "ridge") -> DataFrame:
    """Error metrics on test as families of features are added one after the other: variant is the family added last."""
    used: list[str] = []
    parts = []
    for name, columns in families.items():
        used += [c for c in columns if c not in used]
        scored = fit(train, label, used, (), kind, name).transform(test)
        parts.append(metrics.by(metrics.long(scored, [name], label), "variant").withColumn("features", F.lit(len(used))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def local_sensitivity(model: Fitted, frame: DataFrame, key: str, references: dict[str, float]) -> DataFrame:
    """key, feature and effect: how the prediction changes from that with the feature at its reference value. One pass over rows times features."""
    base = model.transform(frame)
    variants = base.withColumn("__feature", F.explode(F.array(*map(F.lit, references))))
    changed = {c: F.when(F.col("__feature") == c, F.lit(v)).otherwise(F.col(c).cast("double")) for c, v in references.items()}
    again = Fitted(model.spark, model.model, model.values, model.texts, "__again").transform(variants.withColumns(changed))
    return again.select(key, F.col("__feature").alias("feature"), (F.col(model.out) - F.col("__again")).alias("effect"))


def linear_contributions(model: Fitted, frame: DataFrame, key: str) -> DataFrame:
    """key and each feature's share in a linear model's prediction: its coefficient times its distance from the training mean."""
    last, scaler = model.model.stages[-1], model.model.stages[-2]
    names = list(model.values)
    std = scaler.std.toArray()
    shares = {c: (F.col(f"{c}__filled") - float(scaler.mean[i])) * float(last.coefficients[i]) / float(std[i] or 1) for i, c in enumerate(names)}
    filled = imputed(frame, model.values, model.texts)
    return filled.select(key, *[e.alias(c) for c, e in shares.items()])


def importances(model: Fitted) -> list[tuple[str, float]]:
    """Features of a tree model by gain."""
    names = [*model.values, *[f"{c}__missing" for c in model.values]]
    gains = model.model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, gains), strict=False), key=lambda x: (-x[1], x[0]))


def predict_components(frame: DataFrame, correction: Fitted, hot: Fitted, way: Fitted, frozen: str, prevalence: float, weighted: Fitted | None = None, **parameters) -> DataFrame:
    """frame with p_final: the frozen prediction put together with its correction, the chance of a hot target and those of cooling and heating."""
    out = way.transform(hot.transform(correction.transform(frame)))
    if weighted is not None:
        out = weighted.transform(out)
    p = S.blended(frozen, correction.out, weighted.out if weighted else correction.out, f"{hot.out}_1", F.lit(prevalence), f"{way.out}_0", f"{way.out}_2", **parameters)
    return out.withColumn("p_final", p)

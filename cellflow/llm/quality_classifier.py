"""Ordinal quality classifier: cumulative-link (proportional odds) regression on hashed text.

One weight per hashed feature is shared by all grades; ordered thresholds cut the score into
grades: P(grade >= k) = sigmoid(score - threshold[k]). The expected grade and the tail
probability of the lowest good grade are what documents are selected by.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashtext
from .bytewords import slices
from .common import released, ship

ship(__name__)

#: Labelled rows per grade that the model is fitted on, at most: the sample's bound.
SAMPLE = 1500
#: Passes over the sample, step size, and the L1 penalty that leaves most weights zero.
ROUNDS, RATE, PENALTY = 80, 2.0, 2e-5
#: Features get a weight if so many sampled documents have them and their share of documents
#: differs by so many standard errors across a threshold.
LEAST, TELLING = 5, 3.5
#: A document is rejected if the probability of at least GOOD is below ACCEPT.
GOOD, ACCEPT = 1, 0.35


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray  # one less than grades, rising


def fit(rows: hashtext.Sparse, grades: np.ndarray, n_grades: int) -> Model:
    """Maximum likelihood with an L1 penalty by proximal AdaGrad over the whole sample; every grade has the same weight.

    Features are scaled by the root of a document's number of them. Without rows of two grades all probabilities are 1.
    """
    n = len(grades)
    cuts = np.arange(n_grades - 1) - (n_grades - 2) / 2.0
    seen = np.bincount(grades, minlength=n_grades)
    if (seen > 0).sum() < 2:
        return Model(np.zeros(hashtext.DIMENSIONS), np.full(n_grades - 1, -1e3))
    share = 1.0 / (seen[grades] * (seen > 0).sum())
    scale = 1 / np.sqrt(np.maximum(hashtext.sizes(rows), 1))
    mask = np.zeros(hashtext.DIMENSIONS, bool)
    for k in range(1, n_grades):
        mask |= hashtext.telling_places(rows, grades >= k, min(LEAST, max(1, n // 20)), TELLING)
    rows = hashtext.only(rows, mask)
    size = int(mask.sum())
    weights, square, cut_square = np.zeros(size), np.full(size, 1e-8), np.full(n_grades - 1, 1e-8)
    one = np.arange(n)
    for _ in range(ROUNDS):
        score = hashtext.scores(rows, weights) * scale
        # P(grade >= k) for k = 0 .. n_grades, 1 and 0 at the ends
        above = np.concatenate([np.ones((n, 1)), hashtext.sigmoid(score[:, None] - cuts), np.zeros((n, 1))], axis=1)
        steep = above * (1 - above)
        p = np.maximum(above[one, grades] - above[one, grades + 1], 1e-9)
        slope = -(steep[one, grades] - steep[one, grades + 1]) / p * share
        g = hashtext.gradient(rows, slope * scale, size)
        cut_g = np.zeros(n_grades + 1)
        np.add.at(cut_g, grades, steep[one, grades] / p * share)
        np.add.at(cut_g, grades + 1, -steep[one, grades + 1] / p * share)
        square += g * g
        cut_square += cut_g[1:-1] ** 2
        rate = RATE / np.sqrt(square)
        weights = weights - rate * g
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * PENALTY * (square > 1e-8), 0)
        cuts = np.maximum.accumulate(cuts - RATE / np.sqrt(cut_square) * cut_g[1:-1])
    return Model(hashtext.widened(weights, mask), cuts)


def predict(model: Model, rows: hashtext.Sparse) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade of each row, and P(grade >= k) for k from 1."""
    score = hashtext.scores(rows, model.weights) / np.sqrt(np.maximum(hashtext.sizes(rows), 1))
    above = hashtext.sigmoid(score[:, None] - model.thresholds)
    return above.sum(axis=1), above


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of rated documents: 0 bad (quality 0), 1 good but toxic, 2 good; rows without a quality are left out."""
    grade = F.when(F.col("quality") == 0, 0.0).when(F.col("toxic") == 1, 1.0).otherwise(2.0)
    return labels.where("quality is not null").select("doc_id", grade.alias("grade"))


def train(docs: DataFrame, labels: DataFrame, n_grades: int = 3) -> Model:
    """A model from labels (doc_id, grade 0 .. n_grades - 1), on at most SAMPLE rows of each grade.

    Labels without a document, with a null grade or id are left out; an id with several labels or texts counts once (see labelled_sample()).
    """
    sample = hashtext.labelled_sample(docs, labels, F.col("grade"), SAMPLE)
    got = hashtext.collect_features(sample, ["grade"], lower=False)
    model = fit(got.rows, got.columns["grade"].astype(np.int64), n_grades)
    del got
    released()
    return model


def _predictor(model: Model):
    shared = (np.flatnonzero(model.weights), model.weights[model.weights != 0], model.thresholds)

    def run(batches):
        weights = np.zeros(hashtext.DIMENSIONS)
        weights[shared[0]] = shared[1]
        own = Model(weights, shared[2])
        for batch in batches:
            whole = batch.column("row")
            for row, rows in slices(whole.field(whole.type.get_field_index("text"))):
                expected, above = predict(own, hashtext.features(rows, lower=False))
                yield pa.RecordBatch.from_arrays([whole.slice(row, len(rows)), pa.array(expected), pa.array(above[:, GOOD - 1])], ["row", "expected", "tail"])

    return run


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: row (a struct of all its columns), expected (expected grade), tail (P(grade >= GOOD)).

    A null text counts as empty; what an empty text gets comes from the features of its length.
    """
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("expected", T.DoubleType()), T.StructField("tail", T.DoubleType())])
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).mapInArrow(_predictor(model), schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns."""
    return classify(docs, model).where(F.col("tail") >= ACCEPT).select("row.*")

"""Toxicity by a classifier chain: categories in sequence, each model sees the earlier probabilities.

The categories are those that are rated: toxic in a bad document, toxic in a good one, and toxic.
The models are sparse logistic regressions over hashed text. A later model is trained with the
earlier categories' out-of-fold predictions, so that it meets in training what it will meet in
use: probabilities of documents that the earlier models have not seen.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashtext
from .bytewords import slices
from .common import released, ship, text_of

ship(__name__)

#: Categories as rated: toxic in a bad document, toxic in a good one, toxic at all.
CHAIN = ("bad_toxic", "good_toxic", "toxic")
#: Labelled rows of each of toxic and other that the chain is fitted on, at most: the sample's bound.
SAMPLE = 2000
FOLDS, ROUNDS, RATE, PENALTY = 3, 80, 0.5, 1e-4
#: Features get a weight if so many sampled documents have them and their share of documents
#: differs by so many standard errors between the classes.
LEAST, TELLING = 4, 3.5
#: A document is toxic from this probability on.
TOXIC = 0.5


class Link(NamedTuple):
    weights: np.ndarray
    earlier: np.ndarray  # one per earlier category
    bias: float


def fit_link(rows: hashtext.Sparse, earlier: np.ndarray, y: np.ndarray) -> Link:
    """Logistic regression with an L1 penalty by proximal AdaGrad; both classes weigh the same.

    Features can only speak for a category, so that much other text does not outweigh a few words of it.

    earlier: log odds of earlier categories, a column each. With one class only, its probability is near certain.
    """
    n, k = len(y), earlier.shape[1]
    if n == 0 or y.min() == y.max():
        return Link(np.zeros(hashtext.DIMENSIONS), np.zeros(k), 10.0 if n and y[0] else -10.0)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    mask = hashtext.telling_places(rows, y > 0, min(LEAST, max(1, n // 20)), TELLING, upward=True)
    rows, size = hashtext.only(rows, mask), int(mask.sum())
    weights, own, bias = np.zeros(size), np.zeros(k), 0.0
    square, own_square, bias_square = np.full(size, 1e-8), np.full(k, 1e-8), 1e-8
    for _ in range(ROUNDS):
        p = hashtext.sigmoid(hashtext.scores(rows, weights) + earlier @ own + bias)
        slope = (p - y) * share
        g, own_g, bias_g = hashtext.gradient(rows, slope, size), earlier.T @ slope, slope.sum()
        square, own_square, bias_square = square + g * g, own_square + own_g**2, bias_square + bias_g**2
        rate = RATE / np.sqrt(square)
        weights = weights - rate * g
        weights = np.maximum(weights - rate * PENALTY, 0)
        own = own - RATE / np.sqrt(own_square) * own_g
        bias = bias - RATE / np.sqrt(bias_square) * bias_g
    return Link(hashtext.widened(weights, mask), own, float(bias))


def odds(link: Link, rows: hashtext.Sparse, earlier: np.ndarray) -> np.ndarray:
    """Log odds, within -10 .. 10."""
    return np.clip(hashtext.scores(rows, link.weights) + earlier @ link.earlier + link.bias, -10, 10)


def fit_chain(rows: hashtext.Sparse, y: dict[str, np.ndarray], folds: int = FOLDS) -> list[Link]:
    """A link per category of y, in order; rows are dealt to folds by number.

    A row whose category is not known (NaN) trains no model of it, and gets a prediction as all others do.
    """
    n = len(rows.start) - 1
    fold, earlier, chain = np.arange(n) % folds, np.zeros((n, 0)), []
    for target in y.values():
        held, rated = np.zeros(n), ~np.isnan(target)

        def fitted(which: np.ndarray, earlier=earlier, target=target) -> Link:
            return fit_link(hashtext.pick(rows, which), earlier[which], target[which])

        for k in range(folds):
            test = np.flatnonzero(fold == k)
            held[test] = odds(fitted(np.flatnonzero((fold != k) & rated)), hashtext.pick(rows, test), earlier[test])
        chain.append(fitted(np.flatnonzero(rated)))
        earlier = np.column_stack([earlier, held])
    return chain


def run_chain(chain: list[Link], rows: hashtext.Sparse) -> np.ndarray:
    """Probabilities, a column per category."""
    earlier = np.zeros((len(rows.start) - 1, 0))
    for link in chain:
        earlier = np.column_stack([earlier, odds(link, rows, earlier)])
    return hashtext.sigmoid(earlier)


def categories(toxic: np.ndarray, quality: np.ndarray) -> dict[str, np.ndarray]:
    """The chain's targets. Where a row is toxic and its quality is not known, neither is the kind of document."""
    kind = np.where(toxic > 0, quality, 0.0)
    return dict(zip(CHAIN, (np.where(toxic > 0, 1 - kind, 0.0), np.where(toxic > 0, kind, 0.0), toxic), strict=True))


def train(docs: DataFrame, labels: DataFrame) -> list[Link]:
    """A chain from labels (doc_id, quality 0 or 1, toxic 0 or 1), on at most SAMPLE rows of each of toxic and other.

    Rows with a null id or a null toxic are left out; an id with several labels or texts counts once (see labelled_sample()).
    """
    sample = hashtext.labelled_sample(docs, labels.select("doc_id", "toxic", "quality"), F.col("toxic"), SAMPLE)
    got = hashtext.collect_features(sample, ["toxic", "quality"])
    chain = fit_chain(got.rows, categories(got.columns["toxic"], got.columns["quality"]))
    del got
    released()
    return chain


def classify(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """One row per row of docs: doc_id, p_bad_toxic, p_good_toxic, p_toxic, toxic. A null text counts as empty; other columns are ignored."""
    packed = [(np.flatnonzero(c.weights), c.weights[c.weights != 0], c.earlier, c.bias) for c in chain]

    def run(batches):
        own = []
        for places, values, earlier, bias in packed:
            weights = np.zeros(hashtext.DIMENSIONS)
            weights[places] = values
            own.append(Link(weights, earlier, bias))
        for batch in batches:
            for row, rows in slices(batch.column("text")):
                p = run_chain(own, hashtext.features(rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(rows)), *map(pa.array, p.T.copy())], ["doc_id", *[f"p_{c}" for c in CHAIN]])

    out = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN))
    return out.withColumn("toxic", F.col("p_toxic") >= TOXIC)

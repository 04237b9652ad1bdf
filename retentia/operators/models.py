"""Classifiers: one registry to fit them, one long frame of scores.

Naive Bayes is a Spark ML estimator; the others are this package's. The settings follow the usual single-machine defaults
(logistic penalty C = 1, trees grown until their leaves are pure, 100 forest trees that look at the
square root of the features per node, 100 boosting rounds of depth 3 and rate 0.1, 5 neighbours).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import above
from retentia.operators.logistic import fit_logistic
from retentia.operators.metrics import model_report
from retentia.operators.neighbors import knn_score
from retentia.operators.selection import features_and_label
from retentia.operators.trees import MAX_BINS, TreeModel, fit_boosted, fit_trees, score_sent
from retentia.sources.tables import materialize

MODEL_NAMES = (
    "knn",
    "log_reg",
    "decision_tree",
    "random_forest",
    "naive_bayes",
    "boosted_trees",
)


@dataclass(frozen=True)
class Neighbours:
    """A neighbour model is its training rows."""

    train: DataFrame
    label: str
    key: str
    k: int


@dataclass(frozen=True)
class Linear:
    """Weights per feature and an intercept."""

    cols: list[str]
    weights: list[float]
    intercept: float

    def score(self, df: DataFrame, name: str) -> DataFrame:
        margin = F.lit(self.intercept)
        for c, w in zip(self.cols, self.weights, strict=True):
            margin = margin + F.col(c).cast("double") * F.lit(w)
        return df.withColumn(name, 1 / (1 + F.exp(-margin)))


Fitted = Model | Neighbours | Linear | TreeModel


def fit_models(
    train: DataFrame,
    cols: Sequence[str],
    label: str,
    key: str,
    names: Sequence[str] = MODEL_NAMES,
    seed: int = 19,
    k: int = 5,
    depth: int | None = None,
    trees: int = 100,
    rounds: int = 100,
    max_bins: int = MAX_BINS,
) -> dict[str, Fitted]:
    """Fits every named model on the same, once written, training rows; a fit that does not converge is an error.

    ``depth`` cuts the tree and the forest; boosted trees have depth 3.
    """
    cols = list(cols)
    rows = materialize(train.select(key, *cols, label), "train")
    fitted: dict[str, Fitted] = {}
    for name in names:
        if name == "knn":
            fitted[name] = Neighbours(rows, label, key, k)
        elif name == "decision_tree":
            fitted[name] = fit_trees(rows, cols, label, key, depth=depth, seed=seed, max_bins=max_bins)
        elif name == "random_forest":
            share = max(1, math.isqrt(len(cols)))
            fitted[name] = fit_trees(rows, cols, label, key, trees, True, share, depth, seed, max_bins=max_bins)
        elif name == "boosted_trees":
            fitted[name] = fit_boosted(rows, cols, label, key, rounds, max_bins=max_bins)
        elif name == "log_reg":
            fit = fit_logistic(rows, cols, label)
            fitted[name] = Linear(cols, [float(w) for w in fit.weights], fit.intercept)
        elif name == "naive_bayes":
            fitted[name] = NaiveBayes(modelType="gaussian").fit(features_and_label(rows, cols, label))
        else:
            raise ValueError(f"no such model: {name}")
    return fitted


def score(
    models: Mapping[str, Fitted],
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    key: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Long frame ``(keep..., model, key, label, p, pred)`` with a row per model and row of
    ``df``; all models but the neighbour vote and trees too large to send score in one pass."""
    base = df.select(*keep, key, *cols, F.col(label).alias("label"))
    out = VectorAssembler(inputCols=list(cols), outputCol="features").transform(base)
    for name, model in models.items():
        if not isinstance(model, Model):
            continue
        raw = model.copy().setPredictionCol(f"_hat_{name}").setProbabilityCol(f"_prob_{name}")
        raw = raw.setRawPredictionCol(f"_raw_{name}")
        out = raw.transform(out).withColumn(f"p_{name}", vector_to_array(f"_prob_{name}")[1])
        out = out.drop(f"_hat_{name}", f"_prob_{name}", f"_raw_{name}")
    out = out.drop("features")
    sent = {name: m for name, m in models.items() if isinstance(m, TreeModel) and m.subtrees is None}
    if sent:
        # One Python worker a task and not one for each model.
        out = score_sent({f"p_{name}": m for name, m in sent.items()}, out)
    for name, model in models.items():
        if name in sent:
            continue
        if isinstance(model, Linear | TreeModel):
            out = model.score(out, f"p_{name}")
        elif isinstance(model, Neighbours):
            out = knn_score(model.train, out, cols, model.label, model.key, model.k)
            out = out.withColumnRenamed("p", f"p_{name}")
    cells = [F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("p")) for m in models]
    long = out.select(*keep, key, "label", F.explode(F.array(*cells)).alias("_s"))
    return long.select(
        *keep, "_s.model", key, "label", "_s.p", above("_s.p", 0.5).alias("pred")
    )


def coefficients(model: Linear) -> list[tuple[str, float]]:
    """Feature and weight of a fitted logistic regression."""
    return list(zip(model.cols, model.weights, strict=True))


def score_splits(
    models: Mapping[str, Fitted],
    splits: Mapping[str, DataFrame],
    cols: Sequence[str],
    label: str,
    key: str,
) -> DataFrame:
    """``(split, model, key, label, p, pred)``: the named frames, scored by every model."""
    tagged = None
    for split, df in splits.items():
        part = df.select(key, *cols, label).withColumn("split", F.lit(split))
        tagged = part if tagged is None else tagged.unionByName(part)
    return score(models, tagged, cols, label, key, keep=["split"])


def compare_models(
    models: Mapping[str, Fitted],
    splits: Mapping[str, DataFrame],
    cols: Sequence[str],
    label: str,
    key: str,
) -> DataFrame:
    """``(model, split, metric, value)`` for every model on every named frame."""
    scored = score_splits(models, splits, cols, label, key)
    return model_report(scored, by=["model", "split"]).select("model", "split", "metric", "value")

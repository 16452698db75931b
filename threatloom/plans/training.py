"""Model training and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.fixed_values import EVALUATION_THRESHOLD
from threatloom.functions.scoring import verdict_name
from threatloom.operators import evaluation
from threatloom.operators.models import (
    MAX_DEPTH,
    fit_malware_model,
    fit_traffic_model,
    score_malware,
    score_traffic,
)
from threatloom.operators.joins import training_rows
from threatloom.operators.neighbours import balance_classes
from threatloom.operators.split import stratified_split


@dataclass
class Trained:
    """A model, its columns, and the rows held back for testing."""

    model: PipelineModel
    columns: list[str]
    test: DataFrame


def train_traffic(
    df: DataFrame,
    key: str,
    columns: list[str],
    label: str = "attack_type",
    trees: int = 100,
    depth: int = MAX_DEPTH,
) -> Trained:
    """Stratified 80/20 split, then the forest on all rows of the larger part."""
    split = stratified_split(df, label, key)
    train = split.where(~F.col("is_test")).drop("is_test")
    model = fit_traffic_model(train, columns, label, trees, depth)
    return Trained(model, columns, split.where("is_test").drop("is_test"))


def evaluate_traffic(trained: Trained, label: str = "attack_type") -> DataFrame:
    """(truth, prediction) counts of the test rows."""
    scored = score_traffic(trained.test, trained.model)
    return evaluation.pair_counts(scored, label, "predicted_attack")


def columns_from_vector(df: DataFrame, vector: str, names: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(vector)[i].cast("double").alias(n) for i, n in enumerate(names)])


def train_malware(
    df: DataFrame,
    key: str,
    columns: list[str],
    label: str = "malware",
    trees: int = 200,
    depth: int = 20,
    iterations: int = 100,
) -> Trained:
    """Split, oversample all rows of the training part on unscaled values, then scale, reduce and fit both scorers."""
    # The features may come from a long way off, and the search for neighbours and the fits
    # below read them many times.
    rows = training_rows(
        df.select(
            key, label, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("features")
        )
    )
    split = stratified_split(rows, label, key)
    train = split.where(~F.col("is_test")).drop("is_test")
    balanced = balance_classes(train, key, "features", label).checkpoint()
    wide = columns_from_vector(balanced, "features", columns, label)
    model = fit_malware_model(wide, columns, label, trees, depth, iterations)
    test = columns_from_vector(split.where("is_test"), "features", columns, key, label)
    return Trained(model, columns, test)


def evaluate_malware(
    model: PipelineModel, labelled: DataFrame, label: str = "malware", threshold: float = EVALUATION_THRESHOLD
) -> DataFrame:
    """Actual label, and verdict and probability of each scorer, per row."""
    scored = score_malware(labelled, model, threshold)
    return scored.withColumns(
        {
            "actual": verdict_name(F.col(label) == 1),
            "rf_verdict": F.col("prediction.random_forest.prediction"),
            "net_verdict": F.col("prediction.lstm.prediction"),
            "rf_score": F.col("prediction.random_forest.probability"),
            "net_score": F.col("prediction.lstm.probability"),
        }
    ).drop("prediction")


def malware_metrics(evaluated: DataFrame, scorer: str) -> DataFrame:
    """Per-class report of one scorer (``rf`` or ``net``)."""
    pairs = evaluation.pair_counts(evaluated, "actual", f"{scorer}_verdict")
    return evaluation.classification_report(pairs)

"""Feature vectors, PCA to a variance target, classifiers and their scores on pyspark.ml."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassificationModel
from pyspark.ml.feature import PCA, IndexToString, PCAModel, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.fixed_values import PCA_VARIANCE_TARGET, SERVING_THRESHOLD
from threatloom.functions.scoring import prediction_struct
from threatloom.operators.encode import scaler_stage, scaling_parameters
from threatloom.operators.grown_forest import GrownForest, GrownForestClassifier
from threatloom.operators.joins import training_rows
from threatloom.operators.quality import quoted

SEED = 42
# The depth of Spark's deepest tree. The traffic forest is to grow without a limit.
MAX_DEPTH = 30


def components_for(explained: list[float] | np.ndarray, target: float) -> int:
    """Smallest number of leading components whose variance share is above the target."""
    total = np.cumsum(np.asarray(explained, dtype=float))
    return min(int((total <= target).sum()) + 1, len(total))


def fit_scaled_vectors(
    df: DataFrame, columns: list[str], output: str = "scaled", parameters: dict[str, tuple[float, float]] | None = None
) -> list[Transformer]:
    """Stages from plain columns to one vector of scaled values; means and deviations may be known already."""
    names = [f"__scaled_{i}" for i in range(len(columns))]  # an assembler takes no names with dots
    scaler = scaler_stage(parameters or scaling_parameters(df, columns), names)
    assembler = VectorAssembler(inputCols=names, outputCol=output, handleInvalid="error")
    return [scaler, assembler]


def fit_pca(
    df: DataFrame, size: int, target: float = PCA_VARIANCE_TARGET, inputs: str = "scaled", output: str = "pca"
) -> tuple[list[Transformer], PCAModel, int]:
    """One fit with all components; a slicer keeps those the variance target needs."""
    model = PCA(k=size, inputCol=inputs, outputCol=f"{output}_all").fit(df)
    keep = components_for(model.explainedVariance.toArray(), target)
    slicer = VectorSlicer(inputCol=f"{output}_all", outputCol=output, indices=list(range(keep)))
    return [model, slicer], model, keep


def apply_stages(df: DataFrame, stages: list[Transformer]) -> DataFrame:
    return PipelineModel(stages).transform(df)


def vector_columns(df: DataFrame, vector: str, names: list[str], *keep: str | Column) -> DataFrame:
    """A vector's entries as columns."""
    values = vector_to_array(F.col(vector))
    return df.withColumn("__values", values).select(
        *[F.col("__values")[i].alias(n) for i, n in enumerate(names)], *keep
    )


def traffic_forest(features: str, label: str, trees: int = 100, depth: int = MAX_DEPTH) -> GrownForestClassifier:
    return GrownForestClassifier(features, label, trees, depth, SEED)


def malware_forest(features: str, label: str, trees: int = 200, depth: int = 20) -> GrownForestClassifier:
    return GrownForestClassifier(features, label, trees, depth, SEED, prefix="rf_", least_classes=2)


def malware_network(features: str, label: str, size: int, iterations: int = 100) -> MultilayerPerceptronClassifier:
    """Second scorer: hidden layers of 64 and 32 units."""
    return MultilayerPerceptronClassifier(
        featuresCol=features,
        labelCol=label,
        layers=[size, 64, 32, 2],
        maxIter=iterations,
        blockSize=64,
        seed=SEED,
        predictionCol="net_prediction",
        probabilityCol="net_probability",
        rawPredictionCol="net_raw",
    )


def fit_traffic_model(
    train: DataFrame, columns: list[str], label: str, trees: int = 100, depth: int = MAX_DEPTH
) -> PipelineModel:
    """Class codes, scaling, forest and decoding as one model that can be saved."""
    indexer = StringIndexer(
        inputCol=label, outputCol="class_code", stringOrderType="alphabetAsc", handleInvalid="error"
    ).fit(train)
    stages = fit_scaled_vectors(train, columns)
    prepared = training_rows(
        apply_stages(indexer.transform(train), stages).select("scaled", "class_code")
    )
    forest = traffic_forest("scaled", "class_code", trees, depth).fit(prepared)
    decoder = IndexToString(
        inputCol="prediction", outputCol="predicted_attack", labels=indexer.labels
    )
    return PipelineModel([*stages, forest, decoder])


def forest_of(model: PipelineModel) -> GrownForest | RandomForestClassificationModel:
    """The fitted forest; models saved earlier have Spark's."""
    return next(s for s in model.stages if isinstance(s, (GrownForest, RandomForestClassificationModel)))


def classes_of(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()


def score_traffic(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Input columns plus ``predicted_attack`` and ``confidence``, the predicted class's probability."""
    scored = model.transform(df)
    at = F.col("prediction").cast("int") + 1
    return scored.withColumn(
        "confidence", F.element_at(vector_to_array("probability"), at)
    ).select(*map(quoted, df.columns), "predicted_attack", "confidence")


def rank_traffic(df: DataFrame, model: PipelineModel, top: int = 3) -> DataFrame:
    """Adds the ranked class probabilities: the ``top`` ones and all of them."""
    labels = F.array(*[F.lit(c) for c in classes_of(model)])
    pairs = F.arrays_zip(
        labels.alias("class"), vector_to_array("probability").alias("probability")
    )
    named = F.transform(
        pairs, lambda p: F.struct(p["class"].alias("class"), p["probability"].alias("probability"))
    )
    # The sort is stable: classes of equal probability stay in alphabetical order.
    ranked = F.array_sort(
        named,
        lambda a, b: F.when(a["probability"] > b["probability"], -1)
        .when(a["probability"] < b["probability"], 1)
        .when(a["class"] < b["class"], -1)
        .when(a["class"] > b["class"], 1)
        .otherwise(0),
    )
    scored = model.transform(df)
    at = F.col("prediction").cast("int") + 1
    return (
        scored.withColumn("confidence", F.element_at(vector_to_array("probability"), at))
        .withColumn("all_probabilities", ranked)
        .withColumn("top_predictions", F.slice("all_probabilities", 1, top))
        .select(*map(quoted, df.columns), "predicted_attack", "confidence", "top_predictions", "all_probabilities")
    )


def case_summary(ranked: DataFrame, name: str, *keep: str) -> DataFrame:
    """One row per ranked case: prediction, confidence and the likeliest class."""
    first = F.col("all_probabilities")[0]
    return ranked.select(
        name,
        *keep,
        "predicted_attack",
        "confidence",
        first["class"].alias("top_class"),
        first["probability"].alias("top_probability"),
    )


def run_cases(groups: dict[str, DataFrame], model: PipelineModel, name: str = "name") -> DataFrame:
    """Prediction, confidence and the likeliest class of every case of all groups, with its ``group``.

    A group lacks what its cases need not say: a feature that no case of a group names is 0.
    """
    parts = [cases.withColumn("group", F.lit(group)) for group, cases in groups.items()]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    filled = together.na.fill(0)
    ranked = rank_traffic(filled, model)
    return case_summary(ranked, name, "group")


def feature_importances(model: PipelineModel, columns: list[str]) -> DataFrame:
    """One row per feature, most important first."""
    values = forest_of(model).featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    return (
        SparkSession.getActiveSession()
        .createDataFrame(rows, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
    )


def fit_malware_model(
    train: DataFrame,
    columns: list[str],
    label: str,
    trees: int = 200,
    depth: int = 20,
    iterations: int = 100,
    target: float = PCA_VARIANCE_TARGET,
) -> PipelineModel:
    """Scaling, PCA and both scorers as one model for fitting and serving."""
    scaling = fit_scaled_vectors(train, columns)
    scaled = apply_stages(train, scaling).select("scaled", label)
    reduction, _, size = fit_pca(scaled, len(columns), target)
    reduced = training_rows(apply_stages(scaled, reduction).select("pca", label))
    forest = malware_forest("pca", label, trees, depth).fit(reduced)
    network = malware_network("pca", label, size, iterations).fit(reduced)
    return PipelineModel([*scaling, *reduction, forest, network])


def score_malware(df: DataFrame, model: PipelineModel, threshold: float = SERVING_THRESHOLD) -> DataFrame:
    """Input columns plus the nested ``prediction``."""
    scored = model.transform(df)
    rf = vector_to_array("rf_probability")[1]
    net = vector_to_array("net_probability")[1]
    return scored.withColumn("prediction", prediction_struct(rf, net, threshold)).select(
        *map(quoted, df.columns), "prediction"
    )


def pca_projection(df: DataFrame, stages: list[Transformer], size: int, *keep: str) -> DataFrame:
    """``pca_1`` to ``pca_k`` from fitted scaling and PCA stages."""
    return vector_columns(
        apply_stages(df, stages), "pca", [f"pca_{i + 1}" for i in range(size)], *keep
    )

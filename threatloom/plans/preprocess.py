"""Dataset preparation: clean, encode, scale, reduce, and summarise."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import schemas
from threatloom.fixed_values import PCA_VARIANCE_TARGET, PLACEHOLDERS
from threatloom.functions.labels import map_labels
from threatloom.operators import quality
from threatloom.operators.encode import (
    CategoryEncoder, Moments, encode_categoricals, scaled_columns, scaler_stage,
)
from threatloom.operators.models import apply_stages, fit_pca, fit_scaled_vectors, vector_columns
from threatloom.operators.profile import cleaning_counts, drop_rare_classes
from threatloom.session import shared_folder


@dataclass
class Prepared:
    """Prepared rows and their summary."""

    data: DataFrame
    summary: dict[str, Any]
    stages: list = field(default_factory=list)
    features: list[str] = field(default_factory=list)

    def summary_frame(self) -> DataFrame:
        return summary_frame(self.data.sparkSession, self.summary)


def summary_frame(spark: SparkSession, summary: dict[str, Any]) -> DataFrame:
    names = [f.split(" ")[0] for f in schemas.DATASET_SUMMARY.split(", ")]
    return spark.createDataFrame([tuple(summary.get(n) for n in names)], schemas.DATASET_SUMMARY)


def feature_rows(raw: DataFrame, last_is_label: bool = False) -> tuple[DataFrame, str]:
    """Trimmed headers, non-features out. Returns rows and label."""
    df = quality.trim_headers(raw)
    label = quality.find_label_column(df.columns, last_is_label)
    return quality.drop_non_features(df, label), label


def clean_network(
    raw: DataFrame, placeholders: list[str] = PLACEHOLDERS, last_is_label: bool = False
) -> tuple[DataFrame, str, DataFrame]:
    """Trimmed headers, non-features out, then invalid rows out. Returns rows, label, counts."""
    kept, label = feature_rows(raw, last_is_label)
    return quality.drop_invalid_rows(kept, placeholders), label, cleaning_counts(kept)


def encode_network(clean: DataFrame, label: str) -> DataFrame:
    """Binary label ``y`` from the label text, and category codes for the text features."""
    labelled = clean.withColumn("y", map_labels(clean, label)).drop(quality.quoted(label))
    return encode_categoricals(labelled, quality.non_numeric_columns(labelled, "y"))


def preprocess_network(
    raw: DataFrame,
    dataset_name: str,
    last_is_label: bool = False,
    stages: list | None = None,
    training_columns: list[str] | None = None,
) -> Prepared:
    """Scaled features and ``y`` of an intrusion dataset, and the stages that made them.

    Raw rows are read once for counts, means and deviations, and once for the categories of text
    columns, from whose counts the scaling of their codes follows.

    With the stages and columns of an earlier run new rows are prepared alike: its category codes
    (a category it has not seen gets the next one) and its means and deviations.
    """
    kept, label = feature_rows(raw, last_is_label)
    texts = quality.non_numeric_columns(kept, label)
    moments = Moments.of(
        kept, [c for c in kept.columns if c != label and c not in texts], ~quality.invalid_row(kept, PLACEHOLDERS)
    )
    clean = quality.drop_invalid_rows(kept, PLACEHOLDERS)
    labelled = clean.withColumn("y", map_labels(clean, label)).drop(quality.quoted(label))
    if stages is None:
        encoder = CategoryEncoder(texts).fit(labelled)
        encoded = encoder.transform(labelled)
        features = [c for c in encoded.columns if c != "y"]
        known = {**moments.scaling(), **encoder.scaling_parameters()}
        stages = [encoder, scaler_stage({c: known[c] for c in features})]
    else:
        if training_columns is None:
            raise ValueError("stages need the columns of their run")
        features = training_columns
        texts = set(stages[0].getOrDefault("columns"))
        known = [c for c in features if c in labelled.columns]
        given = labelled.select(
            *[quality.quoted(c) if c in known else F.lit("" if c in texts else 0).alias(c) for c in features], "y"
        )
        encoded = stages[0].transform(given)
    summary = {
        "dataset_name": dataset_name,
        "rows_before": moments.all_rows,
        "rows_after": moments.rows,
        "invalid_records_removed": moments.all_rows - moments.rows,
        "features_used": len(features),
        "preprocessing_status": "Completed",
        "dropped_columns": quality.non_feature_columns(quality.trim_headers(raw).columns, label),
    }
    return Prepared(scaled_columns(encoded, stages[1], features), summary, stages, features)


def prepare_training(df: DataFrame) -> DataFrame:
    """Traffic features, zero-filled, with ``attack_type``; classes of one row are left out."""
    quality.require_columns(df, "attack_type")
    features = quality.keep_traffic_features(df, "attack_type")
    filled = quality.zero_fill(features, [c for c in features.columns if c != "attack_type"])
    return drop_rare_classes(filled, "attack_type", 2)


def numeric_malware(raw: DataFrame, mode: str = "train") -> tuple[DataFrame, list[str], bool]:
    """Valid rows with numeric features and ``malware``. Returns rows, dropped columns, label added."""
    df, label_added = quality.with_malware_label(raw, mode)
    valid = quality.drop_invalid_rows(df)
    dropped = [c for c in ["hash"] if c in valid.columns]
    valid = valid.drop(*dropped)
    texts = quality.non_numeric_columns(valid, "malware")
    numeric = quality.coerce_numeric(
        valid.drop(*[quality.quoted(c) for c in texts]),
        [c for c in valid.columns if c != "malware" and c not in texts],
    )
    return numeric, dropped + texts, label_added


def clean_malware(raw: DataFrame, mode: str = "train") -> tuple[DataFrame, list[str], bool]:
    """The same, in training without constant features."""
    numeric, dropped, label_added = numeric_malware(raw, mode)
    if mode == "train":
        constant = quality.constant_columns(numeric, [c for c in numeric.columns if c != "malware"])
        numeric = numeric.drop(*[quality.quoted(c) for c in constant])
        dropped += constant
    return numeric, dropped, label_added


def preprocess_malware(
    raw: DataFrame,
    mode: str = "train",
    stages: list | None = None,
    training_columns: list[str] | None = None,
    paths: dict[str, str] | None = None,
) -> Prepared:
    """``pca_1..k`` and ``malware``. Test mode takes the stages and columns of a training run.

    Raw rows are read three times: to be counted, for all ranges, means and deviations, and for the
    scaled vectors, which are stored. Components are fitted on the stored vectors and applied to them.
    """
    features_before = len(
        [c for c in raw.columns if c.lower() != "malware" and c != "hash"]
    )
    numeric, dropped, label_added = numeric_malware(raw, mode)
    moments = Moments.of(numeric, [c for c in numeric.columns if c != "malware"])
    before = raw.count()
    missing: list[str] = []
    shared_folder(raw.sparkSession)
    if mode == "train":
        dropped += moments.constant()
        columns = [c for c in numeric.columns if c != "malware" and c not in set(moments.constant())]
        scaling = fit_scaled_vectors(numeric, columns, parameters=moments.scaling(columns))
        scaled = apply_stages(numeric, scaling).select("scaled", "malware").checkpoint()
        reduction, pca, size = fit_pca(scaled, len(columns))
        stages = [*scaling, *reduction]
        extra: list[str] = []
    else:
        if stages is None or training_columns is None:
            raise ValueError("test mode needs the stages and columns of a training run")
        columns = training_columns
        aligned, missing, extra = quality.align(numeric, columns, "malware")
        dropped += extra
        pca, size = stages[-2], len(stages[-1].getIndices())
        scaled = apply_stages(aligned, stages[:-2]).select("scaled", "malware")
        reduction = stages[-2:]
    retained = float(sum(pca.explainedVariance.toArray()[:size]))
    names = [f"pca_{i + 1}" for i in range(size)]
    reduced = vector_columns(apply_stages(scaled, reduction), "pca", names, "malware")
    paths = paths or {}
    summary = {
        "dataset_name": "Malware Training" if mode == "train" else "Malware Test",
        "rows_before": before,
        "rows_after": moments.rows,
        "invalid_records_removed": before - moments.rows,
        "features_used": size,
        "features_discarded": max(features_before - size, 0),
        "dropped_columns": dropped,
        "pca_components": size,
        "pca_variance_target": PCA_VARIANCE_TARGET,
        "pca_variance_retained": retained,
        "pca_model_path": paths.get("pca"),
        "pca_scaler_path": paths.get("scaler"),
        "raw_feature_columns_path": paths.get("columns"),
        "preprocessing_status": "Completed",
        "source_path": paths.get("source"),
        "output_path": paths.get("output"),
        "mode": mode,
        "label_added": label_added,
        "missing_features_filled": missing,
        "extra_features_dropped": extra,
    }
    return Prepared(reduced, summary, stages, columns)


def save_model(spark: SparkSession, stages: list, columns: list[str], path: str) -> None:
    """Fitted stages and the column list they expect."""
    PipelineModel(stages).write().overwrite().save(f"{path}/stages")
    spark.createDataFrame(list(enumerate(columns)), "position int, feature string").write.mode(
        "overwrite"
    ).json(f"{path}/columns")


def load_model(spark: SparkSession, path: str) -> tuple[list, list[str]]:
    stages = PipelineModel.load(f"{path}/stages").stages
    rows = spark.read.schema("position int, feature string").json(f"{path}/columns").collect()
    return stages, [r["feature"] for r in sorted(rows)]


def load_pipeline(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    """A saved model ready to score, and its columns."""
    stages, columns = load_model(spark, path)
    return PipelineModel(stages), columns


def feature_list(columns: list[str], limit: int = 100) -> dict[str, Any]:
    """Number of features and the first of them."""
    return {"feature_count": len(columns), "features": columns[:limit]}


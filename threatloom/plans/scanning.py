"""File corpus to verdicts and threat events."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions import files, pe
from threatloom.functions.scoring import fixed_prediction
from threatloom.operators import corpus as corpus_ops
from threatloom.operators import threats
from threatloom.operators.features import file_features
from threatloom.operators.models import score_malware


def admitted(corpus: DataFrame, max_mb: int = V.MAX_FILE_MB) -> DataFrame:
    """Files with an allowed extension and size; others are not read."""
    # By the plain comparison first, which the scan takes over: larger files are not opened.
    checked = corpus_ops.admit(corpus.where(files.size_ok(F.col("length"), max_mb)), max_mb)
    return checked.where(F.col("allowed") & F.col("valid")).drop("allowed", "valid", "reason")


def scan(
    corpus: DataFrame,
    model: PipelineModel,
    columns: list[str],
    threshold: float = V.SERVING_THRESHOLD,
    imports: DataFrame | None = None,
    prefix_bytes: int | None = None,
) -> DataFrame:
    """A verdict per admitted file: by name for the antivirus test file, "unsupported" for files
    that are not PE, and by the model for the rest.

    The model sees the whole feature vector of a file, aligned to the columns it was fitted on.
    ``features_analyzed`` is their number.
    """
    known = pe.is_pe(admitted(corpus)).withColumn("file_hash", files.file_hash(F.col("content")))
    keep = ["path", "filename", "length", "file_hash", "is_pe"]
    features = file_features(known, columns, *keep, imports=imports, prefix_bytes=prefix_bytes)
    scored = score_malware(features, model, threshold).select(*keep, "prediction")
    eicar = F.lower("filename") == V.EICAR_NAME
    return scored.select(
        "path",
        "filename",
        "length",
        F.when(eicar, V.EICAR_HASH).when(F.col("is_pe"), F.col("file_hash")).otherwise("").alias("file_hash"),
        F.when(eicar, fixed_prediction("Malware"))
        .when(~F.col("is_pe"), fixed_prediction("Benign"))
        .otherwise(F.col("prediction"))
        .alias("prediction"),
        F.when(~eicar & ~F.col("is_pe"), V.UNSUPPORTED_WARNING).alias("warning"),
        F.lit(len(columns)).alias("features_analyzed"),
    )


def events(verdicts: DataFrame) -> DataFrame:
    return threats.scan_events(verdicts)


def shown(verdicts: DataFrame) -> DataFrame:
    return threats.shown_verdicts(verdicts)

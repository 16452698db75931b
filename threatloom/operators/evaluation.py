"""Quality of predictions, computed from the (truth, prediction) counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.operators.joins import held
from threatloom.operators.ranking import exact_percentiles, running_sums
from threatloom.session import shared_folder


def pair_counts(scored: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Rows per (truth, predicted), counted once. All further metrics read these few rows."""
    counts = scored.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )
    return held(counts)


def _classes(pairs: DataFrame, truth_only: bool) -> DataFrame:
    classes = pairs.select(F.col("truth").alias("label"))
    if not truth_only:
        classes = classes.union(pairs.select("predicted"))
    return classes.distinct()


def confusion_matrix(pairs: DataFrame, truth_only: bool = False) -> DataFrame:
    """Counts for every pair of observed classes, zeros included; one row per matrix cell."""
    classes = _classes(pairs, truth_only)
    labels = F.collect_set("label").over(Window.partitionBy(F.lit(0)))
    cells = classes.withColumn("labels", labels).select(
        F.col("label").alias("truth"), F.explode("labels").alias("predicted")
    )
    return cells.join(pairs, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def class_counts(pairs: DataFrame, truth_only: bool = False) -> DataFrame:
    """True positives, false negatives, false positives and support per class.

    With ``truth_only`` predictions outside the true classes are left out, as in a
    confusion matrix restricted to the classes present in the truth.
    """
    classes = _classes(pairs, truth_only)
    if truth_only:
        known = classes.select(F.col("label").alias("predicted"))
        inside = pairs.join(known, "predicted", "left_semi")
    else:
        inside = pairs
    hit = F.col("truth") == F.col("predicted")
    by_truth = inside.groupBy(F.col("truth").alias("label")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fn"),
    )
    by_prediction = inside.groupBy(F.col("predicted").alias("label")).agg(
        F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fp")
    )
    support = pairs.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    joined = (
        classes.join(by_truth, "label", "left")
        .join(by_prediction, "label", "left")
        .join(support, "label", "left")
    )
    return joined.na.fill(0, ["tp", "fn", "fp", "support"])


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def per_class_scores(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; 0 where undefined."""
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return class_counts(pairs).select(
        "label",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "support",
        "tp",
    )


def classification_report(pairs: DataFrame) -> DataFrame:
    """One row per class plus the macro and the support-weighted average."""
    scores = per_class_scores(pairs)
    metrics = ["precision", "recall", "f1"]
    support = F.sum("support").alias("support")
    classes = scores.select(F.col("label").cast("string").alias("label"), *metrics, "support")
    macro = scores.agg(*[F.avg(m).alias(m) for m in metrics], support)
    weighted = scores.agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in metrics], support
    )
    return classes.unionByName(macro.withColumn("label", F.lit("macro avg"))).unionByName(
        weighted.withColumn("label", F.lit("weighted avg"))
    )


def overall_scores(pairs: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    total = F.sum("support")
    return per_class_scores(pairs).agg(
        (F.sum("tp") / total).alias("accuracy"),
        *[
            (F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1")
        ],
    )


def severity_scores(pairs: DataFrame) -> DataFrame:
    """Per true class: weight 1/support and weight * (TP - 2 FN - FP)."""
    weight = _ratio(F.lit(1.0), F.col("support"))
    return class_counts(pairs, truth_only=True).select(
        "label",
        weight.alias("weight"),
        "tp",
        "fn",
        "fp",
        (weight * (F.col("tp") - 2 * F.col("fn") - F.col("fp"))).alias("class_severity"),
    )


def severity_score(pairs: DataFrame) -> DataFrame:
    return severity_scores(pairs).agg(F.sum("class_severity").alias("severity_score"))


def _score_counts(scored: DataFrame, truth: str, score: str) -> DataFrame:
    counts = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(truth) == 1).alias("__pos"), F.count_if(F.col(truth) != 1).alias("__neg")
    )
    # Read four times below; the scores may come from a model.
    shared_folder(scored.sparkSession)
    return counts.checkpoint()


def roc_curve(scored: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """False and true positive rate at each distinct score, from the start point (0, 0) on.

    Scores are counted first and then summed up range by range, so no task sorts all
    of them.
    """
    counts = _score_counts(scored, truth, score)
    totals = counts.agg(F.sum("__pos").alias("p"), F.sum("__neg").alias("n")).first()
    upto = running_sums(
        counts, [], -F.col("threshold"), {"__tp": F.col("__pos"), "__fp": F.col("__neg")}
    )
    positives, negatives = totals["p"] or 0, totals["n"] or 0
    points = upto.select(
        "threshold",
        _ratio(F.col("__fp"), F.lit(negatives)).alias("fpr"),
        _ratio(F.col("__tp"), F.lit(positives)).alias("tpr"),
        # Share of the area below the step that ends here, by the trapezoid rule.
        _ratio(
            F.col("__neg") * (F.col("__tp") - F.col("__pos") / 2.0), F.lit(float(positives) * float(negatives))
        ).alias("area"),
    )
    start = scored.sparkSession.createDataFrame(
        [(float("inf"), 0.0, 0.0, 0.0)], "threshold double, fpr double, tpr double, area double"
    )
    return points.unionByName(start)


def roc_auc(scored: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    return roc_curve(scored, truth, score).agg(F.sum("area").alias("auc"))


def latency_statistics(samples: DataFrame, model: str = "model", ms: str = "ms") -> DataFrame:
    """Count, total, average, throughput, 95th percentile and maximum per model."""
    basic = samples.groupBy(model).agg(
        F.count(ms).alias("samples"),
        F.sum(ms).alias("total_ms"),
        F.avg(ms).alias("avg_ms"),
        (F.count(ms) / (F.sum(ms) / 1000)).alias("throughput_per_sec"),
        F.max(ms).alias("max_ms"),
    )
    return basic.join(exact_percentiles(samples, [model], ms, {"p95_ms": 0.95}), model)


def join_truth(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Truth and prediction of the same row, by its key."""
    return truth.join(predictions, key)


def preview(scored: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows in order of their key, for a look at predictions."""
    return scored.orderBy(key).limit(n)

"""Severity, confidence and class share of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import fixed_values as V


def attack_severity(attack_type: Column) -> Column:
    return (
        F.when(attack_type == V.NORMAL_ATTACK, "low")
        .when(attack_type.isin(V.CRITICAL_ATTACKS), "critical")
        .when(attack_type.isin(V.MEDIUM_ATTACKS), "medium")
        .otherwise("high")
    )


def scan_severity(final_prediction: Column) -> Column:
    return F.when(final_prediction == "Benign", "low").otherwise("high")


def log_confidence(attack_type: Column) -> Column:
    """The confidence the connection log carries when the model's own is not used."""
    return F.when(attack_type == V.NORMAL_ATTACK, F.lit(V.NORMAL_CONFIDENCE)).otherwise(
        F.lit(V.ATTACK_CONFIDENCE)
    )


def severity_table(spark: SparkSession) -> DataFrame:
    """The 13 listed attack types; a size fixed by the rules, safe to broadcast."""
    rows = [(V.NORMAL_ATTACK, "low")]
    rows += [(a, "critical") for a in V.CRITICAL_ATTACKS]
    rows += [(a, "medium") for a in V.MEDIUM_ATTACKS]
    return spark.createDataFrame(rows, "attack_type string, severity string")


def join_severity(df: DataFrame, attack_type: str = "attack_type") -> DataFrame:
    """Severity by lookup; types the table does not list are high."""
    dim = severity_table(df.sparkSession).withColumnsRenamed(
        {"attack_type": "__attack", "severity": "__severity"}
    )
    return (
        df.join(F.broadcast(dim), F.col(attack_type) == F.col("__attack"), "left")
        .withColumn("severity", F.coalesce("__severity", F.lit("high")))
        .drop("__attack", "__severity")
    )


def share_percent(part: Column, total: Column) -> Column:
    return part / total * 100

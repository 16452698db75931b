"""Counts that describe a dataset, each in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.operators.joins import checked_broadcast
from threatloom.operators.quality import invalid_cell, invalid_row, quoted


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per class. Pre-aggregates, so a class with most rows is no hot task."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # One row per class is left here; the total runs over those rows only.
    everything = Window.partitionBy(F.lit(0))
    return counts.withColumn("percent", F.col("n") / F.sum("n").over(everything) * 100)


def top_classes(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )


def dataset_profile(df: DataFrame, label: str = "malware", *identifiers: str) -> DataFrame:
    """Feature, sample and class counts and the share of malware."""
    features = [c for c in df.columns if c not in (label, *identifiers)]
    return df.agg(
        F.lit(len(features)).cast("bigint").alias("total_features"),
        F.lit(len([c for c in features if c.isalpha()])).cast("bigint").alias("api_calls"),
        F.count("*").alias("samples"),
        F.sum(F.col(label)).cast("bigint").alias("malware_count"),
        (F.count("*") - F.sum(F.col(label))).cast("bigint").alias("benign_count"),
        (F.sum(F.col(label)) / F.count("*")).alias("imbalance_ratio"),
    )


def missing_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null cells over all columns, as one number."""
    total: Column = F.lit(0).cast("bigint")
    for name in columns or df.columns:
        total = total + F.count_if(quoted(name).isNull())
    return df.agg(total.alias("missing_cells"))


def invalid_cells_by_column(df: DataFrame) -> DataFrame:
    """Invalid cells per column, in one pass."""
    counts = df.agg(*[F.count_if(invalid_cell(df, c)).alias(c) for c in df.columns])
    return counts.unpivot([], [quoted(c) for c in df.columns], "column_name", "invalid_cells")


def drop_rare_classes(df: DataFrame, column: str, minimum: int = 2) -> DataFrame:
    """Without the classes that have fewer rows than ``minimum``."""
    rare = (
        df.groupBy(column)
        .agg(F.count("*").alias("__n"))
        .where((F.col("__n") < minimum) & F.col(column).isNotNull())
        .select(column)
    )
    return df.join(checked_broadcast(rare), column, "left_anti")


def cleaning_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows before and after dropping invalid ones, in one pass."""
    bad = F.count_if(invalid_row(df, columns=columns))
    return df.agg(
        F.count("*").alias("rows_before"),
        (F.count("*") - bad).alias("rows_after"),
        bad.alias("invalid_records_removed"),
    )

"""Label columns to 0/1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def label_text_to_binary(label: Column) -> Column:
    """0 where the text says benign or normal, else 1. A null reads as the text "nan", so it is 1."""
    text = F.lower(F.trim(label.cast("string")))
    return F.coalesce(
        F.when(text.contains("benign") | text.contains("normal"), 0).otherwise(1), F.lit(1)
    ).cast("int")


def is_binary_domain(df: DataFrame, column: str) -> bool:
    """True for an integral column whose values are all 0 or 1 (one aggregate row)."""
    if not isinstance(df.schema[column].dataType, INTEGRAL):
        return False
    value = F.col(column).cast("long")
    row = df.agg(F.count_if(~value.isin(0, 1) | value.isNull()).alias("other")).first()
    return row["other"] == 0


def map_labels(df: DataFrame, column: str) -> Column:
    """Integer 0/1 labels as they are, anything else by its text."""
    if is_binary_domain(df, column):
        return F.col(column).cast("int")
    return label_text_to_binary(F.col(column))


def clamp_label(label: Column) -> Column:
    """1 for values above zero, else 0."""
    return F.coalesce((label > 0).cast("int"), F.lit(0))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values a label takes."""
    return df.select(column).distinct()

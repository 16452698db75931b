"""Column rules, invalid cells and rows, alignment to a trained schema."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.fixed_values import (
    LABEL_NAMES,
    NON_FEATURE_PARTS,
    PLACEHOLDERS,
    TRAFFIC_FEATURES,
)


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _is_fraction(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _best_named(columns: list[str], ranked: list[str] | tuple[str, ...]) -> str | None:
    """The column whose name, ignoring case, ranks first among the given names."""
    rank = {name: at for at, name in enumerate(ranked)}
    known = [(rank[c.lower()], -at, c) for at, c in enumerate(columns) if c.lower() in rank]
    return min(known)[2] if known else None


def find_label_column(columns: list[str], fall_back_to_last: bool = False) -> str:
    """The label among the columns; if allowed, the last column where no name is known."""
    label = _best_named(columns, LABEL_NAMES) or (columns[-1] if columns and fall_back_to_last else None)
    if label is None:
        raise ValueError(f"no label column among {columns}")
    return label


def find_malware_column(columns: list[str]) -> str | None:
    return _best_named(columns, ["malware"])


def with_malware_label(df: DataFrame, mode: str = "train") -> tuple[DataFrame, bool]:
    """Name the label ``malware``; test files without one get 0 and the flag True."""
    found = find_malware_column(df.columns)
    if found is None:
        if mode != "test":
            raise ValueError("required column 'malware' not found")
        return df.withColumn("malware", F.lit(0)), True
    return df.withColumnRenamed(found, "malware"), False


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns not found: {missing}")


#: ``id`` as the whole name, as its last word after a space or underscore, as its first word
#: before an underscore, or as a word between spaces.
_ID_WORD = re.compile(r"^id$|[_ ]id$|^id_| id ")


def is_non_feature(name: str) -> bool:
    """Identifier-like names, and names that speak of addresses or times."""
    lowered = name.lower()
    return bool(_ID_WORD.search(lowered)) or any(part in lowered for part in NON_FEATURE_PARTS)


def non_feature_columns(columns: list[str], label: str) -> list[str]:
    return [c for c in columns if c != label and is_non_feature(c)]


def drop_non_features(df: DataFrame, label: str) -> DataFrame:
    return df.drop(*[quoted(c) for c in non_feature_columns(df.columns, label)])


def keep_traffic_features(df: DataFrame, *extra: str) -> DataFrame:
    """The model's numeric features that exist, in their fixed order."""
    return df.select(*[c for c in TRAFFIC_FEATURES if c in df.columns], *extra)


def non_numeric_columns(df: DataFrame, *keep: str) -> list[str]:
    return [c for c in df.columns if c not in keep and not is_numeric(df, c)]


def drop_non_numeric(df: DataFrame, *keep: str) -> DataFrame:
    return df.drop(*[quoted(c) for c in non_numeric_columns(df, *keep)])


def drop_identifiers(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*(names or ("hash", "Name")))


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at most one distinct non-null value, found in one pass."""
    if not columns:
        return []
    ends = [F.min(quoted(c)).alias(f"lo{i}") for i, c in enumerate(columns)]
    ends += [F.max(quoted(c)).alias(f"hi{i}") for i, c in enumerate(columns)]
    row = df.agg(*ends).first()
    return [c for i, c in enumerate(columns) if row[f"lo{i}"] == row[f"hi{i}"]]


def _bad_number(df: DataFrame, name: str) -> Column:
    column = quoted(name)
    if _is_fraction(df, name):
        return F.isnan(column) | (F.abs(column) == float("inf"))
    return F.lit(False)


def invalid_cell(df: DataFrame, name: str, placeholders: list[str] = PLACEHOLDERS) -> Column:
    """Null, not a number, infinite, or a placeholder text."""
    column = quoted(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        bad = column.isin(placeholders)
    else:
        bad = _bad_number(df, name)
    return column.isNull() | F.coalesce(bad, F.lit(False))


def invalid_row(
    df: DataFrame, placeholders: list[str] = PLACEHOLDERS, columns: list[str] | None = None
) -> Column:
    return reduce(or_, [invalid_cell(df, c, placeholders) for c in columns or df.columns])


def drop_invalid_rows(df: DataFrame, placeholders: list[str] = PLACEHOLDERS) -> DataFrame:
    """Rows whose every cell is valid. Narrow: no shuffle."""
    return df.where(~invalid_row(df, placeholders))


def nullify_invalid(df: DataFrame, placeholders: list[str] = PLACEHOLDERS) -> DataFrame:
    """Invalid cells become null."""
    return df.select(
        *[F.when(~invalid_cell(df, c, placeholders), quoted(c)).alias(c) for c in df.columns]
    )


def zero_fill(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null, NaN and infinite cells of numeric columns become 0."""
    wanted = set(columns or [c for c in df.columns if is_numeric(df, c)])
    return df.select(
        *[
            F.when(F.coalesce(quoted(c).isNull() | _bad_number(df, c), F.lit(True)), F.lit(0))
            .otherwise(quoted(c))
            .cast(df.schema[c].dataType)
            .alias(c)
            if c in wanted
            else quoted(c)
            for c in df.columns
        ]
    )


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles, null where a value is no number; then rows with nulls go."""
    coerced = df.select(
        *[
            quoted(c).try_cast("double").alias(c) if c in set(columns) else quoted(c)
            for c in df.columns
        ]
    )
    return drop_invalid_rows(coerced)


def align(df: DataFrame, training: list[str], *keep: str) -> tuple[DataFrame, list[str], list[str]]:
    """Training columns in training order; missing ones are 0, extra ones go. Reports both."""
    missing = [c for c in training if c not in df.columns]
    extra = [c for c in df.columns if c not in training and c not in keep]
    columns = [
        F.lit(0).alias(c) if c in set(missing) else F.coalesce(quoted(c), F.lit(0)).alias(c)
        for c in training
    ]
    return df.select(*columns, *[quoted(c) for c in keep]), missing, extra


def align_map(df: DataFrame, features: str, training: list[str]) -> DataFrame:
    """The same for a map of feature values."""
    return df.select(
        "*",
        *[
            F.coalesce(F.try_element_at(F.col(features), F.lit(c)).cast("double"), F.lit(0.0)).alias(c)
            for c in training
        ],
    )


def feature_set_difference(training: DataFrame, present: DataFrame, column: str = "feature") -> DataFrame:
    """Features only one side has, as ``missing`` or ``extra``."""
    missing = training.select(column).subtract(present.select(column))
    extra = present.select(column).subtract(training.select(column))
    return missing.withColumn("status", F.lit("missing")).unionByName(
        extra.withColumn("status", F.lit("extra"))
    )


def rename_first(df: DataFrame, candidates: list[str], target: str = "attack_type") -> DataFrame:
    for name in candidates:
        if name in df.columns:
            return df.withColumnRenamed(name, target)
    return df

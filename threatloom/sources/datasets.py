"""Intrusion and malware datasets from CSV."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from threatloom import schemas
from threatloom.fixed_values import CIC_LABEL_NAMES, CSV_NULL_TOKENS, NSL_KDD_COLUMNS, UNSW_LABEL_NAMES
from threatloom.operators.quality import quoted, rename_first

_WHOLE = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def distinct_headers(names: list[str]) -> list[str]:
    """A repeated header becomes name.1, name.2 and so on."""
    seen: dict[str, int] = {}
    result = []
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        result.append(f"{name}.{n}" if n else name)
    return result


def _null_if_token(column: Column) -> Column:
    return F.when(~column.isin(CSV_NULL_TOKENS), column)


def _text_layout(names: list[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)


def typed_columns(texts: DataFrame) -> DataFrame:
    """Text columns whose every value is a whole number or a number become that, in one pass."""
    checks = []
    for i, name in enumerate(texts.columns):
        column = quoted(name)
        long_ok = column.rlike(_WHOLE) & column.try_cast("bigint").isNotNull()
        checks += [
            F.count(column).alias(f"n{i}"),
            F.count_if(column.isNull()).alias(f"null{i}"),
            F.count_if(long_ok).alias(f"l{i}"),
            F.count_if(column.rlike(_NUMBER)).alias(f"d{i}"),
        ]
    row = texts.agg(*checks).first()
    columns = []
    for i, name in enumerate(texts.columns):
        n = row[f"n{i}"]
        if row[f"l{i}"] == n and n and not row[f"null{i}"]:
            columns.append(quoted(name).try_cast("bigint").alias(name))
        elif row[f"d{i}"] == n:
            columns.append(F.trim(quoted(name)).try_cast("double").alias(name))
        else:
            columns.append(quoted(name))
    return texts.select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Pin a schema for large inputs; without one, types come from one more pass.

    Null tokens are null either way; with a schema, so is a value that is none of its type.
    """
    if schema:
        fields = T.StructType.fromDDL(schema).fields
        texts = spark.read.schema(_text_layout([f.name for f in fields])).csv(path, header=True)
        return texts.select(
            *[_null_if_token(quoted(f.name)).try_cast(f.dataType).alias(f.name) for f in fields]
        )
    first = spark.read.csv(path, header=False, inferSchema=False).first()
    first_names = ["" if v is None else v for v in first]
    names = distinct_headers(first_names)
    # Files of one folder must agree on their header: another order of columns is refused.
    same = spark.read.schema(_text_layout(names)).option("enforceSchema", names != first_names)
    texts = same.csv(path, header=True)
    return typed_columns(texts.select(*[_null_if_token(quoted(n)).alias(n) for n in names]))


#: Why a row is not used: the line where its cells do not fit the columns, else the cells that are
#: none of their type, by column; and the file it is from. Null for rows that are.
REJECTED = "rejected"
_REJECTED = "line string, cells map<string,string>, file string"


def read_checked(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV with a pinned schema, and ``rejected`` where a row does not keep to it.

    Such a cell is null, but not without a trace. Null tokens are nulls that are allowed.
    """
    fields = T.StructType.fromDDL(schema).fields
    layout = f"{_text_layout([f.name for f in fields])}, `{_LINE}` string"
    texts = spark.read.schema(layout).options(columnNameOfCorruptRecord=_LINE, columnPruning=False).csv(path, header=header)
    given = {f.name: _null_if_token(quoted(f.name)) for f in fields}
    cells = [
        F.struct(F.lit(f.name).alias("key"), F.when(given[f.name].try_cast(f.dataType).isNull(), given[f.name]).alias("value"))
        for f in fields
        if not isinstance(f.dataType, T.StringType)
    ]
    bad = F.map_from_entries(F.filter(F.array(*cells), lambda c: c["value"].isNotNull()))
    whole = quoted(_LINE)
    reason = F.struct(whole.alias("line"), F.when(whole.isNull(), bad).alias("cells"), F.col("_metadata.file_path").alias("file"))
    rejected = F.when(whole.isNotNull() | (F.size(bad) > 0), reason.cast(f"struct<{_struct(_REJECTED)}>"))
    return texts.select(*[given[f.name].try_cast(f.dataType).alias(f.name) for f in fields], rejected.alias(REJECTED))


_LINE = "__line"


def _struct(ddl: str) -> str:
    return ", ".join(f.replace(" ", ":", 1) for f in ddl.split(", "))


def split_rejected(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to use, and why the others are not used; a table that was not checked has no others."""
    if REJECTED not in checked.columns:
        return checked, checked.sparkSession.createDataFrame([], _REJECTED)
    return checked.where(F.col(REJECTED).isNull()).drop(REJECTED), checked.where(F.col(REJECTED).isNotNull()).select(
        f"{REJECTED}.*"
    )


def read_nsl_kdd(spark: SparkSession, path: str) -> DataFrame:
    """43 columns without a header; the difficulty goes. A malformed number is null (see ``read_checked``)."""
    return spark.read.schema(schemas.NSL_KDD).csv(path, header=False).drop("difficulty")


def checked_nsl_kdd(spark: SparkSession, path: str) -> DataFrame:
    return read_checked(spark, path, schemas.NSL_KDD, header=False).drop("difficulty")


def read_flow_features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Flow feature files, their columns renamed by position to the model's names."""
    return (
        spark.read.schema(schemas.FLOW_EXPORT)
        .option("recursiveFileLookup", "true")
        .csv(path, header=True)
        .toDF(*schemas.FLOW_POSITIONAL_NAMES)
    )


def read_cic_ids(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return rename_first(read_csv(spark, path, schema), CIC_LABEL_NAMES)


def read_unsw_nb15(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return rename_first(read_csv(spark, path, schema), UNSW_LABEL_NAMES)


def first_available(
    spark: SparkSession, candidates: list[tuple[str, str, Callable[[SparkSession, str], DataFrame]]]
) -> tuple[str, DataFrame]:
    """Name and table of the first candidate (name, path, reader) that can be read."""
    for name, path, reader in candidates:
        try:
            return name, reader(spark, path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    raise FileNotFoundError(f"no dataset found: {[path for _, path, _ in candidates]}")


def training_dataset(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """NSL-KDD if it is there, checked row by row, else CIC-IDS-2017, else UNSW-NB15."""
    return first_available(
        spark,
        [
            ("NSL-KDD", f"{folder}/NSL_KDD.csv", checked_nsl_kdd),
            ("CIC-IDS-2017", f"{folder}/CIC_IDS_2017.csv", read_cic_ids),
            ("UNSW-NB15", f"{folder}/UNSW_NB15.csv", read_unsw_nb15),
        ],
    )


NSL_KDD_NAMES = [name for name, _ in NSL_KDD_COLUMNS]

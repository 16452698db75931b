"""Category codes and population-variance scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.param import Param
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.operators.joins import checked_broadcast
from threatloom.operators.quality import quoted
from threatloom.operators.ranking import codes_in_order
from threatloom.session import shared_folder

# Fixed value: the category of a null.
NULL_TEXT = "nan"


def class_mapping(df: DataFrame, column: str) -> DataFrame:
    """``encoded_value`` and ``original_label`` for each class."""
    return codes_in_order(
        df.select(F.col(column).cast("string").alias("original_label")), "original_label"
    )


def decode_classes(df: DataFrame, mapping: DataFrame, code: str, name: str) -> DataFrame:
    """Class names for codes."""
    lookup = mapping.select(
        F.col("encoded_value").alias("__code"), F.col("original_label").alias(name)
    )
    return df.join(checked_broadcast(lookup), F.col(code) == F.col("__code")).drop("__code")


def category_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``category``, ``code`` (0 to n-1 in alphabetical order) and ``rows`` of every text
    column, from one pass over the rows; null is the text ``nan``."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.coalesce(quoted(c).cast("string"), F.lit(NULL_TEXT)).alias("category"))
        for c in columns
    ]
    shared_folder(df.sparkSession)
    counted = df.select(F.explode(F.array(*pairs)).alias("pair")).groupBy("pair").agg(F.count("*").alias("rows")).checkpoint()
    placed = codes_in_order(counted, "pair", "place").join(counted, "pair")
    placed = placed.select("place", "pair.column", "pair.category", "rows")
    first = placed.groupBy("column").agg(F.min("place").alias("first"))
    codes = placed.join(F.broadcast(first), "column")  # a row for each column
    return codes.select("column", "category", (F.col("place") - F.col("first")).alias("code"), "rows")


class CategoryEncoder(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the categories of text columns."""

    def __init__(self, columns: list[str] | None = None, unseen: str = "next"):
        super().__init__()
        self.columns = Param(self, "columns", "text columns")
        self.unseen = Param(self, "unseen", "what becomes of a category that was not learnt: next or error")
        self._set(columns=columns or [], unseen=unseen)

    def _fit(self, df: DataFrame) -> CategoryEncoderModel:
        columns = self.getOrDefault("columns")
        shared_folder(df.sparkSession)
        table = category_table(df, columns).checkpoint() if columns else None
        return CategoryEncoderModel(columns, self.getOrDefault("unseen"), table)


class CategoryEncoderModel(Model, MLWritable, MLReadable):
    """Replaces text columns by the codes of their categories.

    A category that was not learnt gets the code after the last one of its column, the same for all
    such; with ``unseen="error"`` it is refused. The categories are a table, saved beside the
    parameters and joined, by broadcast where they are few.
    """

    def __init__(self, columns: list[str] | None = None, unseen: str = "next", table: DataFrame | None = None):
        super().__init__()
        self.columns = Param(self, "columns", "text columns")
        self.unseen = Param(self, "unseen", "what becomes of a category that was not learnt: next or error")
        self._set(columns=columns or [], unseen=unseen)
        self.table = table

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = self.getOrDefault("columns")
        # A row for each column.
        sizes = {r["column"]: r["n"] for r in self.table.groupBy("column").agg(F.count("*").alias("n")).collect()} if columns else {}
        for column in columns:
            mapping = self.table.where(F.col("column") == column).select(
                F.col("category").alias("__label"), F.col("code").alias("__code")
            )
            text = F.coalesce(quoted(column).cast("string"), F.lit(NULL_TEXT))
            joined = df.withColumn("__text", text).join(
                checked_broadcast(mapping), F.col("__text") == F.col("__label"), "left"
            )
            if self.getOrDefault("unseen") == "error":
                message = F.concat(F.lit(f"category of {column} was not learnt: "), F.col("__text"))
                code = F.when(F.col("__label").isNull(), F.raise_error(message)).otherwise(F.col("__code"))
            else:
                code = F.coalesce("__code", F.lit(sizes.get(column, 0)))
            df = joined.select(
                *[code.cast("bigint").alias(c) if c == column else quoted(c) for c in df.columns]
            )
        return df

    def scaling_parameters(self) -> dict[str, tuple[float, float]]:
        """Mean and population deviation of the codes of each column over the rows they were learnt from."""
        if not self.getOrDefault("columns"):
            return {}
        n, code = F.col("rows"), F.col("code")
        mean = F.sum(n * code) / F.sum(n)
        rows = self.table.groupBy("column").agg(
            mean.alias("mean"), F.sqrt(F.greatest(F.sum(n * code * code) / F.sum(n) - mean * mean, F.lit(0.0))).alias("scale")
        )
        return {r["column"]: (r["mean"], r["scale"] or 1.0) for r in rows.collect()}  # a row for each column

    def write(self) -> MLWriter:
        return _CategoryWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CategoryReader()


_TABLE = "column string, category string, code bigint, rows bigint"


class _CategoryWriter(MLWriter):
    def __init__(self, model: CategoryEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        table = self.model.table
        if table is None:
            table = self.sparkSession.createDataFrame([], _TABLE)
        table.write.parquet(f"{path}/categories")


class _CategoryReader(MLReader):
    def load(self, path: str) -> CategoryEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CategoryEncoderModel(table=self.sparkSession.read.schema(_TABLE).parquet(f"{path}/categories"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def encode_categoricals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace text columns by their codes 0..n-1 in alphabetical order; null is the text ``nan``."""
    return CategoryEncoder(columns).fit(df).transform(df)


@dataclass
class Moments:
    """All rows, rows that count, and of these per column least and greatest value, mean and population
    deviation, of one pass."""

    all_rows: int
    rows: int
    columns: dict[str, tuple]

    @classmethod
    def of(cls, df: DataFrame, columns: list[str], where: Column | None = None) -> Moments:
        measures = {"lo": F.min, "hi": F.max, "m": F.avg, "s": F.stddev_pop}
        where = F.lit(True) if where is None else where
        # The condition once a row, not once a column.
        rows = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)], where.alias("counts"))
        stats = [
            f(F.when(F.col("counts"), F.col(f"c{i}"))).alias(f"{n}{i}")
            for i in range(len(columns)) for n, f in measures.items()
        ]
        row = rows.agg(F.count("*").alias("all"), F.count_if("counts").alias("rows"), *stats).first()
        found = {c: tuple(row[f"{n}{i}"] for n in measures) for i, c in enumerate(columns)}
        return cls(row["all"], row["rows"], found)

    def constant(self) -> list[str]:
        """Columns with at most one distinct value."""
        return [c for c, (low, high, _, _) in self.columns.items() if low == high]

    def scaling(self, columns: list[str] | None = None) -> dict[str, tuple[float, float]]:
        """Mean and deviation per column; a constant column scales by 1."""
        wanted = self.columns if columns is None else columns
        return {c: (float(self.columns[c][2] or 0.0), float(self.columns[c][3] or 0.0) or 1.0) for c in wanted}


def scaling_parameters(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column in one pass; a constant column scales by 1."""
    return Moments.of(df, columns).scaling()


def scaler_stage(parameters: dict[str, tuple[float, float]], names: list[str] | None = None) -> SQLTransformer:
    """A stage that can be saved in a pipeline and adds one scaled column per feature.

    The scaled columns are ``z_`` and the feature's name, or the given names.
    """
    columns = []
    for (name, (mean, scale)), scaled in zip(parameters.items(), names or [f"z_{n}" for n in parameters]):
        tick, alias = name.replace("`", "``"), scaled.replace("`", "``")
        columns.append(
            f"(CAST(`{tick}` AS DOUBLE) - CAST('{mean!r}' AS DOUBLE)) / CAST('{scale!r}' AS DOUBLE) AS `{alias}`"
        )
    return SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")


def scaled_columns(df: DataFrame, stage: SQLTransformer, columns: list[str]) -> DataFrame:
    """Scaled values in place of the columns."""
    wanted = set(columns)
    return stage.transform(df).select(
        *[quoted(f"z_{c}").alias(c) if c in wanted else quoted(c) for c in df.columns]
    )


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values scaled by their own mean and deviation in place of the columns."""
    return scaled_columns(df, scaler_stage(scaling_parameters(df, columns)), columns)

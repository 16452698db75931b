"""What the operators of this subpackage share: words, safe names, tables kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.session import new_folder

#: The six characters that part words; everything else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ROW = "row"
#: A value that more than one in so many rows have is heavy; there are fewer than so many of those.
HEAVY = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, name: str) -> Column:
    """A column by its whole name, also if that holds dots or backticks."""
    return df["`" + name.replace("`", "``") + "`"]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no column of the input can clash with a working column."""
    return F.struct(*[named(df, c) for c in df.columns])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``whole_row`` again, in the order and under the names they had."""
    return df.select(*[F.col(ROW).getField(c).alias(c) for c in columns])


def words(text: Column) -> Column:
    """The words of a text in order; none for null, empty or blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_CLASS + "+")).otherwise(
        F.array().cast("array<string>")
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the folder that all executors share, and read from there.

    Later stages start from the files: a lost executor costs its own tasks only.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(rows: DataFrame, values: DataFrame, key: str, count: str, total: int, spread: str) -> DataFrame:
    """Left join of ``rows`` with ``values``, which has one row for each value of ``key``; no value is a long task.

    ``count`` in ``values`` is how many of the ``total`` rows have the value. Fewer than ``HEAVY`` values
    can have more than ``total / HEAVY`` rows: these are broadcast, whatever the table's size, and their rows
    go through the shuffled join of all others by a hash of ``spread``.
    """
    names = [c for c in values.columns if c != key]
    found = F.struct(*names)
    heavy = values.where(F.col(count) * HEAVY > total).select(F.col(key).alias("__heavy"), found.alias("__of_heavy"))
    light = values.where(F.col(count) * HEAVY <= total).select(F.col(key).alias("__light"), found.alias("__of_light"))
    met = rows.join(F.broadcast(heavy), F.col(key) == F.col("__heavy"), "left")
    dealt = F.xxhash64(key, spread).cast(rows.schema[key].dataType)
    met = met.withColumn("__key", F.when(F.col("__heavy").isNull(), F.col(key)).otherwise(dealt))
    met = met.join(light, F.col("__key") == F.col("__light"), "left")
    # A heavy row's hash may be some light value: what was broadcast decides.
    answer = F.when(F.col("__heavy").isNull(), F.col("__of_light")).otherwise(F.col("__of_heavy"))
    return met.select(*rows.columns, answer.alias("__found")).select(*rows.columns, "__found.*")

"""Stratified train/test split and random samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.operators.joins import checked_broadcast
from threatloom.operators.quality import quoted


def shuffle_key(key: Column, seed: int) -> Column:
    """A hex text that orders rows at random, the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


# About as many rows as one task should have to rank.
RANGE_ROWS = 1_000_000


def range_digits(rows: int) -> int:
    """Hex digits that cut ``rows`` hashed rows into ranges of at most about RANGE_ROWS."""
    digits = 1
    while rows / 16**digits > RANGE_ROWS:
        digits += 1
    return digits


def _first_of_each(
    df: DataFrame, label: str, key: str, quota: Callable[[Column], Column], name: str, seed: int, digits: int | None
) -> DataFrame:
    """Add a flag to the first ``quota(rows of the class)`` rows of each class, in the order of a hash.

    Rows are ordered by a hash of their key and cut into ranges by its first digits.
    Per class only the one range that holds the cut is ranked; every other row is
    decided where it lies, without a shuffle, as long as the one row per class fits a
    broadcast.
    """
    digits = digits or range_digits(df.count())
    tagged = df.withColumn("__hash", shuffle_key(F.col(key), seed)).withColumn(
        "__range", F.substring("__hash", 1, digits)
    )
    sizes = tagged.groupBy(F.col(label).alias("__label"), "__range").agg(F.count("*").alias("__n"))
    per_class = Window.partitionBy("__label")
    upto = per_class.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        sizes.withColumn("__upto", F.sum("__n").over(upto))
        .withColumn("__quota", quota(F.sum("__n").over(per_class)))
        .where((F.col("__upto") - F.col("__n") < F.col("__quota")) & (F.col("__quota") <= F.col("__upto")))
        .select(
            "__label",
            F.col("__range").alias("__cut"),
            (F.col("__quota") - F.col("__upto") + F.col("__n")).alias("__take"),
        )
    )
    with_cut = tagged.join(checked_broadcast(cuts), F.col(label).eqNullSafe(F.col("__label")), "left")
    at_cut = F.col("__range") == F.col("__cut")
    decided = with_cut.where(~F.coalesce(at_cut, F.lit(False))).withColumn(
        name, F.coalesce(F.col("__range") < F.col("__cut"), F.lit(False))
    )
    rank = F.row_number().over(Window.partitionBy(label, "__range").orderBy("__hash", key))
    ranked = with_cut.where(at_cut).withColumn(name, rank <= F.col("__take"))
    return decided.unionByName(ranked).select(*map(quoted, df.columns), name)


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_fraction: float = 0.2,
    seed: int = 42,
    digits: int | None = None,
) -> DataFrame:
    """Add ``is_test``: exactly round(fraction * n) rows of each class."""
    return _first_of_each(
        df, label, key, lambda n: F.floor(n * F.lit(test_fraction) + 0.5), "is_test", seed, digits
    )


def take_per_class(
    df: DataFrame, label: str, key: str, most: int, seed: int = 42, digits: int | None = None
) -> DataFrame:
    """Exactly ``most`` rows of each class, all rows of a smaller one; the same rows on every run."""
    flagged = _first_of_each(df, label, key, lambda n: F.least(n, F.lit(most)), "__taken", seed, digits)
    return flagged.where("__taken").drop("__taken")


def random_sample(df: DataFrame, key: str, n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a hash of their key."""
    return (
        df.withColumn("__hash", shuffle_key(F.col(key), seed))
        .orderBy("__hash", key)
        .limit(n)
        .drop("__hash")
    )

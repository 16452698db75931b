"""Row numbers and running sums that no single task has to sort whole.

A plain window needs all rows of a partition in one task. Here the order column is
first cut into ranges of about equal size; each range is numbered on its own and
shifted by the totals of the ranges before it. Results are exact for any cut; the
cut only decides how even the work is.
"""

from __future__ import annotations

from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.session import default_blocks, shared_folder

BLOCK = "__block"
_ORDER = "__order"
CUT_SAMPLE_ROWS = 1_000_000
#: Rows of a block where the caller names no number of blocks, and the most blocks that are cut.
BLOCK_ROWS, MAX_BLOCKS = 1_000_000, 20_000


def range_cuts(df: DataFrame, column: str, blocks: int | None) -> list[float]:
    """At most ``blocks - 1`` ascending cut points; without a number, blocks of ``BLOCK_ROWS`` rows.

    Large inputs are sampled for this, as a range shuffle does. That moves the cuts a
    little and with them the balance of the blocks, never a result.
    """
    values = df.select(column).where(F.col(column).isNotNull())
    rows = values.count() if blocks != 1 else 0
    if rows == 0:
        return []
    blocks = blocks or min(MAX_BLOCKS, max(default_blocks(df.sparkSession), -(-rows // BLOCK_ROWS)))
    if rows > CUT_SAMPLE_ROWS:
        values = values.sample(CUT_SAMPLE_ROWS / rows, seed=42)
    probabilities = [i / blocks for i in range(1, blocks)]
    quantiles = values.approxQuantile(column, probabilities, 0.25 / blocks)
    return sorted({q for q in quantiles if isfinite(q)})


def with_blocks(df: DataFrame, order: Column, blocks: int | None = None) -> DataFrame:
    """Add a block number that never falls as the order column rises; equal values share a block."""
    tagged = df.withColumn(_ORDER, order.cast("double"))
    cuts = range_cuts(tagged, _ORDER, blocks)
    if not cuts:
        return tagged.withColumn(BLOCK, F.lit(0)).drop(_ORDER)
    bucketizer = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")],
        inputCol=_ORDER,
        outputCol=BLOCK,
        handleInvalid="keep",
    )
    return bucketizer.transform(tagged).withColumn(BLOCK, F.col(BLOCK).cast("int")).drop(_ORDER)


def shift_by_blocks(
    df: DataFrame, keys: list[str], sums: dict[str, Column]
) -> tuple[DataFrame, list[str]]:
    """Join each row to the totals of the earlier blocks of its key, as ``__before_<name>``."""
    totals = df.groupBy(*keys, BLOCK).agg(*[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])
    earlier = (
        Window.partitionBy(*keys or [F.lit(0)])
        .orderBy(BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    names = [f"__before_{n}" for n in sums]
    offsets = totals.select(
        *[F.col(k).alias(f"__key_{k}") for k in [*keys, BLOCK]],
        *[
            F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__before_{n}")
            for n in sums
        ],
    )
    condition = F.col(BLOCK) == F.col(f"__key_{BLOCK}")
    for key in keys:
        condition &= F.col(key).eqNullSafe(F.col(f"__key_{key}"))
    joined = df.join(offsets, condition).drop(*[f"__key_{k}" for k in [*keys, BLOCK]])
    return joined, names


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: Column,
    sums: dict[str, Column],
    ties: list[str] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Inclusive running sums per key along ``order``, one column per entry of ``sums``.

    ``order`` is numeric (negate it for descending); rows equal in ``order`` and
    ``ties`` add up in no given order.
    """
    blocked = with_blocks(df, order, blocks)
    joined, names = shift_by_blocks(blocked, keys, sums)
    within = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(order, *(ties or []))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for (name, value), before in zip(sums.items(), names):
        joined = joined.withColumn(name, F.sum(value).over(within) + F.col(before))
    return joined.drop(BLOCK, *names)


def row_numbers(
    df: DataFrame,
    keys: list[str],
    order: Column,
    name: str,
    ties: list[str] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """1-based row number per key along ``order``."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, ties, blocks)


def codes_in_order(values: DataFrame, column: str, name: str = "encoded_value") -> DataFrame:
    """0-based position of each distinct value in ascending order.

    The distinct values are range-partitioned and checkpointed, so that the row
    positions within partitions stay what they are when a task is run again.
    """
    shared_folder(values.sparkSession)
    ordered = (
        values.select(column)
        .where(F.col(column).isNotNull())
        .distinct()
        .repartitionByRange(column)
        .sortWithinPartitions(column)
        .checkpoint()
    )
    # The id holds the partition number above bit 33 and the row's position below it.
    position = F.monotonically_increasing_id()
    numbered = ordered.select(
        column,
        F.shiftright(position, 33).cast("int").alias(BLOCK),
        position.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"),
    )
    joined, (before,) = shift_by_blocks(numbered, [], {"rows": F.lit(1).cast("bigint")})
    return joined.select((F.col(before) + F.col("__at")).alias(name), column)


def exact_percentiles(
    df: DataFrame, keys: list[str], column: str, fractions: dict[str, float]
) -> DataFrame:
    """Percentiles with linear interpolation between the two nearest ranks, per key."""
    shared_folder(df.sparkSession)
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, column)
        .agg(F.count("*").alias("__n"))
        .checkpoint()
    )
    upto = running_sums(counts, keys, F.col(column), {"__upto": F.col("__n")})
    sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("__size"))
    if keys:
        sized = upto.join(sizes, keys)
    else:
        sized = upto.withColumn("__size", F.lit(sizes.first()["__size"]))
    result = []
    for name, fraction in fractions.items():
        rank = F.lit(fraction) * (F.col("__size") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        start = F.col("__upto") - F.col("__n")
        at_low = F.max(F.when((start <= low) & (low < F.col("__upto")), F.col(column)))
        at_high = F.max(F.when((start <= high) & (high < F.col("__upto")), F.col(column)))
        weight = F.max(rank - low)
        result.append((at_low + (at_high - at_low) * weight).alias(name))
    return sized.groupBy(*keys).agg(*result)

"""Small tables: checked before they are broadcast, and computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.session import shared_folder

BROADCAST_ROWS = 10_000


def checked_broadcast(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side as a broadcast table if it has at most ``max_rows`` rows, else as it is.

    The check runs the side's query once and fetches no more than ``max_rows + 1``
    rows. A larger side is left to a shuffled join, where adaptive execution splits
    skewed partitions.
    """
    rows = side.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return side
    return F.broadcast(side.sparkSession.createDataFrame(rows, side.schema))


def held(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A small result computed once, for several readers.

    Up to ``max_rows`` rows stay with the plan; a larger result is checkpointed to the
    shared folder. Either way the query behind it does not run again.
    """
    rows = small.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return small.sparkSession.createDataFrame(rows, small.schema)
    shared_folder(small.sparkSession)
    return small.checkpoint()


def training_rows(rows: DataFrame) -> DataFrame:
    """Rows that an iterative fit reads many times: written once to the shared folder, and in
    at least as many partitions as there are slots."""
    shared_folder(rows.sparkSession)
    stored = rows.checkpoint()
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return stored if stored.rdd.getNumPartitions() >= slots else stored.repartition(slots)

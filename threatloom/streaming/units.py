"""Capture units on a live stream: a sensor's packets in runs of a fixed number, each given out as it fills.

Between micro-batches a table beside the ledger holds, per sensor, the packets of the unit that is open
(fewer than a unit) and how many units were given out. A unit may so span any number of micro-batches
and restarts. The open unit of a stream that ends is never given out.

A micro-batch is numbered range by range (``operators/ranking.py``), so a sensor's share of it is as many
tasks as it needs. It writes its table before its lines in the ledger, and reads that of the micro-batch
before, so one that runs again finds what it found the first time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.operators.joins import checked_broadcast, training_rows
from threatloom.operators.ranking import row_numbers
from threatloom.session import shared_folder

UNIT = "unit"
#: Tables that are kept: the one that is written, and the one before.
KEPT = 2


def _state(ledger: str, batch_id: int) -> str:
    return f"{ledger.rstrip('/')}-open/{batch_id % KEPT}"


def unit_packets(batch: DataFrame, batch_id: int, sensor: str, size: int, ledger: str) -> DataFrame:
    """The packets of the units that a micro-batch fills, with the unit's number per sensor.

    Packets of a micro-batch are taken by ``seq``, after those of earlier ones. What stays open is
    written beside the ledger.
    """
    spark = batch.sparkSession
    shared_folder(spark)
    kind = batch.schema[sensor].dataType.simpleString()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    before, now = _state(ledger, batch_id - 1), _state(ledger, batch_id)
    packets, sensors = f"{fields}, __at bigint", f"__sensor {kind}, given bigint, held bigint"
    if batch_id:
        waiting = spark.read.schema(packets).parquet(f"{before}/packets")
        given = spark.read.schema(sensors).parquet(f"{before}/sensors")
    else:
        waiting, given = spark.createDataFrame([], packets), spark.createDataFrame([], sensors)
    arrived = row_numbers(batch, [sensor], F.col("seq"), "__at")
    known = checked_broadcast(given)
    same = F.col(sensor).eqNullSafe(F.col("__sensor"))
    placed = arrived.join(known, same, "left").withColumn("__at", F.col("__at") + F.coalesce("held", F.lit(0)))
    # Read three times below, by as many tasks as there are slots.
    placed = training_rows(placed.drop("__sensor", "given", "held").unionByName(waiting))
    counts = placed.groupBy(F.col(sensor).alias("__own")).agg(F.count("*").alias("n"))
    every = (
        counts.join(given, F.col("__own").eqNullSafe(F.col("__sensor")), "full")
        .select(
            F.when(F.col("n").isNull(), F.col("__sensor")).otherwise(F.col("__own")).alias("__sensor"),
            F.coalesce("given", F.lit(0)).alias("before"),
            F.floor(F.coalesce("n", F.lit(0)) / size).alias("full"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
        .checkpoint()
    )
    numbered = placed.join(checked_broadcast(every), same)
    end = F.col("full") * size
    left = numbered.where(F.col("__at") > end).withColumn("__at", F.col("__at") - end)
    left.select(*batch.columns, "__at").write.mode("overwrite").parquet(f"{now}/packets")
    every.select("__sensor", (F.col("before") + F.col("full")).alias("given"), (F.col("n") - end).alias("held")).write.mode(
        "overwrite"
    ).parquet(f"{now}/sensors")
    unit = F.col("before") + F.floor((F.col("__at") - 1) / size)
    return numbered.where(F.col("__at") <= end).select(*batch.columns, unit.cast("bigint").alias(UNIT))

"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's id is hashed into one of ``SLOTS`` slots for good. Bytes and rows are added up by
slot, and only the map from slots to shards, a table of ``SLOTS`` rows with a version, decides
where a record goes. The first map deals slots, largest first, to the lightest shard, so
shards hold nearly equal bytes (law ``bytes``). Rebalancing edits a map: it moves as few slots
as level the shards and stores the outcome as the next version; records are not hashed anew.

A record without an id is hashed whole; repeated rows share a slot. A null size counts as 0. Columns
of the records may have any names; those that are named like a result are not kept.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatloom.llm.common import ROW, named, whole_row
from threatloom.session import new_folder

SLOTS = 4_096
SHARDS = 16


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Slot to (bytes, rows), for rows with ``vslot`` and ``size``; never more than ``slots`` entries."""
    rows = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    found = {row["vslot"]: (row["bytes"], row["rows"]) for row in rows}
    return {slot: found.get(slot, (0, 0)) for slot in range(slots)}


def first_map(loads: dict[int, tuple[int, int]], shards: int = SHARDS) -> dict[int, int]:
    """Slots, heaviest first, to the shard that is lightest so far."""
    heap, placed = [(0, shard) for shard in range(shards)], {}
    for slot in sorted(loads, key=lambda s: (-loads[s][0], s)):
        weight, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (weight + loads[slot][0], shard))
    return placed


def rebalanced(current: dict[int, int], loads: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The map edited for ``shards`` shards: slots leave shards that are gone or above the mean.

    A shard above the mean gives away its heaviest slots that fit into the surplus, so few
    slots move; each goes to the lightest shard, heaviest first. All other slots stay.
    """
    mean = sum(size for size, _ in loads.values()) / shards
    weight, moving, kept = [0] * shards, [], {}
    for slot in loads:
        shard = current.get(slot, shards)
        if shard < shards:
            kept[slot] = shard
            weight[shard] += loads[slot][0]
        else:
            moving.append(slot)
    for slot in sorted(kept, key=lambda s: (-loads[s][0], s)):
        if 0 < loads[slot][0] <= weight[kept[slot]] - mean:
            weight[kept.pop(slot)] -= loads[slot][0]
            moving.append(slot)
    moving.sort(key=lambda s: (-loads[s][0], s))
    heap = [(w, shard) for shard, w in enumerate(weight)]
    heapq.heapify(heap)
    for slot in moving:
        w, shard = heapq.heappop(heap)
        kept[slot] = shard
        heapq.heappush(heap, (w + loads[slot][0], shard))
    return kept


def store_map(spark: SparkSession, folder: str, version: int, slot_map: dict[int, int]) -> None:
    """Write one version of a map; a version that is there is not written again."""
    rows = spark.createDataFrame(sorted(slot_map.items()), "vslot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """The newest version of the map in a folder, or none."""
    try:
        return spark.read.parquet(folder).agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{folder}/version={version}")


RESULTS = ["shard", "slot", "vslot", "map_version"]


def sharded(
    records: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None, grown: int | None = None
) -> DataFrame:
    """``records`` (with ``doc_id`` and ``size``) with shard, slot, vslot and map_version.

    ``slot`` is the record's place in its shard, gapless from 0: the rows of the shard's
    earlier virtual slots come first, then those of its own by id. The folder's first version of
    the map is written if it is not there. With ``grown``, a number of shards, the map is read,
    edited for them and stored as the next version, and ``next_shard`` and ``next_version`` say
    where records go then.
    """
    spark = records.sparkSession
    doc_id = named(records, "doc_id")
    whole = F.xxhash64(*[named(records, c) for c in records.columns])
    key = F.when(doc_id.isNull(), F.pmod(whole, F.lit(slots)).cast("int")).otherwise(slot_of(doc_id, slots))
    hashed = records.select(
        whole_row(records).alias(ROW), doc_id.alias("doc_id"), whole.alias("rest"),
        F.coalesce(named(records, "size"), F.lit(0)).alias("size"), key.alias("vslot"),
    )
    loads = slot_loads(hashed, slots)
    folder = folder or new_folder(spark, "slot-map")
    if latest_version(spark, folder) is None:
        store_map(spark, folder, 1, first_map(loads, shards))
    version = latest_version(spark, folder)
    counted = spark.createDataFrame([(s, n) for s, (_, n) in loads.items()], "vslot int, rows bigint")
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    # SLOTS rows, whatever the input: safe to broadcast.
    begun = read_map(spark, folder, version).join(F.broadcast(counted), "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("begin")
    )
    added = []
    if grown is not None:
        current = {r["vslot"]: r["shard"] for r in read_map(spark, folder, version).collect()}
        store_map(spark, folder, version + 1, rebalanced(current, loads, grown))
        after = read_map(spark, folder, version + 1).withColumnRenamed("shard", "next_shard")
        begun = begun.join(F.broadcast(after), "vslot")
        added = ["next_shard", F.lit(version + 1).alias("next_version")]
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "rest")) - 1
    placed = hashed.join(F.broadcast(begun), "vslot").withColumn("slot", F.col("begin") + within.cast("bigint"))
    results = [*RESULTS, "next_shard", "next_version"] if added else RESULTS
    kept = [F.col(ROW).getField(c).alias(c) for c in records.columns if c not in results]
    return placed.select(*kept, "shard", "slot", "vslot", F.lit(version).alias("map_version"), *added)

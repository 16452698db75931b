"""Hard negatives by slots: the nearest rows of another label that are not too near.

For an anchor, every positive opens a window of scores: at most the positive's score (its upper
limit) and at least ``low_percent`` of it. The distinct upper limits, descending, part the scores
into disjoint slots: slot ``j`` holds what is at most limit ``j`` and more than limit ``j + 1``.
A row of another label lies in one slot, and the first ``negatives`` of a slot are all that any
window can take from it. Each task keeps those while it reads its rows, so that it sends at most
anchors x slots x ``negatives`` rows; the tasks' rows are merged by slot. The answer to a window is
the first ``negatives`` of its own slot and all lower ones, which one pass from the lowest slot
upwards gives for all windows, and of them those that reach the window's lower limit.

Anchors are the rows whose ``vec_id`` is divisible by ``every``. They meet all rows in blocks of
``BLOCK_VALUES`` components (one more for a row beyond it): a block is sent to the executors, which
read the rows where they lie. Anchors are dealt to blocks by a hash of the whole row, so that no id
fills one. There are as many scans as blocks; nothing is shuffled but what the tasks have kept.

A component counts as ``floor(scale * x)``, and a score is the exact integer inner product; a vector
that is shorter than the other counts as if filled up with zeros. Integers and scores beyond a long
are held at its limits.

Rows without ``vec_id`` can be neither named nor ordered and take no part, nor do rows without a
label or vector or with a component that is null or not finite. Repeated rows are rows each, as
positives and as negatives; equal anchors are one anchor, and rows with the anchor's ``vec_id`` are
the anchor itself. Equal scores are ordered by ``vec_id``. An empty table gives no rows. Columns
beside ``vec_id``, ``embedding`` and ``label`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import named, stored
from threatloom.session import new_folder

#: Components of the anchors of one block: 8 MB as 64-bit integers.
BLOCK_VALUES = 1_048_576
#: Scores that a task holds at once, and candidates that it keeps before it drops what is beaten.
TILE = 1_000_000
PENDING = 1_000_000
_MOST = 2**63 - 1
_EXACT = "decimal(20,0)"


def usable(vector: Column) -> Column:
    """True for a vector whose components are all there and finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return vector.isNotNull() & finite


def quantized(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, short rows filled up with zeros."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    full = np.zeros((len(sizes), width), dtype=np.int64)
    full[np.arange(width) < sizes[:, None]] = values
    return full


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both, within the limits of a long."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), dtype=np.int64)
    bound = width * float(np.abs(left.astype(float)).max()) * float(np.abs(right.astype(float)).max())
    if bound < 2**53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    if bound < 2**62:
        return left @ right.T
    return np.clip(left.astype(object) @ right.astype(object).T, -_MOST, _MOST).astype(np.int64)


class Best:
    """The first ``k`` of each group by descending score and ascending id, kept while rows come in."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.least = np.full(groups, -_MOST - 1, dtype=np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, group: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        open_ = score >= self.least[group]
        if open_.any():
            self.parts.append((group[open_], score[open_], key[open_]))
            self.pending += int(open_.sum())
            if self.pending > PENDING:
                self.kept()

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is kept, by group; candidates from now on have to reach a full group's last."""
        empty = np.empty(0, dtype=np.int64)
        group, score, key = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (empty,) * 3
        order = np.lexsort((key, -score, group))
        group, score, key = group[order], score[order], key[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        kept = place < self.k
        last = place == self.k - 1
        self.least[group[last]] = score[last]
        self.parts = [(group[kept], score[kept], key[kept])]
        self.pending = int(kept.sum())
        return self.parts[0]


def _tiles(batches, anchors: dict):
    """Scores of all anchors against the rows, a tile at a time: scores, ids, labels of the rows."""
    step = max(1, TILE // max(1, len(anchors["ids"])))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            rows = batch.slice(start, step)
            ids, labels = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            yield products(anchors["vectors"], matrix(rows.column("vector"))), ids, labels


def _positives(shared, k: int):
    """Arrow function: rows to the task's first ``k`` other rows of each anchor's label."""

    def run(batches):
        anchors = shared.value
        best = Best(len(anchors["ids"]), k)
        for scores, ids, labels in _tiles(batches, anchors):
            fits = (anchors["labels"][:, None] == labels) & (anchors["ids"][:, None] != ids)
            at, row = np.nonzero(fits & (scores >= best.least[:, None]))
            best.add(at, scores[at, row], ids[row])
        group, score, key = best.kept()
        yield pa.RecordBatch.from_arrays(
            [pa.array(group), pa.array(score), pa.array(key)], ["anchor", "positive_score", "positive_id"]
        )

    return run


def _slots(shared, k: int):
    """Arrow function: rows to the task's first ``k`` rows of another label in each anchor's slots.

    ``limits`` holds the anchors' distinct upper limits, descending and filled up with the least long.
    """

    def run(batches):
        anchors = shared.value
        limits, lowest = anchors["limits"], anchors["lowest"]
        slots = limits.shape[1]
        best = Best(len(limits) * slots, k)
        for scores, ids, labels in _tiles(batches, anchors):
            fits = anchors["labels"][:, None] != labels
            at, row = np.nonzero(fits & (scores <= limits[:, :1]) & (scores >= lowest[:, None]))
            score = scores[at, row]
            slot = (limits[at] >= score[:, None]).sum(axis=1) - 1
            best.add(at * slots + slot, score, ids[row])
        group, score, key = best.kept()
        yield pa.RecordBatch.from_arrays(
            [pa.array(group // slots), pa.array((group % slots).astype(np.int32)), pa.array(score), pa.array(key)],
            ["anchor", "slot", "score", "negative_id"],
        )

    return run


def _limits(positives: pa.Table, anchors: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct upper limits of each anchor's windows, and the least score that any of them takes."""
    columns = [positives.column(c).to_pylist() for c in ("anchor", "slot", "positive_score")]
    slots = max(columns[1], default=0) + 1
    limits = np.full((anchors, slots), -_MOST - 1, dtype=np.int64)
    lowest = np.full(anchors, _MOST, dtype=np.int64)
    for anchor, slot, score in zip(*columns):
        limits[anchor, slot] = score
        if score >= 0:  # a window below zero would end below its beginning
            lowest[anchor] = min(int(lowest[anchor]), -(-low * score // 100))
    return limits, lowest


def _merged_upwards(slots: Column, count: int, k: int) -> Column:
    """For each slot the first ``k`` rows of it and all lower ones; ``slots`` maps a slot to its rows."""
    kind = "array<struct<score:bigint,negative_id:bigint>>"
    none = F.array().cast(kind)

    def step(merged: Column, slot: Column) -> Column:
        own = F.coalesce(F.try_element_at(slots, slot), none)
        lower = F.coalesce(F.get(merged, F.lit(0)), none)
        return F.concat(F.array(F.slice(F.concat(own, lower), 1, k)), merged)

    downwards = F.array(*[F.lit(j) for j in reversed(range(count))])
    return F.aggregate(downwards, F.array().cast(f"array<{kind}>"), step)


def _mine_block(rows: DataFrame, block: DataFrame, positives: int, negatives: int, low: int) -> DataFrame:
    """Anchors of one block against all rows."""
    spark = rows.sparkSession
    found = block.toArrow()
    if not found.num_rows:
        return spark.createDataFrame([], _RESULT)
    anchors = {
        "ids": found.column("vec_id").to_numpy(),
        "labels": found.column("label").to_numpy(),
        "vectors": matrix(found.column("vector").combine_chunks()),
    }
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    by_limit = Window.partitionBy("anchor").orderBy(F.desc("positive_score"))
    chosen = stored(
        rows.mapInArrow(
            _positives(spark.sparkContext.broadcast(anchors), positives),
            "anchor bigint, positive_score bigint, positive_id bigint",
        )
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= positives)
        .withColumn("slot", (F.dense_rank().over(by_limit) - 1).cast("int")),
        "positives",
    )
    limits, lowest = _limits(chosen.toArrow(), len(anchors["ids"]), low)
    shared = spark.sparkContext.broadcast(anchors | {"limits": limits, "lowest": lowest})
    in_slot = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "negative_id")
    by_slot = (
        rows.mapInArrow(_slots(shared, negatives), "anchor bigint, slot int, score bigint, negative_id bigint")
        .withColumn("place", F.row_number().over(in_slot))
        .where(F.col("place") <= negatives)
        .groupBy("anchor", "slot")
        .agg(F.array_sort(F.collect_list(F.struct("place", "score", "negative_id"))).alias("found"))
        .withColumn("found", F.transform("found", lambda x: F.struct(x["score"], x["negative_id"])))
        .groupBy("anchor")
        .agg(F.map_from_entries(F.collect_list(F.struct("slot", "found"))).alias("slots"))
        .select("anchor", _merged_upwards(F.col("slots"), limits.shape[1], negatives).alias("merged"))
    )
    reaches = lambda x: F.col("positive_score").cast(_EXACT) * low <= x["score"].cast(_EXACT) * 100
    names = spark.createDataFrame(
        list(enumerate(anchors["ids"].tolist())), "anchor bigint, anchor_id bigint"
    )
    return (
        chosen.join(by_slot, "anchor")
        .join(names, "anchor")
        .select(
            "anchor_id", "positive_id", "positive_score",
            F.posexplode(F.filter(F.get("merged", F.col("slot")), reaches)).alias("place", "found"),
        )
        .select(
            "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"),
            F.col("found.negative_id").alias("negative_id"), "positive_score",
            F.col("found.score").alias("negative_score"),
        )
    )


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    An anchor's positives are its first ``positives`` other rows of the same label; for each, the
    first ``negatives`` rows of another label with ``low_percent * positive_score <= 100 *
    negative_score <= 100 * positive_score``.
    """
    rows = vectors.select(
        named(vectors, "vec_id").cast("bigint").alias("vec_id"),
        named(vectors, "label").cast("bigint").alias("label"),
        named(vectors, "embedding").alias("vector"),
    )
    rows = rows.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    ).withColumn("vector", quantized(F.col("vector"), scale))
    anchors = stored(
        rows.where(F.col("vec_id") % every == 0)
        .distinct()
        .withColumn("dealt", F.xxhash64("vec_id", "label", "vector")),
        "anchors",
    )
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    blocks = -(-size["n"] * max(1, size["width"] or 0) // BLOCK_VALUES)
    path = new_folder(vectors.sparkSession, "hard-negatives")
    for number in range(max(1, blocks)):
        block = anchors.where(F.pmod("dealt", F.lit(max(1, blocks))) == number)
        part = _mine_block(rows, block, positives, negatives, low_percent)
        part.write.mode("append").parquet(path)
    return vectors.sparkSession.read.schema(_RESULT).parquet(path)


_RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
)

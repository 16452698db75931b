"""A fitted forest as a table of nodes, and scores by joining rows with it tree by tree.

The table is what Spark saves of a forest: for each tree and node the feature and threshold of its
split and its children, or the class counts of a leaf. Any SQL engine can score with it, and it shows
which splits a verdict came from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from threatloom.operators.grown_forest import GrownForest
from threatloom.session import new_folder, shared_folder

#: Bytes that a block of rows, and its class shares in one tree, have at most about.
BLOCK_BYTES = 262_144
#: Blocks that meet one copy of a tree at most about; they lie in one group with it.
GROUP_BLOCKS = 256


def forest_nodes(spark: SparkSession, forest: GrownForest | RandomForestClassificationModel) -> DataFrame:
    """``tree``, ``node``, ``feature`` and ``threshold`` (null in leaves), ``left``, ``right``, ``shares``.

    A row whose feature is at most the threshold goes left. ``shares`` are the class shares of the
    training rows in a leaf, null in inner nodes.
    """
    if isinstance(forest, GrownForest):
        return forest.nodes(spark)
    path = new_folder(spark, "forest")
    forest.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    leaf = F.col("leftChild") < 0
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    return saved.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(~leaf, F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(~leaf, F.col("leftChild")).alias("left"),
        F.when(~leaf, F.col("rightChild")).alias("right"),
        F.when(leaf, F.transform("impurityStats", lambda n: n / total)).alias("shares"),
    )


def _packing(thresholds: list[np.ndarray], most: int):
    """Arrow function: rows to blocks of ``most`` rows: their keys, and per value the thresholds below it."""
    kind = np.min_scalar_type(max(map(len, thresholds), default=0))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(thresholds))
                ranks = np.empty(x.shape, dtype=kind)
                for i, cuts in enumerate(thresholds):
                    ranks[:, i] = np.searchsorted(cuts, x[:, i], side="left")
                keys = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column("key"))
                yield pa.RecordBatch.from_arrays([keys, pa.array([ranks.tobytes()], pa.binary())], ["keys", "ranks"])

    return run


def _walking(used: list[int], thresholds: list[np.ndarray], classes: int):
    """Arrow function: blocks of rows and the nodes of one tree to the class shares of the leaves they come to."""
    kind = np.min_scalar_type(max(map(len, thresholds), default=0))

    def run(blocks: pa.Table, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node").combine_chunks()
        ids = nodes.column("node").to_numpy()
        inner = nodes.column("left").is_valid().to_numpy(zero_copy_only=False)
        feature, cut, left, right = (np.zeros(len(ids), dtype=np.int64) for _ in range(4))
        parts = nodes.filter(pa.array(inner))
        feature[inner] = np.searchsorted(used, parts.column("feature").to_numpy())
        left[inner] = np.searchsorted(ids, parts.column("left").to_numpy())
        right[inner] = np.searchsorted(ids, parts.column("right").to_numpy())
        values = parts.column("threshold").to_numpy()
        for i, cuts in enumerate(thresholds):
            own = feature[inner] == i
            cut[np.flatnonzero(inner)[own]] = np.searchsorted(cuts, values[own])
        place = np.cumsum(~inner) - 1
        shares = nodes.filter(pa.array(~inner)).column("shares").combine_chunks().flatten()
        shares = shares.to_numpy(zero_copy_only=False).reshape(-1, classes)
        found = []
        for packed, rows in zip(blocks.column("ranks").to_pylist(), blocks.column("rows").to_pylist()):
            ranks = np.frombuffer(packed, dtype=kind).reshape(rows, len(thresholds))
            at, moving = np.full(rows, np.searchsorted(ids, 0)), np.arange(rows)
            while len(moving := moving[inner[at[moving]]]):
                here = at[moving]
                at[moving] = np.where(ranks[moving, feature[here]] <= cut[here], left[here], right[here])
            found.append(shares[place[at]].tobytes())
        return pa.table({"block": blocks.column("block"), "tree": blocks.column("tree"), "shares": pa.array(found, pa.binary())})

    return run


def _averaging(classes: int):
    """Arrow function: a block's class shares in all trees and its keys to their means."""

    def run(shares: pa.Table, block: pa.Table) -> pa.Table:
        total = np.zeros(classes * sum(block.column("rows").to_pylist()) if len(shares) else 0)
        for packed in shares.sort_by("tree").column("shares").to_pylist():
            total += np.frombuffer(packed, dtype=np.float64)
        mean = total / max(1, len(shares))
        offsets = pa.array(np.arange(0, len(mean) + 1, max(1, classes), dtype=np.int32))
        keys = block.column("keys").combine_chunks().flatten().slice(0, len(offsets) - 1)
        return pa.table({"key": keys, "mean": pa.ListArray.from_arrays(offsets, pa.array(mean))})

    return run


def walk_forest(rows: DataFrame, key: str, features: str, nodes: DataFrame) -> DataFrame:
    """Class probabilities of each row: the mean of the shares of the leaves it comes to, one per tree.

    Rows meet each tree once, in blocks that hold for each value how many of the thresholds of its feature lie
    below it, a byte or two. What is shuffled is these blocks and a block's class shares, once a tree, however
    deep the trees are. A group holds the nodes of one tree and about ``GROUP_BLOCKS`` blocks.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    facts = nodes.groupBy("feature").agg(
        F.sort_array(F.collect_set("threshold")).alias("cuts"), F.max(F.size("shares")).alias("classes"),
        F.collect_set("tree").alias("trees"),
    ).collect()
    trees = sorted({t for r in facts for t in r["trees"]})
    split = sorted((r for r in facts if r["feature"] is not None), key=lambda r: r["feature"])
    used, thresholds = [r["feature"] for r in split], [np.array(r["cuts"]) for r in split]
    classes = max((r["classes"] or 0 for r in facts), default=0)
    x = F.col(features) if isinstance(rows.schema[features].dataType, ArrayType) else vector_to_array(features)
    kind = rows.schema[key].dataType
    most = max(1, BLOCK_BYTES // max(1, 8 * classes, 2 * len(used)))
    compared = F.transform(F.lit(used).cast("array<int>"), lambda f: F.get("x", f).cast("double"))
    blocks = (
        rows.select(F.col(key).alias("key"), x.alias("x"))
        .select("key", compared.alias("x"))
        .mapInArrow(_packing(thresholds, most), StructType().add("keys", ArrayType(kind)).add("ranks", "binary"))
        .select(F.monotonically_increasing_id().alias("block"), F.size("keys").alias("rows"), "keys", "ranks")
        .checkpoint()
    )
    groups = max(1, -(-blocks.count() // GROUP_BLOCKS))
    dealt = blocks.select(
        "block", "rows", "ranks", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("grp"),
        F.explode(F.lit(trees).cast("array<int>")).alias("tree"),
    )
    copied = nodes.select(
        "tree", "node", "feature", "threshold", "left", "right", "shares",
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
    )
    walked = dealt.groupBy("tree", "grp").cogroup(copied.groupBy("tree", "grp")).applyInArrow(
        _walking(used, thresholds, classes), "block bigint, tree int, shares binary"
    )
    reached = (
        walked.groupBy("block")
        .cogroup(blocks.select("block", "rows", "keys").groupBy("block"))
        .applyInArrow(_averaging(classes), StructType().add("key", kind).add("mean", ArrayType(DoubleType())))
        .select(F.col("key").alias(key), F.posexplode("mean").alias("class", "share"))
    )
    by_class = reached.groupBy(key, "class").agg(F.avg("share").alias("probability"))
    return by_class.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "probability"))), lambda s: s["probability"]).alias(
            "probabilities"
        )
    )

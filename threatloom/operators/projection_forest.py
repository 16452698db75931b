"""Approximate nearest neighbours by a forest of random-projection trees.

A tree cuts a group of rows in two at the median of their projections on a random direction,
and again, until a leaf has at most ``leaf_rows`` rows. Rows are compared within their leaf
only, and the k best over all trees are kept, so a row meets at most ``trees * leaf_rows``
others whatever the size of the table. Neighbours' neighbours are tried afterwards, which
finds most of what the cuts parted.

Trees grow in rounds. Each round samples at most about ``SAMPLE_ROWS`` rows of every node that
is too large, fits the cuts of up to ``ROUND_LEVELS`` levels on them, and lets all rows of the
node go down these levels. Rows carry their projections, not their vectors; a cut compares the
projection and then a hash of the id, so equal rows are parted as well as any others.

The rows of different groups never meet: ``group`` names a column, or none for all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.operators.joins import checked_broadcast
from threatloom.session import shared_folder

TREES = 12
LEAF_ROWS = 256
REFINEMENTS = 1
SAMPLE_ROWS = 8_192
ROUND_LEVELS = 6
MAX_LEVELS = 32
#: Rounds after which equal ids, which nothing can part, are left together.
MAX_ROUNDS = 12
#: Differences held at once while a leaf is searched.
TILE_VALUES = 4_000_000
_NODE = ["grp", "tree", "node"]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _projecting(directions: np.ndarray):
    """Arrow function: vectors to their projections, a row for each tree."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            for tree, axes in enumerate(directions):
                values = (x @ axes.T).astype(np.float32)
                flat = pa.ListArray.from_arrays(
                    np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel()
                )
                columns = [*(batch.column(c) for c in ("id", "grp", "tie")), pa.array([tree] * len(x), pa.int32()), flat]
                yield pa.RecordBatch.from_arrays(columns, ["id", "grp", "tie", "tree", "values"])

    return run


def _fitting(leaf_rows: int):
    """Arrow function: the sample of one node to the cuts of its next levels, in heap order."""

    def fit(group: pa.Table) -> pa.Table:
        values, ties = _matrix(group.column("values")), group.column("tie").to_numpy()
        level, size = group.column("level")[0].as_py(), group.column("n")[0].as_py()
        depth = min(ROUND_LEVELS, max(1, math.ceil(math.log2(size / leaf_rows))))
        cuts, parts = [], [np.arange(len(ties))]
        for step in range(depth):
            column = values[:, (level + step) % values.shape[1]]
            halves = []
            for part in parts:
                order = part[np.lexsort((ties[part], column[part]))]
                middle = len(order) // 2
                at = order[max(0, middle - 1)] if len(order) else None
                # The last row of the left half; without rows the cut is anywhere.
                cuts.append({"value": float(column[at]), "tie": int(ties[at])} if at is not None else {"value": 0.0, "tie": 0})
                halves += [order[:middle], order[middle:]]
            parts = halves
        head = {c: group.column(c).slice(0, 1) for c in _NODE}
        kind = pa.list_(pa.struct([("value", pa.float32()), ("tie", pa.int64())]))
        return pa.table({**head, "depth": pa.array([depth], pa.int32()), "cuts": pa.array([cuts], kind)})

    return fit


def _descended(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with the node that the cuts lead them to; nodes without cuts keep theirs."""
    known = cuts.select(*[F.col(c).alias(f"cut_{c}") for c in _NODE], "depth", "cuts")
    same = F.lit(True)
    for c in _NODE:
        same &= F.col(c).eqNullSafe(F.col(f"cut_{c}"))
    joined = rows.join(checked_broadcast(known), same, "left")

    def step(place: Column, level: Column) -> Column:
        own = F.get("values", ((F.col("level") + level) % F.size("values")).cast("int"))
        cut = F.get("cuts", (place - 1).cast("int"))
        right = (own > cut["value"]) | ((own == cut["value"]) & (F.col("tie") > cut["tie"]))
        return place * 2 + right.cast("bigint")

    place = F.aggregate(F.sequence(F.lit(0), F.col("depth") - 1), F.lit(1).cast("bigint"), step)
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("depth"))
    node = F.when(F.col("depth").isNull(), F.col("node")).otherwise(F.col("node") * width + place - width)
    level = F.col("level") + F.coalesce("depth", F.lit(0))
    return joined.select("id", "grp", "tie", "tree", "values", node.alias("node"), level.alias("level"))


def _leaves(points: DataFrame, trees: int, leaf_rows: int, width: int, rows: int, seed: int) -> DataFrame:
    """id and leaf (grp, tree, node) of every row in every tree."""
    levels = min(MAX_LEVELS, max(1, math.ceil(math.log2(max(2, rows / leaf_rows))) + 2))
    directions = np.random.default_rng(seed).standard_normal((trees, levels, width))
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    current = (
        points.withColumn("tie", F.xxhash64(F.lit(seed), "id"))
        .mapInArrow(
            _projecting(directions), f"id {kinds['id']}, grp {kinds['grp']}, tie bigint, tree int, values array<float>"
        )
        .withColumns({"node": F.lit(1).cast("bigint"), "level": F.lit(0)})
        .checkpoint()
    )
    for _ in range(MAX_ROUNDS):
        large = current.groupBy(*_NODE).agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows).checkpoint()
        if not large.take(1):
            break
        sizes = large.select(*[F.col(c).alias(f"large_{c}") for c in _NODE], "n")
        same = F.lit(True)
        for c in _NODE:
            same &= F.col(c).eqNullSafe(F.col(f"large_{c}"))
        share = F.pmod(F.xxhash64(F.lit(seed + 1), "id", "tree"), F.lit(1 << 40)) / float(1 << 40)
        cuts = (
            current.join(checked_broadcast(sizes), same)
            .where(share * F.col("n") < SAMPLE_ROWS)
            .groupBy(*_NODE)
            .applyInArrow(
                _fitting(leaf_rows),
                f"grp {kinds['grp']}, tree int, node bigint, depth int, cuts array<struct<value:float,tie:bigint>>",
            )
            .checkpoint()
        )
        current = _descended(current, cuts).checkpoint()
    return current.select("id", *_NODE)


def _searching(k: int):
    """Arrow function: the rows of one leaf to the k nearest others of each."""

    def search(group: pa.Table) -> pa.Table:
        ids, x = group.column("id").combine_chunks(), _matrix(group.column("vector"))
        codes = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        most = min(k, len(x) - 1)
        own, other, distances = [], [], []
        step = max(1, TILE_VALUES // max(1, x.size))
        for start in range(0, len(x), step) if most > 0 else ():
            part = np.arange(start, min(start + step, len(x)))
            delta = x[part, None, :] - x[None, :, :]
            distance = np.sqrt(np.einsum("ijk,ijk->ij", delta, delta))
            distance[codes[part, None] == codes[None, :]] = np.inf
            best = np.argpartition(distance, most - 1, axis=1)[:, :most]
            found = np.take_along_axis(distance, best, axis=1)
            there = np.isfinite(found)
            own.append(np.repeat(part, there.sum(axis=1)))
            other.append(best[there])
            distances.append(found[there])
        take = lambda parts: ids.take(pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))
        found = np.concatenate(distances) if distances else np.empty(0)
        return pa.table({"id": take(own), "neighbour": take(other), "distance": found})

    return search


def _first(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    unique = pairs.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
    return unique.withColumn("rank", rank).where(F.col("rank") <= k)


def _refined(edges: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """The k best of each row's neighbours and their neighbours."""
    further = edges.select(F.col("id").alias("neighbour"), F.col("neighbour").alias("next"))
    pairs = (
        edges.join(further, "neighbour")
        .where(F.col("next") != F.col("id"))
        .select("id", F.col("next").alias("neighbour"))
        .distinct()
        .join(edges.select("id", "neighbour"), ["id", "neighbour"], "left_anti")
    )
    here = points.select("id", F.col("vector").alias("x"))
    there = points.select(F.col("id").alias("neighbour"), F.col("vector").alias("y"))
    squares = F.zip_with("x", "y", lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, v: total + v))
    measured = pairs.join(there, "neighbour").join(here, "id").select("id", "neighbour", distance.alias("distance"))
    return _first(edges.select("id", "neighbour", "distance").unionByName(measured), k)


def forest_neighbours(
    points: DataFrame,
    id: str,
    vector: str,
    k: int = 5,
    group: str | None = None,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    refinements: int = REFINEMENTS,
    seed: int = 7,
) -> DataFrame:
    """About the k nearest other rows of each row in its group: ``id``, ``neighbour``, ``distance``, ``rank``.

    Distances are exact; what may be missing is a neighbour. Ids are unique and vectors equally long.
    """
    shared_folder(points.sparkSession)
    rows = points.select(
        F.col(id).alias("id"),
        (F.col(group) if group else F.lit(0)).alias("grp"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).checkpoint()
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = f"id {kinds['id']}, neighbour {kinds['id']}, distance double"
    leaves = _leaves(rows, trees, max(leaf_rows, k + 1), size["width"] or 1, size["n"], seed)
    searched = (
        leaves.join(rows.select("id", "vector"), "id").groupBy(*_NODE).applyInArrow(_searching(k), found)
    )
    edges = _first(searched, k).checkpoint()
    for _ in range(refinements):
        edges = _refined(edges, rows, k).checkpoint()
    return edges.select(F.col("id").alias(id), "neighbour", "distance", "rank")

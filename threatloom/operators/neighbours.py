"""Exact nearest neighbours of every row among all rows, and minority oversampling.

Rows are assigned to the nearest of a bounded number of pivots, and each pivot's rows
are cut into cells of bounded size. Each row first finds its neighbours in its own
cell; the distance of the k-th bounds how far any better neighbour can be. The
triangle inequality then tells which other cells can hold one. Cells are packed, and a row
is sent to the packs with such cells only. Rows are compared as products of matrix blocks,
which leave out what is surely too far; what is left is measured exactly. Pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.operators.joins import checked_broadcast
from threatloom.operators.projection_forest import forest_neighbours
from threatloom.operators.ranking import row_numbers
from threatloom.session import shared_folder

MAX_PIVOTS = 256
CELL_ROWS = 4096
#: Rows of a pack of cells, and queries to it that meet one copy of it, at most about. Both lie in one task.
PACK_ROWS = 32_768
#: Packs that fewer rows are cut into, so that there is work for many tasks.
LEAST_PACKS = 8
#: Queries and rows whose products are held at once, and pairs that are measured at once.
TILE_QUERIES, TILE_ROWS, MEASURED = 256, 2_048, 65_536


def _matrix(column: pd.Series) -> np.ndarray:
    return np.asarray(column.tolist(), dtype=np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two matrices, difference by difference.

    The shorter product form loses digits for close rows, which would spoil the bound.
    """
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        delta = b - row
        out[i] = np.sqrt(np.einsum("ij,ij->i", delta, delta))
    return out


def _nearest(
    queries: np.ndarray, query_ids: np.ndarray, cell: np.ndarray, cell_ids: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its up to k nearest other rows of the cell: positions and distances."""
    for i in range(len(queries)):
        delta = cell - queries[i]
        distance = np.sqrt(np.einsum("ij,ij->i", delta, delta))
        distance[cell_ids == query_ids[i]] = np.inf
        take = min(k, len(distance) - int(np.isinf(distance).sum()))
        best = np.argpartition(distance, take - 1)[:take] if take else np.empty(0, int)
        yield i, best, distance[best]


def _vectors(group: pa.Table) -> np.ndarray:
    column = group.column("vector").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _codes(queries: pa.ChunkedArray, ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where ids are; a null id equals none."""
    both = pa.chunked_array([*queries.chunks, *ids.chunks], queries.type).combine_chunks().dictionary_encode().indices
    codes = both.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    left, right = codes[: len(queries)], codes[len(queries) :]
    return left, np.where(right < 0, -2, right)


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.einsum("ij,ij->i", x, x)


def _closest(
    x: np.ndarray,
    codes: np.ndarray,
    limit: np.ndarray,
    y: np.ndarray,
    y_codes: np.ndarray,
    cells: Iterator[tuple[np.ndarray, np.ndarray]],
    k: int,
    best: np.ndarray,
) -> np.ndarray:
    """Positions in ``y`` of the up to k nearest other rows of each row of ``x`` that are nearer than ``limit``; -1 for none.

    ``cells`` gives rows of ``x`` and rows of ``y`` to compare; ``best`` (rows x k, infinite at first) takes the distances.
    A product of blocks gives the squared distances up to rounding. Pairs within a margin above that rounding
    are measured difference by difference, so the distances are those of a plain comparison.
    """
    width = x.shape[1]
    found = np.full(best.shape, -1, dtype=np.int64)
    lengths, y_lengths = _lengths(x), _lengths(y)
    rounding = 16 * (width + 8) * np.finfo(np.float64).eps
    for wanted, held in cells:
        shared = bool(np.isin(y_codes[held], codes[wanted]).any())
        for start in range(0, len(held), TILE_ROWS):
            part = held[start : start + TILE_ROWS]
            other, most = y[part], y_lengths[part].max()
            product = np.column_stack([other, y_lengths[part]]).T
            for first in range(0, len(wanted), TILE_QUERIES):
                rows = wanted[first : first + TILE_QUERIES]
                reach = np.minimum(limit[rows], best[rows, -1])
                rows, reach = rows[reach > 0], reach[reach > 0]
                if not len(rows):
                    continue
                score = np.column_stack([-2 * x[rows], np.ones(len(rows))]) @ product
                if shared:
                    score[codes[rows][:, None] == y_codes[part][None, :]] = np.inf
                margin = rounding * (lengths[rows] + most)
                upto = reach**2 - lengths[rows] + margin
                free = np.flatnonzero(np.isinf(reach))
                if len(free) and len(part) >= k:
                    upto[free] = np.partition(score[free], k - 1, axis=1)[:, k - 1] + 2 * margin[free]
                np.minimum(upto, np.finfo(np.float64).max, out=upto)  # rows with the query's id are at infinity
                i, j = np.divmod(np.flatnonzero(score <= upto[:, None]), len(part))
                distance = np.empty(len(i))
                for at in range(0, len(i), MEASURED):
                    some = slice(at, at + MEASURED)
                    delta = other[j[some]] - x[rows[i[some]]]
                    distance[some] = np.sqrt(np.einsum("ij,ij->i", delta, delta))
                near = distance < reach[i]
                i, j, distance = i[near], j[near], distance[near]
                if not len(i):
                    continue
                touched = np.unique(i)
                row = np.concatenate([i, np.repeat(touched, k)])
                distance = np.concatenate([distance, best[rows[touched]].ravel()])
                place = np.concatenate([part[j], found[rows[touched]].ravel()])
                order = np.lexsort((distance, row))
                row, distance, place = row[order], distance[order], place[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                top = rank < k
                best[rows[row[top]], rank[top]] = distance[top]
                found[rows[row[top]], rank[top]] = place[top]
    return found


def _neighbours(
    left: pa.Table, right: pa.Table, id: str, k: int, limit: np.ndarray, cells: Iterator[tuple[np.ndarray, np.ndarray]]
) -> pa.Table:
    """Rows of the left table with their up to k nearest other rows of the right one, by pairs of parts of both."""
    x, y = _vectors(left), _vectors(right)
    if np.isfinite(_lengths(x)).all() and np.isfinite(_lengths(y)).all():
        best = np.full((len(x), k), np.inf)
        codes, y_codes = _codes(left.column(id), right.column(id))
        found = _closest(x, codes, limit, y, y_codes, cells, k, best)
        i, rank = np.nonzero(found >= 0)
        at, distance = found[i, rank], best[i, rank]
    else:  # values without a product: row by row
        ids, y_ids = left.column(id).to_numpy(), right.column(id).to_numpy()
        parts = []
        for wanted, held in cells:
            for n, own, distances in _nearest(x[wanted], ids[wanted], y[held], y_ids[held], k):
                parts.append((np.full(len(own), wanted[n]), held[own], distances))
        i, at, distance = (np.concatenate([p[n] for p in parts]) if parts else np.empty(0, int) for n in range(3))
    return pa.table(
        [left.column(id).take(pa.array(i)), right.column(id).take(pa.array(at)), pa.array(distance, pa.float64())],
        names=[id, "neighbour", "distance"],
    )


def _pivots(points: DataFrame, vector: str, id: str, count: int) -> np.ndarray:
    """Rows that lead in hash order: a bounded number, at random but the same on every run."""
    rows = (
        points.select(vector, F.xxhash64(F.lit(7), F.col(id)).alias("__h"), id)
        .orderBy("__h", id)
        .limit(count)
        .collect()
    )
    return np.unique(np.asarray([r[vector] for r in rows], dtype=np.float64), axis=0)


def assign_cells(
    points: DataFrame, id: str, vector: str, pivots: np.ndarray, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Add ``pivot``, the distance ``to_pivot`` and the cell number ``part`` within the pivot.

    A pivot with many rows (a third of all, say) is cut into as many parts as it needs.
    """
    schema = (
        f"{id} {points.schema[id].dataType.simpleString()}, vector array<double>, "
        "pivot int, to_pivot double"
    )

    def nearest_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["vector"])
                d = _distances(x, pivots)
                best = d.argmin(axis=1)
                yield pd.DataFrame(
                    {
                        id: batch[id],
                        "vector": list(x),
                        "pivot": best.astype(np.int32),
                        "to_pivot": d[np.arange(len(x)), best],
                    }
                )

    tagged = points.select(id, F.col(vector).cast("array<double>").alias("vector")).mapInPandas(
        nearest_pivot, schema
    )
    sizes = tagged.groupBy(F.col("pivot").alias("__pivot")).agg(
        F.ceil(F.count("*") / cell_rows).alias("__parts")
    )
    # One row per pivot: bounded by MAX_PIVOTS.
    return (
        tagged.join(F.broadcast(sizes), F.col("pivot") == F.col("__pivot"))
        .withColumn("part", F.pmod(F.xxhash64(F.lit(11), F.col(id)), F.col("__parts")).cast("int"))
        .drop("__pivot", "__parts")
    )


def nearest_neighbours(
    points: DataFrame,
    id: str,
    vector: str,
    k: int = 5,
    max_pivots: int = MAX_PIVOTS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The k nearest other rows of each row: ``id``, ``neighbour``, ``distance``, ``rank``."""
    shared_folder(points.sparkSession)
    count = points.count()
    pivots = _pivots(points, vector, id, max(1, min(max_pivots, count // max(1, cell_rows // 4))))
    id_type = points.schema[id].dataType.simpleString()
    # Two jobs read the cells below; the checkpoint keeps them from computing them twice.
    cells = assign_cells(points, id, vector, pivots, cell_rows).checkpoint()
    found = f"{id} {id_type}, neighbour {id_type}, distance double"

    def within(group: pa.Table) -> pa.Table:
        every = np.arange(group.num_rows)
        return _neighbours(group, group, id, k, np.full(len(every), np.inf), [(every, every)])

    own = cells.select(id, "vector", "pivot", "part").groupBy("pivot", "part").applyInArrow(within, found)
    first = _best(own, id, k).checkpoint()
    bounds = first.groupBy(id).agg(
        F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("bound")
    )
    # One row per pivot: the range of distances of its rows, their number, and its number of cells.
    rings = (
        cells.groupBy("pivot")
        .agg(
            F.min("to_pivot").alias("low"),
            F.max("to_pivot").alias("high"),
            (F.max("part") + 1).alias("parts"),
            F.count("*").alias("n"),
        )
        .orderBy("pivot")
        .toPandas()
    )
    if rings["parts"].sum() <= 1:
        return first

    pivot_of, parts_of = rings["pivot"].to_numpy(), rings["parts"].to_numpy()
    low, high = rings["low"].to_numpy(), rings["high"].to_numpy()
    centres = pivots[pivot_of]
    slack = 1e-9
    packed = _packs(rings, max(cell_rows, min(PACK_ROWS, -(-count // LEAST_PACKS))))
    packs = 1 + packed[-1][2]
    member = np.zeros((len(rings), packs), dtype=np.float32)
    member[np.searchsorted(pivot_of, [p for p, _, _ in packed]), [n for _, _, n in packed]] = 1

    def may_hold(x: np.ndarray, bound: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Whether a row of a pivot may be strictly nearer than the k-th found so far, with room for rounding."""
        to_pivots = _distances(x, centres[rows])
        least = np.maximum(np.maximum(to_pivots - high[rows], low[rows] - to_pivots), 0.0)
        return (least < bound[:, None] * (1 + slack)) & (bound[:, None] > 0)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["vector"])
            near = may_hold(x, batch["bound"].to_numpy())
            # A pivot with one cell holds nothing for the rows of that cell.
            home = np.searchsorted(pivot_of, batch["pivot"].to_numpy())
            near[np.arange(len(x)), home] &= parts_of[home] > 1
            targets = near.astype(np.float32) @ member > 0
            yield pd.DataFrame(
                {
                    id: batch[id],
                    "vector": list(x),
                    "pivot": batch["pivot"],
                    "part": batch["part"],
                    "bound": batch["bound"],
                    "targets": [np.flatnonzero(row).astype(np.int32) for row in targets],
                }
            )

    # The queries to a pack are counted before they are sent; the checkpoint keeps both from routing anew.
    routed = (
        cells.join(bounds, id, "left")
        .na.fill({"bound": float("inf")})
        .mapInPandas(
            route, f"{id} {id_type}, vector array<double>, pivot int, part int, bound double, targets array<int>"
        )
        .checkpoint()
    )
    asked = routed.select(F.explode("targets").alias("pack")).groupBy("pack").count().collect()
    if not asked:
        return first
    session = cells.sparkSession
    # One row per pack, and one per cell: both are rows by the thousand.
    slices = session.createDataFrame([(r["pack"], -(-r["count"] // PACK_ROWS)) for r in asked], "pack int, slices int")
    places = session.createDataFrame(packed, "pivot int, part int, pack int")

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column(id).slice(0, 0)] * 2 + [pa.array([], pa.float64())], names=[id, "neighbour", "distance"])
        limit = left.column("bound").to_numpy()
        own = [left.column(c).to_numpy() for c in ("pivot", "part")]
        there = [right.column(c).to_numpy() for c in ("pivot", "part")]
        rings_here = np.searchsorted(pivot_of, np.unique(there[0]))
        near = may_hold(_vectors(left), limit, rings_here)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for n, ring in enumerate(rings_here):
                for part in np.unique(there[1][there[0] == pivot_of[ring]]):
                    # Every cell of a pivot that is near enough, but the row's own.
                    wanted = near[:, n] & ((own[0] != pivot_of[ring]) | (own[1] != part))
                    held = (there[0] == pivot_of[ring]) & (there[1] == part)
                    yield np.flatnonzero(wanted), np.flatnonzero(held)

        return _neighbours(left, right, id, k, limit, pairs())

    # Queries to one pack are cut into slices, each of which meets a copy of the pack.
    sliced = (
        routed.withColumn("pack", F.explode("targets"))
        .join(F.broadcast(slices), "pack")
        .withColumn("slice", F.pmod(F.xxhash64(F.lit(13), F.col(id), "pivot", "part"), F.col("slices")).cast("int"))
    )
    copies = (
        cells.join(F.broadcast(places), ["pivot", "part"])
        .join(F.broadcast(slices), "pack")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    )
    more = (
        sliced.select(id, "vector", "pivot", "part", "bound", "pack", "slice")
        .groupBy("pack", "slice")
        .cogroup(copies.select(id, "vector", "pivot", "part", "pack", "slice").groupBy("pack", "slice"))
        .applyInArrow(across, found)
    )
    return _best(first.select(id, "neighbour", "distance").unionByName(more), id, k)


def _packs(rings: pd.DataFrame, rows: int) -> list[tuple[int, int, int]]:
    """(pivot, part, pack) of every cell: cells in order, as many to a pack as ``rows`` allows."""
    packed, pack, held = [], 0, 0.0
    for pivot, parts, n in rings[["pivot", "parts", "n"]].itertuples(index=False):
        for part in range(parts):
            if held and held + n / parts > rows:
                pack, held = pack + 1, 0.0
            packed.append((int(pivot), part, pack))
            held += n / parts
    return packed


def _best(found: DataFrame, id: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(id).orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _between(
    points: DataFrame, id: str, vector: str, label: str, neighbours: DataFrame, wanted: DataFrame, seed: int
) -> DataFrame:
    """New vectors between a row and one of its neighbours: as many for a label as ``wanted`` says.

    ``wanted`` has the label, its number of rows ``n`` and the number ``needed``. Every row is the
    base of an equal number of new ones, and the first rows of a label in hash order of one more.
    The neighbour and the place between both come from hashes, so a task that runs again gives the
    same rows.
    """
    by_rank = neighbours.groupBy(id).agg(
        F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("near")
    )
    order = F.xxhash64(F.lit(seed), F.col(id))
    sizes = wanted.select(F.col(label).alias("__label"), "n", "needed")
    each = F.floor(F.col("needed") / F.col("n"))
    copies = each + (F.col("__at") <= F.col("needed") - each * F.col("n")).cast("int")
    bases = (
        row_numbers(points, [label], order, "__at", ties=[id])
        .join(checked_broadcast(sizes), F.col(label).eqNullSafe(F.col("__label")))
        .withColumn("__copies", copies)
        .where("__copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
        .join(by_rank, id)
    )

    def draw(salt: int):
        return F.xxhash64(F.lit(seed), F.lit(salt), F.col(id), F.col("copy"))

    picked = bases.withColumn(
        "neighbour", F.col("near")[F.pmod(draw(1), F.size("near")).cast("int")]["neighbour"]
    ).withColumn("gap", F.pmod(draw(2), F.lit(1 << 30)) / float(1 << 30))
    others = points.select(F.col(id).alias("neighbour"), F.col(vector).alias("__near_vector"))
    between = F.zip_with(
        vector, "__near_vector", lambda a, b: a + F.col("gap") * (b - a)
    )
    return picked.join(others, "neighbour").select(
        F.col(id).alias("base"), "neighbour", "copy", "gap", label, between.alias(vector)
    )


def synthetic_minority(
    minority: DataFrame, id: str, vector: str, needed: int, k: int = 5, seed: int = 42
) -> DataFrame:
    """``needed`` new vectors between a minority row and one of its k nearest minority rows, searched exactly."""
    size = minority.count()
    if size < 2:
        raise ValueError("oversampling needs at least two minority rows")
    points = minority.select(id, F.col(vector).cast("array<double>").alias("vector"), F.lit(0).alias("__class"))
    neighbours = nearest_neighbours(points, id, "vector", k)
    wanted = points.sparkSession.createDataFrame([(0, size, needed)], "__class int, n bigint, needed bigint")
    return (
        _between(points, id, "vector", "__class", neighbours, wanted, seed)
        .drop("__class")
        .withColumnRenamed("vector", vector)
    )


def balance_classes(
    df: DataFrame, id: str, vector: str, label: str, k: int = 5, seed: int = 42, exact: bool = False
) -> DataFrame:
    """All rows plus synthetic ones, so that each class is as large as the largest.

    All classes are searched and filled in the same jobs. Neighbours come from a forest of
    random-projection trees, whose work grows with the rows; ``exact`` compares the rows of each
    class by pivots instead, class by class.
    """
    rows = df.select(F.col(id), F.col(vector).cast("array<double>").alias(vector), label)
    shared_folder(df.sparkSession)
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).checkpoint()
    largest = counts.agg(F.max("n")).first()[0] or 0
    wanted = counts.where(F.col("n") < largest).withColumn("needed", F.lit(largest) - F.col("n"))
    if wanted.where("n < 2").take(1):
        raise ValueError("oversampling needs at least two minority rows")
    small = wanted.select(F.col(label).alias("__label"))
    points = rows.join(
        checked_broadcast(small), F.col(label).eqNullSafe(F.col("__label")), "left_semi"
    ).checkpoint()
    if exact:
        labels = [r[0] for r in small.collect()]
        parts = [nearest_neighbours(points.where(F.col(label).eqNullSafe(F.lit(v))), id, vector, k) for v in labels]
        found = reduce(DataFrame.unionByName, parts) if parts else None
    else:
        found = forest_neighbours(points, id, vector, k, label)
    kept = rows.select(vector, label, F.lit(False).alias("synthetic"))
    if found is None:
        return kept
    new = _between(points, id, vector, label, found, wanted, seed)
    return kept.unionByName(new.select(vector, label, F.lit(True).alias("synthetic")))

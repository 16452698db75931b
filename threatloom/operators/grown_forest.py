"""Random forests whose growth is dealt over the cluster by tree and node.

Rows are held as one byte per feature, the interval between the thresholds it lies in. Thresholds part the values
of all rows, which meet feature by feature. A tree's upper nodes,
those with more than ``GROUP_ROWS`` rows, are split level by level from counts that every task makes of
its own rows; the counts of a node meet in one group. Below them each node's rows meet in one
group of bounded size, which grows the rest of the tree at once. So the passes over all rows are as many
as the upper levels, not as the nodes, and no task or group holds all rows.

As in other forests, every tree has its own bootstrap of the rows (a Poisson weight from a hash of row
and tree), every node tries the square root of the features, splits minimise the Gini impurity,
and a node is a leaf if it is pure, at the last level, or none of the tried features parts its rows.

A fitted tree is four flat arrays, six to seven bytes a node. The driver holds these arrays only; rows are scored by
walking them where the rows lie, so streams are scored as tables are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from threatloom.session import shared_folder

MAX_BINS = 32
#: Weighted rows of a node from which on it is split by counts of all tasks.
GROUP_ROWS = 16_384
#: Bytes of counts that one task holds in a pass.
COUNT_BYTES = 64_000_000
#: Bytes of trees that one result or task carries at most about.
RESULT_BYTES = 16_000_000
_OPEN = -1
_TREE = "tree int, feature binary, cut binary, child binary, shares binary"


def _cuts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """The increasing values that part distinct values and their counts into at most ``bins`` intervals."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < bins:
        return middles
    upto = np.cumsum(counts)[:-1]
    wanted = counts.sum() * np.arange(1, bins) / bins
    return middles[np.unique(np.minimum(np.searchsorted(upto, wanted), len(middles) - 1))]


def _thresholds(rows: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature the increasing values that part its values into at most ``bins`` intervals."""
    return [_cuts(*np.unique(column, return_counts=True), bins) for column in rows.T]


def _valued(width: int):
    """Arrow function: rows to each feature's distinct values and how often they are there, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                found = [np.unique(column, return_counts=True) for column in x.T]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(width), pa.int32()), pa.array([v.tobytes() for v, _ in found], pa.binary()),
                        pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary()),
                    ],
                    ["feature", "found", "counts"],
                )

    return run


def _cutting(bins: int):
    """Arrow function: the values and counts of one feature to its thresholds."""

    def run(group: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(v, np.float64) for v in group.column("found").to_pylist()])
        counts = np.concatenate([np.frombuffer(n, np.int32) for n in group.column("counts").to_pylist()])
        values, place = np.unique(values, return_inverse=True)
        cuts = _cuts(values, np.bincount(place, counts), bins)
        return pa.table({"feature": group.column("feature").slice(0, 1), "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64()))})

    return run


def _all_thresholds(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """``_thresholds`` of all rows; a group holds the values of one feature."""
    valued = rows.select("x").mapInArrow(_valued(width), "feature int, found binary, counts binary")
    found = valued.groupBy("feature").applyInArrow(_cutting(bins), "feature int, cuts array<double>").collect()
    return [np.array(r["cuts"], dtype=np.float64) for r in sorted(found, key=lambda r: r["feature"])]


def _binned(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """A value is in bin b or an earlier one if it is at most threshold b."""
    bins = np.empty(x.shape, dtype=np.uint8)
    for i, cuts in enumerate(thresholds):
        bins[:, i] = np.searchsorted(cuts, x[:, i], side="left")
    return bins


@lru_cache(maxsize=1)
def _poisson() -> np.ndarray:
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers from any (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree's bootstrap."""
    salt = _mixed(np.array([seed * 1_000_003 + tree + 1], dtype=np.uint64))
    draws = _mixed(_mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ salt)
    return np.searchsorted(_poisson(), (draws >> np.uint64(11)) / float(1 << 53), side="right")


def _walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node without children that each row comes to."""
    node = np.zeros(len(bins), dtype=np.int32)
    moving = np.arange(len(bins))
    while True:
        at = node[moving]
        left = child[at]
        inner = left >= 0
        if not inner.all():
            moving, at, left = moving[inner], at[inner], left[inner]
        if not len(moving):
            return node
        node[moving] = left + (bins[moving, feature[at]] > cut[at])


def _impurity_sums(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What a split is to have most of: the squared class counts over the rows, on both sides."""
    right = total - left
    n_left, n_right = left.sum(-1), right.sum(-1)
    there = (n_left > 0) & (n_right > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left * left).sum(-1) / n_left + (right * right).sum(-1) / n_right
    return np.where(there, score, -np.inf)


def _grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, tried: int, depth: int, rng) -> dict:
    """The whole tree of a group of rows: ``feature``, ``cut``, ``child``, ``shares`` and gain by feature.

    ``child`` is the left child, the right one is next to it; in a leaf it is -2 - class if the leaf is
    pure, and else -2 - classes - the row of ``shares`` with its class shares.
    """
    width = bins.shape[1]
    features, cuts, children, shares = [], [], [], []
    gains = np.zeros(width)
    rows, seg, nodes, end = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), 1, 1
    while nodes:
        totals = np.bincount(seg * classes + y[rows], w[rows], nodes * classes).reshape(nodes, classes)
        sizes = totals.sum(1)
        feature, cut = np.zeros(nodes, dtype=np.uint16), np.zeros(nodes, dtype=np.uint8)
        child = np.full(nodes, _OPEN, dtype=np.int32)
        mixed = (totals.max(1) < sizes) & (depth > 0)
        keep = mixed[seg]
        rows, number = rows[keep], np.cumsum(mixed) - 1
        seg = number[seg[keep]]
        if len(rows):
            wanted = np.flatnonzero(mixed)
            own, size = totals[wanted], sizes[wanted]
            picks = rng.random((len(wanted), width)).argpartition(tried - 1, axis=1)[:, :tried]
            starts = np.searchsorted(seg, np.arange(len(wanted)))
            last = np.append(seg[1:] != seg[:-1], True)
            best = np.full(len(wanted), -np.inf)
            best_feature, best_cut = np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=np.uint8)
            for j in range(tried):
                values = bins[rows, picks[seg, j]]
                order = np.argsort(seg * 256 + values)
                values, moved = values[order], rows[order]
                upto = np.zeros((len(rows), classes))
                upto[np.arange(len(rows)), y[moved]] = w[moved]
                np.cumsum(upto, axis=0, out=upto)
                base = np.zeros((len(wanted), classes))
                base[1:] = upto[starts[1:] - 1]
                score = _impurity_sums(upto - base[seg], own[seg])
                score[last | np.append(values[1:] == values[:-1], True)] = -np.inf
                top = np.maximum.reduceat(score, starts)
                at = np.flatnonzero((score == top[seg]) & np.isfinite(score))
                _, first = np.unique(seg[at], return_index=True)
                at = at[first]
                found = seg[at]
                better = top[found] > best[found]
                at, found = at[better], found[better]
                best[found], best_feature[found], best_cut[found] = top[found], picks[found, j], values[at]
            split = np.isfinite(best)
            rank = np.cumsum(split) - 1
            inner = wanted[split]
            feature[inner], cut[inner] = best_feature[split], best_cut[split]
            child[inner] = end + 2 * rank[split]
            gain = best[split] - (own[split] ** 2).sum(1) / size[split]
            gains += np.bincount(best_feature[split], gain, width)
            keep = split[seg]
            rows, seg = rows[keep], seg[keep]
            right = bins[rows, best_feature[seg]] > best_cut[seg]
            seg = 2 * rank[seg] + right
            order = np.argsort(seg, kind="stable")
            rows, seg = rows[order], seg[order]
            below = 2 * int(split.sum())
        else:
            below = 0
        leaf = np.flatnonzero(child == _OPEN)
        pure = totals[leaf].max(1) == sizes[leaf]
        child[leaf[pure]] = -2 - totals[leaf[pure]].argmax(1)
        impure = leaf[~pure]
        held = sum(map(len, shares))
        child[impure] = -2 - classes - held - np.arange(len(impure))
        shares.append(totals[impure] / sizes[impure, None])
        features.append(feature), cuts.append(cut), children.append(child)
        end, nodes, depth = end + below, below, depth - 1
    return {
        "feature": np.concatenate(features), "cut": np.concatenate(cuts), "child": np.concatenate(children),
        "shares": np.concatenate(shares), "gains": gains,
    }


class _Upper:
    """The upper nodes of one tree, as they are found on the driver."""

    def __init__(self, width: int):
        self.feature, self.cut, self.child, self.level = [0], [0], [_OPEN], [0]
        self.leaves: dict[int, np.ndarray] = {}
        self.gains = np.zeros(width)

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        left = len(self.child)
        self.feature[node], self.cut[node], self.child[node] = feature, cut, left
        self.feature += [0, 0]
        self.cut += [0, 0]
        self.child += [_OPEN, _OPEN]
        self.level += [self.level[node] + 1] * 2
        return left, left + 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.uint16), np.array(self.cut, np.uint8), np.array(self.child, np.int32)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def _counting(arrays: list, frontier: dict[int, dict[int, np.ndarray]], classes: int, width: int, seed: int):
    """Arrow function: rows to class counts by tree, node, tried feature and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = {t: np.array(sorted(f)) for t, f in frontier.items()}
        picks = {t: np.stack([frontier[t][n] for n in nodes[t]]) for t in frontier}
        counts = {t: np.zeros((*picks[t].shape, MAX_BINS, classes), np.float32) for t in frontier}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _matrix(batch.column("bins"), width)
            ids, y = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for t, own in nodes.items():
                w = _weights(ids, t, seed)
                at = _walk(bins, *arrays[t])
                place = np.minimum(np.searchsorted(own, at), len(own) - 1)
                rows = np.flatnonzero((w > 0) & (own[place] == at))
                place = place[rows]
                for j in range(picks[t].shape[1]):
                    value = bins[rows, picks[t][place, j]].astype(np.int64)
                    key = (place * MAX_BINS + value) * classes + y[rows]
                    added = np.bincount(key, w[rows], len(own) * MAX_BINS * classes)
                    counts[t][:, j] += added.reshape(len(own), MAX_BINS, classes)
        for t, own in nodes.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t] * len(own), pa.int32()), pa.array(own, pa.int32()),
                    pa.array([c.tobytes() for c in counts[t]], pa.binary()),
                ],
                ["tree", "node", "counts"],
            )

    return run


def _splitting(tried: int, classes: int):
    """Arrow function: the counts of one node to its best split, and the class counts on both sides."""

    def run(group: pa.Table) -> pa.Table:
        total = np.zeros((tried, MAX_BINS, classes))
        for part in group.column("counts").to_pylist():
            total += np.frombuffer(part, dtype=np.float32).reshape(total.shape)
        left = np.cumsum(total, axis=1)
        # A cut after a bin without rows is the cut before it.
        score = np.where(total.sum(-1) > 0, _impurity_sums(left, left[:, -1:]), -np.inf)
        j, cut = np.unravel_index(np.argmax(score), score.shape)
        return pa.table(
            {
                "tree": group.column("tree").slice(0, 1), "node": group.column("node").slice(0, 1),
                "pick": pa.array([j], pa.int32()), "cut": pa.array([cut], pa.int32()),
                "score": pa.array([float(score[j, cut])]), "below": pa.array([left[j, cut].tolist()]),
                "counts": pa.array([left[j, -1].tolist()]),
            }
        )

    return run


def _routing(arrays: list, width: int, seed: int, trees: range):
    """Arrow function: rows to their open node in each tree whose bootstrap has them, packed by tree and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _matrix(batch.column("bins"), width)
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for t in trees:
                w, at = _weights(ids, t, seed), _walk(bins, *arrays[t])
                rows = np.flatnonzero((w > 0) & (arrays[t][2][at] == _OPEN))
                rows = rows[np.argsort(at[rows], kind="stable")]
                nodes, starts = np.unique(at[rows], return_index=True)
                parts = np.split(rows, starts[1:]) if len(rows) else []
                packed = [pa.array([v[p].tobytes() for p in parts], pa.binary()) for v in (ids, labels, w.astype(np.uint8), bins)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), *packed],
                    ["tree", "node", "id", "label", "w", "bins"],
                )

    return run


def _growing(levels: dict[tuple[int, int], int], classes: int, width: int, tried: int, depth: int, seed: int):
    """Arrow function: the rows of one node to the tree below it."""

    def run(group: pa.Table) -> pa.Table:
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        kinds = {"id": np.int64, "label": np.int32, "w": np.uint8, "bins": np.uint8}
        ids, y, w, bins = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in kinds.items())
        order = np.argsort(ids)  # the same tree whatever the order of rows is
        bins, y, w = bins.reshape(-1, width)[order], y[order].astype(np.int64), w[order].astype(np.int64)
        rng = np.random.default_rng([seed, tree, node])
        grown = _grow(bins, y, w, classes, tried, depth - levels.get((tree, node), 0), rng)
        return pa.table(
            {
                "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                **{n: pa.array([grown[n].tobytes()], pa.binary()) for n in ("feature", "cut", "child", "shares")},
                "gains": pa.array([grown["gains"].tolist()]),
            }
        )

    return run


def _upper_nodes(rows: DataFrame, size: int, trees: int, depth: int, classes: int, width: int, tried: int, seed: int) -> list[_Upper]:
    """The nodes of each tree with more than ``GROUP_ROWS`` rows, split from counts, and leaves among them."""
    found = [_Upper(width) for _ in range(trees)]
    waiting = [(t, 0) for t in range(trees)] if size > GROUP_ROWS else []
    at_once = max(1, COUNT_BYTES // (tried * MAX_BINS * classes * 4))
    while waiting:
        now, waiting = waiting[:at_once], waiting[at_once:]
        frontier: dict[int, dict[int, np.ndarray]] = {}
        for t, node in now:
            rng = np.random.default_rng([seed, t, node, 1])
            frontier.setdefault(t, {})[node] = rng.permutation(width)[:tried]
        arrays = [u.arrays() for u in found]
        counted = rows.mapInArrow(_counting(arrays, frontier, classes, width, seed), "tree int, node int, counts binary")
        splits = counted.groupBy("tree", "node").applyInArrow(
            _splitting(tried, classes),
            "tree int, node int, pick int, cut int, score double, below array<double>, counts array<double>",
        )
        for r in splits.collect():
            tree, total, left = found[r["tree"]], np.array(r["counts"]), np.array(r["below"])
            level = tree.level[r["node"]]
            if total.max() == total.sum() or not math.isfinite(r["score"]) or level >= depth:
                tree.leaves[r["node"]] = total
                continue
            feature = int(frontier[r["tree"]][r["node"]][r["pick"]])
            below = tree.split(r["node"], feature, r["cut"])
            tree.gains[feature] += r["score"] - (total**2).sum() / total.sum()
            for node, counts in zip(below, (left, total - left)):
                if counts.max() == counts.sum() or (counts.sum() > GROUP_ROWS and level + 1 >= depth):
                    tree.leaves[node] = counts
                elif counts.sum() > GROUP_ROWS:
                    waiting.append((r["tree"], node))
    for tree in found:
        for place, (node, counts) in enumerate(sorted(tree.leaves.items())):
            pure = counts.max() == counts.sum()
            tree.child[node] = -2 - int(counts.argmax()) if pure else -2 - classes - place
    return found


def _joined(upper: _Upper, lower: list, classes: int) -> dict[str, np.ndarray]:
    """One tree from its upper nodes and the trees below its open ones."""
    feature, cut, child = ([a] for a in upper.arrays())
    shares = [np.array([c / c.sum() for _, c in sorted(upper.leaves.items())]).reshape(-1, classes)]
    end, held = len(child[0]), len(shares[0])
    for r in lower:
        own_child = np.frombuffer(r["child"], np.int32).copy()
        own_shares = np.frombuffer(r["shares"], np.float64).reshape(-1, classes)
        # The root of the lower tree takes the open node's place; its other nodes come at the end.
        own_child[own_child >= 0] += end - 1
        own_child[own_child <= -2 - classes] -= held
        own_feature, own_cut = np.frombuffer(r["feature"], np.uint16), np.frombuffer(r["cut"], np.uint8)
        node = r["node"]
        feature[0][node], cut[0][node], child[0][node] = own_feature[0], own_cut[0], own_child[0]
        feature.append(own_feature[1:]), cut.append(own_cut[1:]), child.append(own_child[1:])
        shares.append(own_shares)
        end, held = end + len(own_child) - 1, held + len(own_shares)
    kind = np.uint8 if max(int(f.max(initial=0)) for f in feature) < 256 else np.uint16
    return {
        "feature": np.concatenate(feature).astype(kind), "cut": np.concatenate(cut), "child": np.concatenate(child),
        "shares": np.concatenate(shares).astype(np.float64),
    }


def _tree_by_tree(grown: DataFrame, trees: int) -> Iterator[list]:
    """The rows of each tree by node; a result holds trees of about ``RESULT_BYTES`` together."""
    size = sum((F.sum(F.length(c)) for c in ("feature", "cut", "child", "shares")), F.lit(0))
    sizes = dict(grown.groupBy("tree").agg(size).collect())
    first = 0
    while first < trees:
        last, held = first + 1, sizes.get(first, 0)
        while last < trees and held + sizes.get(last, 0) <= RESULT_BYTES:
            last, held = last + 1, held + sizes.get(last, 0)
        found: dict[int, list] = {t: [] for t in range(first, last)}
        for r in grown.where(F.col("tree").between(first, last - 1)).collect():
            found[r["tree"]].append(r)
        while found:
            yield sorted(found.pop(min(found)), key=lambda r: r["node"])
        first = last


def fit_grown_forest(
    rows: DataFrame, features: str, label: str, trees: int, depth: int, seed: int, prefix: str = "", least_classes: int = 1
) -> GrownForest:
    """A forest on a vector column and a column of class codes. ``rows`` are read a few times."""
    shared_folder(rows.sparkSession)
    numbered = rows.select(
        F.monotonically_increasing_id().alias("id"), F.col(label).cast("int").alias("label"),
        vector_to_array(features).alias("x"),
    ).checkpoint()
    facts = numbered.agg(F.count("*").alias("n"), F.max("label").alias("most"), F.max(F.size("x")).alias("width")).first()
    if not facts["n"]:
        raise ValueError("a forest needs rows")
    size, classes, width = facts["n"], max(least_classes, facts["most"] + 1), facts["width"]
    thresholds = _all_thresholds(numbered, width, MAX_BINS)

    def to_bins(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                packed = pa.array([r.tobytes() for r in _binned(x, thresholds)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), packed], ["id", "label", "bins"])

    binned = numbered.mapInArrow(to_bins, "id bigint, label int, bins binary").checkpoint()
    tried = max(1, math.ceil(math.sqrt(width)))
    upper = _upper_nodes(binned, size, trees, depth, classes, width, tried, seed)
    arrays = [u.arrays() for u in upper]
    levels = {(t, n): u.level[n] for t, u in enumerate(upper) for n, c in enumerate(u.child) if c == _OPEN and n}
    routed = binned.mapInArrow(
        _routing(arrays, width, seed, range(trees)), "tree int, node int, id binary, label binary, w binary, bins binary"
    )
    grown = routed.groupBy("tree", "node").applyInArrow(
        _growing(levels, classes, width, tried, depth, seed),
        f"tree int, node int, {_TREE.removeprefix('tree int, ')}, gains array<double>",
    )
    importance = np.zeros(width)
    fitted = []
    for tree, own in zip(upper, _tree_by_tree(grown.checkpoint(), trees)):
        gains = tree.gains + sum((np.array(r["gains"]) for r in own), np.zeros(width))
        importance += gains / gains.sum() if gains.sum() > 0 else 0.0
        fitted.append(_joined(tree, own, classes))
    importance = importance / importance.sum() if importance.sum() > 0 else importance
    return GrownForest(features, classes, thresholds, fitted, importance, prefix)


class GrownForestClassifier(Estimator):
    """Settings of a forest; ``fit`` grows it. ``prefix`` is put before the names of the columns it adds."""

    def __init__(
        self, features: str, label: str, trees: int, depth: int, seed: int, prefix: str = "", least_classes: int = 1
    ):
        super().__init__()
        self.settings = (features, label, trees, depth, seed, prefix, least_classes)

    def _fit(self, dataset: DataFrame) -> GrownForest:
        return fit_grown_forest(dataset, *self.settings)


class GrownForest(Transformer, MLWritable, MLReadable):
    """A fitted forest: adds class probabilities and the likeliest class."""

    def __init__(self, features="", classes=0, thresholds=(), trees=(), importance=(), prefix=""):
        super().__init__()
        self.features, self.classes, self.prefix = features, classes, prefix
        self.thresholds = [np.asarray(t, dtype=np.float64) for t in thresholds]
        self.trees, self.importance = list(trees), np.asarray(importance, dtype=np.float64)
        self._sent = None

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importance)

    def _broadcast(self, spark: SparkSession):
        application = spark.sparkContext.applicationId
        if self._sent is None or self._sent[0] != application:
            held = [tuple(t[n] for n in ("feature", "cut", "child", "shares")) for t in self.trees]
            self._sent = application, spark.sparkContext.broadcast((self.thresholds, held))
        return self._sent[1]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sent, classes = self._broadcast(dataset.sparkSession), self.classes

        @F.arrow_udf(ArrayType(DoubleType()))
        def probabilities(vectors: pa.Array) -> pa.Array:
            thresholds, trees = sent.value
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(thresholds))
            bins, total, whole = _binned(x, thresholds), np.zeros((len(x), classes)), np.eye(classes)
            for feature, cut, child, shares in trees:
                at = -2 - child[_walk(bins, feature, cut, child)]
                pure = at < classes
                total[pure] += whole[at[pure]]
                total[~pure] += shares[at[~pure] - classes]
            total /= max(1, len(trees))
            return pa.ListArray.from_arrays(np.arange(0, total.size + 1, classes, dtype=np.int32), total.ravel())

        name = {n: f"{self.prefix}{n}" for n in ("probability", "prediction")}
        added = dataset.withColumn("__chances", probabilities(vector_to_array(self.features)))
        best = F.array_position("__chances", F.array_max("__chances")) - 1
        return added.withColumns(
            {name["probability"]: array_to_vector("__chances"), name["prediction"]: best.cast("double")}
        ).drop("__chances")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as rows: see ``forest_table.forest_nodes``."""
        classes = self.classes
        values = np.concatenate([*self.thresholds, np.empty(0)])
        starts = np.cumsum([0, *map(len, self.thresholds)])

        def unpacked(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    tree = _unpacked(r, classes)
                    feature, cut, child, shares = (tree[n] for n in ("feature", "cut", "child", "shares"))
                    every = np.concatenate([np.eye(classes), shares])
                    for start in range(0, len(child), 10_000):
                        part = np.arange(start, min(start + 10_000, len(child)))
                        inner = child[part] >= 0
                        value = np.zeros(len(part))
                        value[inner] = values[starts[feature[part][inner]] + cut[part][inner]]
                        ends = np.append(0, np.cumsum(np.where(inner, 0, classes))).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([r["tree"]] * len(part), pa.int32()), pa.array(part, pa.int32()),
                                pa.array(feature[part].astype(np.int32), mask=~inner), pa.array(value, mask=~inner),
                                pa.array(child[part], mask=~inner), pa.array(child[part] + 1, pa.int32(), mask=~inner),
                                pa.ListArray.from_arrays(
                                    pa.array(ends), pa.array(every[-2 - child[part][~inner]].ravel()), mask=pa.array(inner)
                                ),
                            ],
                            ["tree", "node", "feature", "threshold", "left", "right", "shares"],
                        )

        wanted = "tree int, node int, feature int, threshold double, left int, right int, shares array<double>"
        return self.packed(spark).mapInArrow(unpacked, wanted)

    def packed(self, spark: SparkSession) -> DataFrame:
        """A row per tree with its arrays."""
        rows = [(i, *(t[n].tobytes() for n in ("feature", "cut", "child", "shares"))) for i, t in enumerate(self.trees)]
        slices = 1 + sum(a.nbytes for t in self.trees for a in t.values()) // RESULT_BYTES
        slices = min(max(slices, spark.sparkContext.defaultParallelism), max(1, len(rows)))
        return spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), _TREE)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


def _unpacked(row, classes: int) -> dict[str, np.ndarray]:
    child = np.frombuffer(row["child"], np.int32)
    kind = np.uint8 if len(row["feature"]) == len(child) else np.uint16
    return {
        "feature": np.frombuffer(row["feature"], kind), "cut": np.frombuffer(row["cut"], np.uint8), "child": child,
        "shares": np.frombuffer(row["shares"], np.float64).reshape(-1, classes),
    }


class _ForestWriter(MLWriter):
    def __init__(self, forest: GrownForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        f, spark = self.forest, self.sparkSession
        facts = {
            "features": f.features, "classes": f.classes, "prefix": f.prefix, "importance": f.importance.tolist(),
            "thresholds": [t.tolist() for t in f.thresholds],
        }
        DefaultParamsWriter.saveMetadata(f, path, spark, extraMetadata={"forest": json.dumps(facts)})
        f.packed(spark).write.parquet(f"{path}/data")


class _ForestReader(MLReader):
    def load(self, path: str) -> GrownForest:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        facts = json.loads(metadata["forest"])
        rows = self.sparkSession.read.parquet(f"{path}/data").orderBy("tree").collect()
        trees = [_unpacked(r, facts["classes"]) for r in rows]
        forest = GrownForest(
            facts["features"], facts["classes"], facts["thresholds"], trees, facts["importance"], facts["prefix"]
        )
        forest._resetUid(metadata["uid"])
        return forest

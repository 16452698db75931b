"""The walk through the table of nodes: what it gives, and how much it writes."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array

from threatloom.operators import forest_table
from threatloom.operators.forest_table import forest_nodes, walk_forest
from threatloom.operators.grown_forest import fit_grown_forest
from threatloom.session import shared_folder

NODES = "tree int, node int, feature int, threshold double, left int, right int, shares array<double>"
#: Two trees over features 1 and 3, with nodes numbered in any order.
TREES = [
    (0, 0, 3, 0.5, 7, 2, None), (0, 7, None, None, None, None, [1.0, 0.0]), (0, 2, 1, -1.0, 4, 9, None),
    (0, 4, None, None, None, None, [0.0, 1.0]), (0, 9, None, None, None, None, [0.25, 0.75]),
    (1, 0, None, None, None, None, [0.5, 0.5]),
]


@pytest.mark.parametrize("most, group", [(262_144, 256), (1, 2)])
def test_rows_come_to_the_leaves_of_the_table(spark, monkeypatch, most, group):
    monkeypatch.setattr(forest_table, "BLOCK_BYTES", most)
    monkeypatch.setattr(forest_table, "GROUP_BLOCKS", group)
    nan = float("nan")
    rows = [
        ("at", [9.0, 0.0, 9.0, 0.5]), ("right", [0.0, -1.0, 0.0, 0.6]), ("far", [0.0, 5.0, 0.0, 0.6]),
        ("none", [0.0, None, 0.0, None]), ("nan", [0.0, -2.0, 0.0, nan]), ("short", [0.0]),
        (None, [0.0, 0.0, 0.0, 0.0]), ("twice", [0.0, 0.0, 0.0, 0.0]), ("twice", [0.0, -1.0, 0.0, 1.0]),
    ]
    frame = spark.createDataFrame(rows, "id string, v array<double>").repartition(3)
    found = {r["id"]: list(r["probabilities"]) for r in walk_forest(frame, "id", "v", spark.createDataFrame(TREES, NODES)).collect()}
    assert found == {
        "at": [0.75, 0.25], "right": [0.25, 0.75], "far": [0.375, 0.625], "none": [0.375, 0.625], "nan": [0.25, 0.75],
        "short": [0.375, 0.625], None: [0.75, 0.25], "twice": [0.5, 0.5],
    }


def test_no_rows_and_a_forest_of_leaves(spark):
    leaf = spark.createDataFrame(TREES[-1:], NODES)
    frame = spark.createDataFrame([(1, [0.0]), (2, None)], "id int, v array<double>")
    assert [list(r["probabilities"]) for r in walk_forest(frame, "id", "v", leaf).collect()] == [[0.5, 0.5]] * 2
    assert walk_forest(frame.limit(0), "id", "v", leaf).count() == 0
    assert walk_forest(frame, "id", "v", leaf.limit(0)).count() == 0


def test_a_deep_forest_writes_no_copy_of_the_rows_per_tree_and_level(spark):
    """2,000 rows of 40 values are 0.6 MB; in 30 trees of some 20 levels they would be hundreds of MB."""
    rng = np.random.default_rng(4)
    data = [(i, rng.standard_normal(40).tolist(), int(rng.integers(0, 3))) for i in range(2000)]
    frame = spark.createDataFrame(data, "id int, x array<double>, y int")
    frame = frame.select("id", array_to_vector("x").alias("v"), "y").checkpoint()
    forest = fit_grown_forest(frame, "v", "y", 30, 30, 42)
    given = {r["id"]: list(r["p"]) for r in forest.transform(frame).select("id", vector_to_array("probability").alias("p")).collect()}

    def stored():
        folder = shared_folder(spark).removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names) / 1000

    before = stored()
    walked = walk_forest(frame, "id", "v", forest_nodes(spark, forest))
    found = {r["id"]: list(r["probabilities"]) for r in walked.collect()}
    assert stored() - before < 5_000
    assert found.keys() == given.keys() and all(found[i] == pytest.approx(given[i]) for i in given)

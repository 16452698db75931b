"""The forest of random-projection trees against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.operators import projection_forest
from threatloom.operators.neighbours import balance_classes, nearest_neighbours
from threatloom.operators.projection_forest import _leaves, forest_neighbours


def points(spark, rows, width=16, groups=1, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, width)) * 3
    data = [(i, (centres[i % 20] + rng.standard_normal(width)).tolist(), i % groups) for i in range(rows)]
    return spark.createDataFrame(data, "id bigint, v array<double>, g int").repartition(4)


def recall(found, exact):
    near = found.select("id", "neighbour").join(exact.select("id", "neighbour"), ["id", "neighbour"]).count()
    return near / exact.count()


def test_recall_over_many_leaves(spark):
    data = points(spark, 3000).checkpoint()
    found = forest_neighbours(data, "id", "v", leaf_rows=64).checkpoint()
    exact = nearest_neighbours(data, "id", "v").checkpoint()
    assert recall(found, exact) >= 0.9
    rows = {(r["id"], r["neighbour"]): r["distance"] for r in exact.collect()}
    for r in found.collect():
        assert rows.get((r["id"], r["neighbour"]), r["distance"]) == pytest.approx(r["distance"])
    ranks = found.groupBy("id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).distinct().collect()
    assert [tuple(r)[-2:] for r in ranks if tuple(r)[-2:] != (5, 5)] == []


def test_recall_on_the_test_tables(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "id")
    found = forest_neighbours(data, "id", "embedding")
    assert recall(found, nearest_neighbours(data, "id", "embedding")) >= 0.9


def test_leaves_stay_small_whatever_the_rows(spark, monkeypatch):
    monkeypatch.setattr(projection_forest, "SAMPLE_ROWS", 200)
    for rows in (500, 4000):
        data = points(spark, rows).select("id", F.col("g").alias("grp"), F.col("v").alias("vector"))
        same = data.limit(300).withColumns({"id": F.col("id") + 100_000, "vector": F.lit([1.0] * 16)})
        leaves = _leaves(data.union(same), 3, 50, 16, rows + 300, 7)
        sizes = leaves.groupBy("grp", "tree", "node").count()
        assert sizes.agg(F.max("count")).first()[0] <= 50
        assert leaves.count() == 3 * (rows + 300) and sizes.agg(F.avg("count")).first()[0] > 12


def test_groups_never_meet_and_small_ones_are_exact(spark):
    data = points(spark, 90, groups=3)
    found = forest_neighbours(data, "id", "v", 4, "g", refinements=0)
    assert found.where(F.col("id") % 3 != F.col("neighbour") % 3).count() == 0
    for g in range(3):
        own = data.where(F.col("g") == g)
        wanted = sorted(tuple(r) for r in nearest_neighbours(own, "id", "v", 4).select("id", "neighbour", "rank").collect())
        got = found.where(F.col("id") % 3 == g).select("id", "neighbour", "rank")
        assert sorted(tuple(r) for r in got.collect()) == wanted


def test_few_rows(spark):
    assert forest_neighbours(points(spark, 1), "id", "v").count() == 0
    assert forest_neighbours(points(spark, 0), "id", "v").count() == 0
    assert forest_neighbours(points(spark, 3), "id", "v").count() == 6


def test_classes_become_equal_in_one_go(spark):
    data = points(spark, 400).withColumn("label", F.when(F.col("id") < 250, "a").when(F.col("id") < 380, "b").when(F.col("id") < 393, "c"))
    for exact in (False, True):
        balanced = balance_classes(data, "id", "v", "label", exact=exact).checkpoint()
        counts = {(r["label"], r["synthetic"]): r["count"] for r in balanced.groupBy("label", "synthetic").count().collect()}
        assert counts == {("a", False): 250, ("b", False): 130, ("c", False): 13, (None, False): 7,
                          ("b", True): 120, ("c", True): 237, (None, True): 243}
    with pytest.raises(ValueError):
        balance_classes(data.where("id < 251"), "id", "v", "label")

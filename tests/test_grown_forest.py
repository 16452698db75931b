import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from threatloom.operators import grown_forest as G
from threatloom.operators import models
from threatloom.operators.forest_table import forest_nodes, walk_forest
from threatloom.plans.preprocess import load_model, save_model

SIZE, WIDTH, CLASSES = 1500, 9, 4


@pytest.fixture(scope="module")
def data(spark):
    """Three classes by the sum of three features, a tenth of the rows with another label."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((SIZE, WIDTH))
    y = np.digitize(x[:, :3].sum(1), [-1, 1])
    y = np.where(rng.random(SIZE) < 0.1, rng.integers(0, CLASSES, SIZE), y)
    rows = [(i, Vectors.dense(v), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "v", "y"]).checkpoint(), x, y


def _fit(data, depth=30, trees=25):
    return G.fit_grown_forest(data[0], "v", "y", trees, depth, 42)


@pytest.mark.parametrize("most", [16_384, 40])
def test_forest_learns_in_one_group_and_in_many(data, monkeypatch, most):
    monkeypatch.setattr(G, "GROUP_ROWS", most)
    forest = _fit(data)
    scored = forest.transform(data[0]).select("y", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r["y"] == r["prediction"] for r in scored]) > 0.97
    assert all(len(r["p"]) == CLASSES and sum(r["p"]) == pytest.approx(1) for r in scored)
    importance = forest.featureImportances.toArray()
    assert importance.sum() == pytest.approx(1) and importance[:3].min() > importance[3:].max()


def test_rows_left_to_a_group_are_few(spark, data, monkeypatch):
    monkeypatch.setattr(G, "GROUP_ROWS", 60)
    _, x, y = data
    thresholds = G._thresholds(x, G.MAX_BINS)
    bins, ids = G._binned(x, thresholds), np.arange(SIZE)
    rows = spark.createDataFrame([(int(i), int(c), bytes(b)) for i, c, b in zip(ids, y, bins)], "id bigint, label int, bins binary")
    upper = G._upper_nodes(rows.repartition(5), SIZE, 3, 30, CLASSES, WIDTH, 3, 42)
    for t, tree in enumerate(upper):
        feature, cut, child = tree.arrays()
        w, at = G._weights(ids, t, 42), G._walk(bins, feature, cut, child)
        held = np.bincount(at, w, len(child))
        assert held.sum() == w.sum() and held[child == -1].max() <= 60
        assert all(held[n] == c.sum() for n, c in tree.leaves.items()) and len(child) > SIZE / 60


@pytest.mark.parametrize("most", [16_384, 100])
def test_a_tree_parts_all_rows_it_can(data, monkeypatch, most):
    monkeypatch.setattr(G, "GROUP_ROWS", most)
    forest = _fit(data, trees=2)
    _, x, y = data
    bins = G._binned(x, forest.thresholds)
    for t, tree in enumerate(forest.trees):
        w = G._weights(np.arange(SIZE), t, 42)
        assert abs(w.mean() - 1) < 0.1 and abs((w == 0).mean() - np.exp(-1)) < 0.05
        leaf = -2 - tree["child"][G._walk(bins, tree["feature"], tree["cut"], tree["child"])]
        assert (leaf >= 0).all()
    shallow = _fit(data, depth=3, trees=2)
    assert max(len(t["child"]) for t in shallow.trees) <= 15 < min(len(t["child"]) for t in forest.trees)


def test_a_pure_leaf_has_the_class_of_its_rows():
    rng = np.random.default_rng(1)
    bins, y = rng.integers(0, 32, (400, 6)).astype(np.uint8), rng.integers(0, 3, 400)
    tree = G._grow(bins, y, np.ones(400, dtype=np.int64), 3, 6, 30, rng)
    leaf = -2 - tree["child"][G._walk(bins, tree["feature"], tree["cut"], tree["child"])]
    assert (leaf == y).all() and not len(tree["shares"])
    same = G._grow(np.zeros((4, 6), np.uint8), np.array([0, 1, 1, 1]), np.array([1, 1, 1, 1]), 3, 6, 30, rng)
    assert same["child"].tolist() == [-2 - 3] and same["shares"].tolist() == [[0.25, 0.75, 0.0]]


def test_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    bins, y, w = rng.integers(0, 8, (300, 4)).astype(np.uint8), rng.integers(0, 3, 300), rng.integers(1, 4, 300)
    tree = G._grow(bins, y, w, 3, 4, 1, rng)

    def impurity(rows):
        n = np.bincount(y[rows], w[rows], 3)
        return n.sum() - (n**2).sum() / n.sum()

    best = min(
        impurity(bins[:, f] <= c) + impurity(bins[:, f] > c) for f in range(4) for c in range(7)
    )
    left = bins[:, tree["feature"][0]] <= tree["cut"][0]
    assert impurity(left) + impurity(~left) == pytest.approx(best)
    counts = np.zeros((4, G.MAX_BINS, 3), np.float32)
    for f in range(4):
        np.add.at(counts[f], (bins[:, f], y), w)
    group = pa.table({"tree": [0, 0], "node": [0, 0], "counts": [counts.tobytes(), np.zeros_like(counts).tobytes()]})
    found = G._splitting(4, 3)(group).to_pylist()[0]
    assert (found["pick"], found["cut"]) == (tree["feature"][0], tree["cut"][0])
    assert found["below"] == np.bincount(y[left], w[left], 3).tolist()


def test_walk_by_joins_and_saved_forest_agree(spark, data, monkeypatch, tmp_path):
    monkeypatch.setattr(G, "GROUP_ROWS", 200)
    forest = _fit(data, trees=4)
    given = {r["id"]: list(r["p"]) for r in forest.transform(data[0]).select("id", vector_to_array("probability").alias("p")).collect()}
    some = data[0].where("id < 50")
    for r in walk_forest(some, "id", "v", forest_nodes(spark, forest)).collect():
        assert list(r["probabilities"]) == pytest.approx(given[r["id"]])
    save_model(spark, [forest], ["v"], str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))[0][0]
    assert {r["id"]: list(r["p"]) for r in again.transform(data[0]).select("id", vector_to_array("probability").alias("p")).collect()} == given
    assert list(again.featureImportances) == list(forest.featureImportances)


def test_fitting_again_gives_the_same_trees(data):
    first, second = _fit(data, trees=3), _fit(data, trees=3)
    assert all((a[n] == b[n]).all() for a, b in zip(first.trees, second.trees) for n in a)


def test_a_node_takes_few_bytes(data):
    """What the driver holds of a model is flat arrays, not objects."""
    model_bytes = sum(a.nbytes for t in _fit(data).trees for n, a in t.items() if n != "shares")
    nodes = sum(len(t["child"]) for t in _fit(data).trees)
    assert model_bytes <= 7 * nodes
    assert isinstance(models.traffic_forest("v", "y", 2, 3).fit(data[0]), G.GrownForest)


def test_thresholds_part_all_rows(spark):
    rng = np.random.default_rng(8)
    x = np.stack([rng.standard_normal(15_000), rng.integers(0, 40, 15_000) / 7, rng.integers(0, 5, 15_000), np.zeros(15_000)], axis=1)
    rows = [(Vectors.dense(v), int(v[0] > 2)) for v in x]
    forest = G.fit_grown_forest(spark.createDataFrame(rows, ["v", "y"]).repartition(5), "v", "y", 2, 3, 42)
    wanted = G._thresholds(x, G.MAX_BINS)
    assert [len(t) for t in wanted] == [31, 31, 4, 0]
    assert all(list(a) == list(b) for a, b in zip(forest.thresholds, wanted, strict=True))


def test_trees_are_fetched_in_small_results(data, monkeypatch):
    whole = _fit(data, trees=5)
    monkeypatch.setattr(G, "RESULT_BYTES", 1_000)
    parts = _fit(data, trees=5)
    assert all((a[n] == b[n]).all() for a, b in zip(whole.trees, parts.trees, strict=True) for n in a)
    spark = data[0].sparkSession
    assert parts.packed(spark).rdd.getNumPartitions() == 5
    assert sorted(map(tuple, parts.packed(spark).collect())) == sorted(map(tuple, whole.packed(spark).collect()))

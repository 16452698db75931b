import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from threatloom.fixed_values import TRAFFIC_FEATURES
from threatloom.operators import models
from threatloom.operators.neighbours import balance_classes, nearest_neighbours, synthetic_minority
from threatloom.plans import training
from threatloom.plans.preprocess import feature_list, load_model, save_model
from threatloom.plans.traffic import classify, summary, threat_events
from threatloom.sources.sinks import write_csv

GROUPS = ["normal", "dos", "probe", "r2l", "u2r"]


@pytest.fixture(scope="module")
def cases(spark):
    """Three connections of each group: the group's own block of features is raised, the rest is small noise."""
    rng = np.random.default_rng(23)
    rows = []
    for g, group in enumerate(GROUPS):
        for i in range(3):
            values = rng.uniform(0, 1, len(TRAFFIC_FEATURES))
            values[g::len(GROUPS)] += 10 + i
            rows.append((f"{group}-{i}", group, *map(float, values)))
    return spark.createDataFrame(
        rows, "name string, attack_type string, " + ", ".join(f"`{c}` double" for c in TRAFFIC_FEATURES)
    )


@pytest.fixture(scope="module")
def traffic_model(cases):
    many = cases.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return models.fit_traffic_model(many, TRAFFIC_FEATURES, "attack_type", trees=15, depth=6)


def test_cases_of_five_groups(cases, traffic_model):
    ranked = models.rank_traffic(cases, traffic_model).collect()
    assert len(ranked) == 15
    for row in ranked:
        chances = [p["probability"] for p in row["all_probabilities"]]
        assert row["predicted_attack"] == row["attack_type"], row["name"]
        assert sum(chances) == pytest.approx(1) and chances == sorted(chances, reverse=True)
        assert row["top_predictions"] == row["all_probabilities"][:3]
        assert row["confidence"] == pytest.approx(chances[0])
    top = {r["name"]: r for r in models.case_summary(models.rank_traffic(cases, traffic_model), "name").collect()}
    assert all(r["top_class"] == r["predicted_attack"] and r["top_probability"] > 0.5 for r in top.values())
    scored = models.score_traffic(cases, traffic_model)
    assert scored.columns == [*cases.columns, "predicted_attack", "confidence"]


def test_events_of_classified_connections(cases, traffic_model):
    keyed = cases.withColumn("connection_key", F.col("name")).drop("attack_type")
    found = classify(keyed, traffic_model)
    events = {r["connection_key"]: r for r in threat_events(found, "h", model_confidence=False).collect()}
    assert (events["probe-1"]["severity"], events["probe-1"]["confidence"]) == ("medium", 0.98)
    assert (events["normal-2"]["severity"], events["normal-2"]["confidence"]) == ("low", 0.85)
    assert events["dos-0"]["severity"] == "high" and events["dos-0"]["model_version"] == "v1.0"
    shares = {r["attack_type"]: r["percent"] for r in summary(found).collect()}
    assert shares["normal"] == 20.0 and sum(shares.values()) == pytest.approx(100)


def test_importance_lists_all_features(traffic_model):
    rows = models.feature_importances(traffic_model, TRAFFIC_FEATURES).collect()
    values = [r["importance"] for r in rows]
    assert len(rows) == 38 and values == sorted(values, reverse=True) and sum(values) == pytest.approx(1)


def test_model_survives_saving(spark, cases, traffic_model, tmp_path):
    save_model(spark, traffic_model.stages, TRAFFIC_FEATURES, str(tmp_path / "m"))
    stages, columns = load_model(spark, str(tmp_path / "m"))
    assert columns == TRAFFIC_FEATURES and feature_list(columns, 2) == {"feature_count": 38, "features": columns[:2]}
    again = models.apply_stages(cases, stages).select("name", "predicted_attack").collect()
    assert {tuple(r) for r in again} == {(r["name"], r["predicted_attack"]) for r in models.score_traffic(cases, traffic_model).collect()}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 6)) @ np.diag([5, 3, 1, 1, 0.2, 0.01]) + 10
    # A third of the points are copies of one.
    x[:230] = x[0]
    y = (rng.random(700) < 0.15).astype(int)
    frame = pd.DataFrame({"id": np.arange(700), "v": list(x), "malware": y, **{f"f{i}": x[:, i] for i in range(6)}})
    return spark.createDataFrame(frame), frame, x


def test_pca_keeps_the_variance_target(points):
    frame, _, x = points
    columns = [f"f{i}" for i in range(6)]
    scaling = models.fit_scaled_vectors(frame, columns)
    scaled = models.apply_stages(frame, scaling)
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(np.array([r[0] for r in scaled.orderBy("id").select(vector_to_array("scaled")).collect()]), z)
    for target in (0.5, 0.95):
        stages, model, keep = models.fit_pca(scaled, 6, target)
        shares = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
        shares = np.cumsum(shares / shares.sum())
        assert keep == int((shares <= target).sum()) + 1
        reduced = models.pca_projection(frame, [*scaling, *stages], keep, "id").toPandas()
        got = reduced.drop(columns="id").to_numpy()
        assert np.allclose(np.sort(got.var(0))[::-1], np.sort(np.linalg.eigvalsh(z.T @ z / len(z)))[::-1][:keep])


@pytest.mark.parametrize("share, keep", [([0.95, 0.05], 2), ([0.96, 0.04], 1), ([0.5, 0.3, 0.2], 3), ([1.0], 1)])
def test_component_count(share, keep):
    assert models.components_for(share, 0.95) == keep


@pytest.mark.parametrize("pivots, cell", [(1, 10_000), (9, 60)])
def test_neighbours_match_brute_force(points, pivots, cell):
    frame, _, x = points
    got = nearest_neighbours(frame, "id", "v", 5, pivots, cell).toPandas()
    assert (got.groupby("id").size() == 5).all() and got["id"].nunique() == 700
    assert (got["id"] != got["neighbour"]).all() and not got.duplicated(["id", "neighbour"]).any()
    distances = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(distances, np.inf)
    want = np.sort(distances, axis=1)[:, :5]
    have = np.stack(got.sort_values(["id", "rank"]).groupby("id")["distance"].apply(np.array).to_numpy())
    assert np.allclose(have, want, atol=1e-9)


def test_fewer_rows_than_neighbours(spark):
    frame = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id int, v array<double>")
    got = nearest_neighbours(frame, "id", "v", 5).toPandas()
    assert sorted(got.groupby("id").size()) == [2, 2, 2]


def test_synthetic_rows_lie_between_neighbours(points):
    frame, expected, x = points
    minority = frame.where("malware = 1")
    found = synthetic_minority(minority, "id", "v", 333).toPandas()
    again = synthetic_minority(minority.repartition(3), "id", "v", 333).toPandas()
    ids = set(expected[expected.malware == 1]["id"])
    assert len(found) == 333 and set(found["base"]) <= ids and set(found["neighbour"]) <= ids
    counts = found.groupby("base").size()
    assert counts.max() - counts.reindex(sorted(ids), fill_value=0).min() <= 1
    assert found["gap"].between(0, 1, inclusive="left").all()
    for _, r in found.iterrows():
        assert np.allclose(r["v"], x[r["base"]] + r["gap"] * (x[r["neighbour"]] - x[r["base"]]))
    key = ["base", "copy"]
    assert np.allclose(found.sort_values(key)["gap"], again.sort_values(key)["gap"])


def test_classes_are_balanced(points):
    frame, expected, _ = points
    got = balance_classes(frame, "id", "v", "malware").groupBy("malware", "synthetic").count().collect()
    counts = {(r["malware"], r["synthetic"]): r["count"] for r in got}
    zeros, ones = (expected.malware == 0).sum(), (expected.malware == 1).sum()
    assert counts == {(0, False): zeros, (1, False): ones, (1, True): zeros - ones}


def test_malware_training(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(300) < 0.2).astype(int)
    x = rng.normal(size=(300, 4)) + 4 * y[:, None]
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "malware": y, **{f"f{i}": x[:, i] for i in range(4)}}))
    trained = training.train_malware(frame, "id", [f"f{i}" for i in range(4)], trees=10, depth=5, iterations=40)
    assert trained.test.count() == sum(int(n * 0.2 + 0.5) for n in np.bincount(y))
    found = training.evaluate_malware(trained.model, trained.test).toPandas()
    assert (found["actual"] == found["rf_verdict"]).mean() > 0.9 and (found["actual"] == found["net_verdict"]).mean() > 0.9
    report = {r["label"] for r in training.malware_metrics(training.evaluate_malware(trained.model, trained.test), "net").collect()}
    assert report == {"Malware", "Benign", "macro avg", "weighted avg"}


def test_batch_file(spark, cases, traffic_model, tmp_path):
    scored = models.score_traffic(cases, traffic_model)
    write_csv(scored, str(tmp_path / "out"))
    read = spark.read.csv(str(tmp_path / "out"), header=True)
    assert read.count() == 15 and read.columns[-2:] == ["predicted_attack", "confidence"]

import math

import pytest
from pyspark.sql import functions as F

from threatloom.functions import labels
from threatloom.operators import profile, quality
from threatloom.plans.preprocess import clean_network, preprocess_malware, preprocess_network, prepare_training

INF = float("inf")


@pytest.fixture(scope="module")
def flows_csv(spark):
    rows = [
        ("f1", "t", "1.1", "s", 1.0, "http", 0.1, 1, "BENIGN"),
        ("f2", "t", "1.1", "s", 2.0, "ftp", 0.2, 1, "DDoS"),
        ("f3", "t", "1.1", "s", 3.0, "-", 0.3, 1, "DDoS"),
        ("f4", "t", "1.1", "s", 4.0, "http", INF, 1, "DDoS"),
        ("f5", "t", "1.1", "s", 5.0, "http", None, 1, "DDoS"),
        ("f6", None, "1.1", "s", 6.0, "http", 0.4, 1, " benign "),
        ("f7", "t", "1.1", "s", 7.0, "?", 0.5, 1, "DDoS"),
        ("f8", "t", "1.1", "s", 8.0, "ssh", 0.6, 1, "Normal"),
    ]
    names = [" Flow ID", "Timestamp", "src ip", "session_id", "Flow Duration", "service", "rate", "update_count", " Label"]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, ["string"] * 4 + ["double", "string", "double", "int", "string"])))


def test_network_cleaning(flows_csv):
    clean, label, counts = clean_network(flows_csv)
    assert label == "Label" and clean.columns == ["Flow Duration", "service", "rate", "Label"]
    # The missing Timestamp does not remove its row: that column went first.
    assert sorted(r["Flow Duration"] for r in clean.collect()) == [1.0, 2.0, 6.0, 8.0]
    assert counts.first().asDict() == {"rows_before": 8, "rows_after": 4, "invalid_records_removed": 4}


def test_invalid_rows_look_at_all_columns(flows_csv):
    kept = quality.drop_invalid_rows(quality.trim_headers(flows_csv))
    assert sorted(r["Flow Duration"] for r in kept.collect()) == [1.0, 2.0, 8.0]


def test_placeholders_are_a_parameter(flows_csv):
    kept = quality.drop_invalid_rows(quality.drop_non_features(quality.trim_headers(flows_csv), "Label"), ["?"])
    assert sorted(r["Flow Duration"] for r in kept.collect()) == [1.0, 2.0, 3.0, 6.0, 8.0]


def test_network_preparation(flows_csv):
    prepared = preprocess_network(flows_csv, "CICIDS2017")
    assert prepared.features == ["Flow Duration", "service", "rate"]
    rows = prepared.data.collect()
    assert sorted(r["y"] for r in rows) == [0, 0, 0, 1]
    assert sum(r["rate"] for r in rows) == pytest.approx(0)
    summary = prepared.summary_frame().first()
    assert summary["features_used"] == 3 and summary["preprocessing_status"] == "Completed"


@pytest.mark.parametrize(
    "name, dropped",
    [("id", True), ("user_id", True), ("flow id", True), ("id_x", True), ("a id b", True), ("Update", True),
     ("Runtime", True), ("idle", False), ("paid", False), ("rate", False), ("srcip", True)],
)
def test_non_feature_names(name, dropped):
    assert quality.is_non_feature(name) is dropped


def test_label_column():
    assert quality.find_label_column(["a", "Attack", "LABEL"]) == "LABEL"
    assert quality.find_label_column(["a", "b"], fall_back_to_last=True) == "b"
    with pytest.raises(ValueError):
        quality.find_label_column(["a", "b"])


def test_label_mapping(spark):
    texts = spark.createDataFrame([(" Benign",), ("abnormal",), ("neptune",), (None,)], "l string")
    assert [r[0] for r in texts.select(labels.map_labels(texts, "l")).collect()] == [0, 0, 1, 1]
    bits = spark.createDataFrame([(0,), (1,)], "l int")
    assert [r[0] for r in bits.select(labels.map_labels(bits, "l")).collect()] == [0, 1]
    codes = spark.createDataFrame([(0,), (2,)], "l int")
    assert [r[0] for r in codes.select(labels.map_labels(codes, "l")).collect()] == [1, 1]
    assert [r[0] for r in codes.select(labels.clamp_label(F.col("l"))).collect()] == [0, 1]


def test_zero_fill_and_coerce(spark):
    frame = spark.createDataFrame([(1.0, None, "x"), (float("nan"), 2, "y"), (-INF, 3, None)], "a double, b int, c string")
    assert [tuple(r) for r in quality.zero_fill(frame).collect()] == [(1.0, 0, "x"), (0.0, 2, "y"), (0.0, 3, None)]
    texts = spark.createDataFrame([("1",), ("1e3",), ("x",), ("inf",)], "a string")
    assert [r["a"] for r in quality.coerce_numeric(texts, ["a"]).collect()] == [1.0, 1000.0]


def test_constant_columns(spark):
    frame = spark.createDataFrame([(1, 2, None), (1, 3, None), (1, None, None)], "a int, b int, c int")
    assert quality.constant_columns(frame, ["a", "b", "c"]) == ["a", "c"]


def test_align(spark):
    frame = spark.createDataFrame([(1, None, 3)], "b int, a int, z int")
    aligned, missing, extra = quality.align(frame, ["a", "b", "new"])
    assert aligned.columns == ["a", "b", "new"] and tuple(aligned.first()) == (0, 1, 0)
    assert missing == ["new"] and extra == ["z"]
    sparse = spark.createDataFrame([({"a": 2.0, "q": 1.0},)], "f map<string,double>")
    row = quality.align_map(sparse, "f", ["a", "b"]).first()
    assert (row["a"], row["b"]) == (2.0, 0.0)


def test_required_columns_and_rare_classes(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", INF), ("b", 2.0), (None, 3.0)], "attack_type string, duration double")
    kept = prepare_training(frame)
    assert sorted((r["attack_type"] or "-", r["duration"]) for r in kept.collect()) == [("-", 3.0), ("a", 0.0), ("a", 1.0)]
    with pytest.raises(ValueError):
        prepare_training(frame.drop("attack_type"))


def test_profile(spark):
    frame = spark.createDataFrame([("h1", 1, 5, 1), ("h2", 0, None, 1), ("h3", 1, 2, 1)], "hash string, malware int, abc int, x1 int")
    row = profile.dataset_profile(frame, "malware", "hash").first()
    assert (row["total_features"], row["api_calls"], row["samples"]) == (2, 1, 3)
    assert (row["malware_count"], row["benign_count"]) == (2, 1) and math.isclose(row["imbalance_ratio"], 2 / 3)
    assert profile.missing_cells(frame).first()["missing_cells"] == 1


def malware_rows(spark):
    rows = [(f"n{i}", float(i), float(i * i % 7), 1.0, float((i * 5) % 11), "x", i % 2) for i in range(12)]
    rows[3] = ("n3", None, *rows[3][2:])
    rows[4] = ("n4", INF, *rows[4][2:])
    rows[5] = (*rows[5][:5], "?", rows[5][6])
    return spark.createDataFrame(rows, "Name string, a double, b double, k double, c double, packer string, Malware int")


def test_malware_preparation(spark):
    trained = preprocess_malware(malware_rows(spark))
    s = trained.summary
    assert (s["rows_before"], s["rows_after"], s["invalid_records_removed"]) == (12, 9, 3)
    assert s["dropped_columns"] == ["Name", "packer", "k"] and trained.features == ["a", "b", "c"]
    assert s["features_discarded"] == 6 - s["pca_components"] and s["pca_variance_retained"] > 0.95
    assert trained.data.columns == [f"pca_{i + 1}" for i in range(s["pca_components"])] + ["malware"]
    tested = preprocess_malware(
        malware_rows(spark).drop("Malware", "b").withColumn("extra", F.lit(2)), "test", trained.stages, trained.features
    )
    t = tested.summary
    assert t["label_added"] and t["missing_features_filled"] == ["b"] and set(t["extra_features_dropped"]) == {"k", "extra"}
    assert tested.data.columns == trained.data.columns and tested.data.count() == 9
    with pytest.raises(ValueError):
        preprocess_malware(malware_rows(spark).drop("Malware"))
    with pytest.raises(ValueError):
        preprocess_malware(malware_rows(spark), "test")

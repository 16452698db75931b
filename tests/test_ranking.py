import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatloom.operators import joins, ranking
from threatloom.operators.encode import class_mapping, encode_categoricals, scaling_parameters, standardise
from threatloom.operators.split import random_sample, range_digits, stratified_split


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(
        {
            "id": np.arange(3000),
            "key": np.where(rng.random(3000) < 0.4, "hot", rng.integers(0, 20, 3000).astype(str)),
            "x": rng.integers(0, 400, 3000).astype(float),
        }
    )
    return spark.createDataFrame(frame), frame


@pytest.mark.parametrize("blocks", [1, 7, 50])
def test_row_numbers(skewed, blocks):
    frame, expected = skewed
    got = ranking.row_numbers(frame, ["key"], F.col("x"), "rn", ["id"], blocks).toPandas()
    want = expected.sort_values(["x", "id"])
    want["rn"] = want.groupby("key").cumcount() + 1
    merged = got.merge(want[["id", "rn"]], on="id")
    assert len(merged) == len(expected) and (merged["rn_x"] == merged["rn_y"]).all()


def test_running_sums_without_key_descending(skewed):
    frame, expected = skewed
    got = ranking.running_sums(frame, [], -F.col("x"), {"total": F.col("x")}, ["id"], 9).toPandas()
    want = expected.sort_values(["x", "id"], ascending=[False, True])
    want["total"] = want["x"].cumsum()
    merged = got.merge(want[["id", "total"]], on="id")
    assert np.allclose(merged["total_x"], merged["total_y"])


def test_null_keys_are_a_group(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "k string, v int")
    got = ranking.row_numbers(rows, ["k"], F.col("v"), "rn").collect()
    assert sorted((r["k"] or "", r["rn"]) for r in got) == [("", 1), ("", 2), ("a", 1)]


def test_percentiles(skewed):
    frame, expected = skewed
    got = ranking.exact_percentiles(frame, ["key"], "x", {"p95": 0.95, "median": 0.5}).toPandas()
    for _, row in got.iterrows():
        values = expected[expected["key"] == row["key"]]["x"]
        assert row["p95"] == pytest.approx(np.percentile(values, 95))
        assert row["median"] == pytest.approx(np.percentile(values, 50))
    one = ranking.exact_percentiles(frame, [], "x", {"p95": 0.95}).first()
    assert one["p95"] == pytest.approx(np.percentile(expected["x"], 95))


def test_codes_are_sorted_positions(spark):
    names = [f"b{i}" for i in range(50)] + ["B", "é", "a"] * 4
    frame = spark.createDataFrame([(n,) for n in names], "label string").repartition(5)
    got = class_mapping(frame, "label").orderBy("encoded_value").collect()
    assert [r["original_label"] for r in got] == sorted(set(names))
    assert [r["encoded_value"] for r in got] == list(range(len(set(names))))


@pytest.mark.parametrize("limit", [10_000, 2])
def test_encoding_is_the_same_with_few_and_many_categories(spark, monkeypatch, limit):
    values = [*"dbaacd", None, "z", None]
    frame = spark.createDataFrame([(n, n, i) for i, n in enumerate(values)], "`c.1` string, d string, i int")
    monkeypatch.setattr("threatloom.operators.joins.checked_broadcast.__defaults__", (limit,))
    got = encode_categoricals(frame, ["c.1", "d"]).orderBy("i").collect()
    assert [r["c.1"] for r in got] == [3, 1, 0, 0, 2, 3, 4, 5, 4] == [r["d"] for r in got]


def test_population_scaling_and_constants(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (5.0, 5.0)], "a double, b double")
    parameters = scaling_parameters(frame, ["a", "b"])
    assert parameters["a"] == pytest.approx((3.0, np.std([1, 3, 5])))
    assert parameters["b"] == (5.0, 1.0)
    got = standardise(frame, ["a", "b"]).orderBy("a").collect()
    assert got[0]["a"] == pytest.approx(-2 / np.std([1, 3, 5])) and got[0]["b"] == 0.0


def test_ranges_grow_with_the_rows():
    assert [range_digits(n) for n in (0, 10**7, 10**8, 10**12)] == [1, 1, 2, 5]


@pytest.mark.parametrize("digits", [None, 1, 4])
def test_split_takes_a_fifth_of_each_class(skewed, digits):
    frame, expected = skewed
    split = stratified_split(frame, "key", "id", digits=digits)
    got = split.toPandas()
    assert len(got) == len(expected) and got["id"].is_unique
    for _, group in got.groupby("key"):
        assert group["is_test"].sum() == int(len(group) * 0.2 + 0.5)
    again = stratified_split(frame.repartition(7), "key", "id").toPandas()
    assert set(got[got.is_test]["id"]) == set(again[again.is_test]["id"])


def test_split_keeps_tiny_and_null_classes(spark):
    rows = spark.createDataFrame([(i, None if i < 5 else "x") for i in range(7)], "id int, y string")
    got = stratified_split(rows, "y", "id").toPandas()
    assert len(got) == 7 and got[got.y.isna()]["is_test"].sum() == 1 and not got[got.y == "x"]["is_test"].any()


def test_sample_is_repeatable(skewed):
    frame, _ = skewed
    first = [r["id"] for r in random_sample(frame, "id").collect()]
    assert len(first) == 20 and first == [r["id"] for r in random_sample(frame.repartition(3), "id").collect()]


def test_sizes_are_checked(spark):
    frame = spark.range(50)
    assert joins.held(frame, 10).count() == 50 == joins.held(frame, 100).count()
    plan = joins.checked_broadcast(frame, 10)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" not in plan
    plan = joins.checked_broadcast(frame, 100)._jdf.queryExecution().logical().toString()
    assert "hint" in plan.lower()

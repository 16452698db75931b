"""Category codes and scaling of intrusion data, saved and used on new rows; forests as tables."""

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from threatloom.operators import models
from threatloom.operators.encode import CategoryEncoder, category_table
from threatloom.operators.forest_table import forest_nodes, walk_forest
from threatloom.plans import preprocess

RAW = "`proto.name` string, `state` string, bytes bigint, label string"
ROWS = [("tcp", "SF", 10, "normal"), ("udp", "S0", 20, "neptune"), ("icmp", "SF", 40, "normal"), ("tcp", "REJ", 90, "satan")]


def test_codes_of_all_columns_from_one_table(spark):
    rows = spark.createDataFrame([("b", "x"), ("a", None), ("b", "nan"), (None, "y")], "one string, `t.wo` string")
    found = {tuple(r) for r in category_table(rows, ["one", "t.wo"]).drop("rows").collect()}
    assert found == {("one", "a", 0), ("one", "b", 1), ("one", "nan", 2), ("t.wo", "nan", 0), ("t.wo", "x", 1), ("t.wo", "y", 2)}


def test_unseen_categories(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "c string")
    new = spark.createDataFrame([("b",), ("z",), ("q",), (None,)], "c string")
    assert [r[0] for r in CategoryEncoder(["c"]).fit(rows).transform(new).collect()] == [1, 2, 2, 2]
    strict = CategoryEncoder(["c"], unseen="error").fit(rows)
    assert [r[0] for r in strict.transform(rows).orderBy("c").collect()] == [0, 1]
    with pytest.raises(Exception, match="was not learnt: (z|q|nan)"):
        strict.transform(new).collect()


def test_new_rows_are_prepared_as_those_of_the_first_run(spark, tmp_path):
    first = preprocess.preprocess_network(spark.createDataFrame(ROWS, RAW), "CICIDS2017")
    path = str(tmp_path / "stages")
    preprocess.save_model(spark, first.stages, first.features, path)
    stages, columns = preprocess.load_model(spark, path)
    assert columns == ["proto.name", "state", "bytes"]
    again = preprocess.preprocess_network(spark.createDataFrame(ROWS, RAW), "again", stages=stages, training_columns=columns)
    order = lambda df: sorted(map(tuple, df.select("`proto.name`", "state", "bytes", "y").collect()))
    assert order(again.data) == order(first.data)
    new = spark.createDataFrame([("gre", "SF", 40, "normal")], RAW).select("bytes", "`proto.name`", "state", "label")
    row = preprocess.preprocess_network(new, "new", stages=stages, training_columns=columns).data.first()
    codes = np.array([1, 2, 0, 1])
    assert row["proto.name"] == pytest.approx((3 - codes.mean()) / codes.std()) and row["y"] == 0
    amounts = np.array([10, 20, 40, 90])
    assert row["bytes"] == pytest.approx((40 - amounts.mean()) / amounts.std())
    model = PipelineModel(first.stages)
    assert model.stages[0].getOrDefault("columns") == ["proto.name", "state"]


def test_names_with_dots_are_reduced_too(spark):
    rng = np.random.default_rng(2)
    rows = [(f"h{i}", *map(float, rng.standard_normal(3)), i % 2) for i in range(40)]
    raw = spark.createDataFrame(rows, "hash string, a double, `a.1` double, `b.c` double, malware int")
    done = preprocess.preprocess_malware(raw)
    assert done.data.count() == 40 and done.features == ["a", "a.1", "b.c"]
    test = preprocess.preprocess_malware(raw.drop("a"), "test", done.stages, done.features)
    assert test.summary["missing_features_filled"] == ["a"] and test.data.count() == 40


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(11)
    columns = [f"f{i}" for i in range(6)]
    rows = [(i, f"c{i % 3}", *map(float, rng.standard_normal(6) + (i % 3) * np.array([1, 0, 0.5, 0, 0, 1]))) for i in range(300)]
    data = spark.createDataFrame(rows, "id bigint, attack_type string, " + ", ".join(f"{c} double" for c in columns)).checkpoint()
    model = models.fit_traffic_model(data, columns, "attack_type", trees=12, depth=6)
    return data, model


WALK = """with recursive walk as (
  select s.id, t.tree, 0 as node, s.x from scaled s, (select distinct tree from nodes) t
  union all
  select w.id, w.tree, cast(case when w.x[cast(n.feature as bigint) + 1] <= n.threshold then n."left" else n."right" end as int), w.x
  from walk w join nodes n on n.tree = w.tree and n.node = w.node where n."left" is not null
), votes as (
  select w.id, generate_subscripts(n.shares, 1) as class, unnest(n.shares) as share
  from walk w join nodes n on n.tree = w.tree and n.node = w.node where n.shares is not null
)
select id, class - 1 as class, avg(share) as probability from votes group by all order by id, class"""


def test_a_walk_in_sql_gives_the_model_s_probabilities(spark, forest):
    data, model = forest
    nodes = forest_nodes(spark, models.forest_of(model)).toPandas()  # noqa: F841
    scored = model.transform(data)
    scaled = scored.select("id", vector_to_array("scaled").alias("x")).toPandas()  # noqa: F841
    walked = {}
    for i, c, p in duckdb.sql(WALK).fetchall():
        walked.setdefault(i, {})[c] = p
    classes = models.classes_of(model)
    for r in scored.select("id", "predicted_attack", vector_to_array("probability").alias("p")).collect():
        own = walked[r["id"]]
        assert [own.get(c, 0.0) for c in range(3)] == pytest.approx(list(r["p"]))
        assert classes[max(range(3), key=lambda c: own.get(c, 0.0))] == r["predicted_attack"]


def test_a_walk_by_joins_gives_them_too(spark, forest):
    data, model = forest
    scored = model.transform(data)
    walked = walk_forest(scored.select("id", "scaled"), "id", "scaled", forest_nodes(spark, models.forest_of(model)))
    both = walked.join(scored.select("id", vector_to_array("probability").alias("p")), "id").collect()
    assert len(both) == 300
    for r in both:
        assert list(r["probabilities"]) == pytest.approx(list(r["p"]))


def test_cases_of_several_groups_in_one_run(spark, forest):
    data, model = forest
    groups = {c: data.where(F.col("attack_type") == c).limit(3).drop("attack_type").withColumn("name", F.concat(F.lit(c), "id")) for c in ("c0", "c1")}
    groups["short"] = spark.createDataFrame([("s", 0.5)], "name string, f0 double")
    found = models.run_cases(groups, model).collect()
    assert sorted(r["group"] for r in found) == ["c0"] * 3 + ["c1"] * 3 + ["short"]
    single = {r["name"]: r for g in ("c0", "c1") for r in models.case_summary(models.rank_traffic(groups[g], model), "name").collect()}
    for r in found:
        if r["group"] != "short":
            assert (r["predicted_attack"], r["top_class"]) == (single[r["name"]]["predicted_attack"], single[r["name"]]["top_class"])


def counted(spark, rows, schema):
    """Rows that count how often they are read."""
    reads = spark.sparkContext.accumulator(0)

    def seen(row):
        reads.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), schema), reads


def test_preparation_reads_raw_rows_at_most_three_times(spark):
    rng = np.random.default_rng(3)
    rows = [(f"h{i}", *map(float, rng.standard_normal(4)), 1.0, i % 2) for i in range(60)]
    raw, reads = counted(spark, rows, "hash string, a double, b double, c double, d double, same double, malware int")
    done = preprocess.preprocess_malware(raw)
    assert done.data.collect() and done.summary["dropped_columns"] == ["hash", "same"] and done.summary["rows_before"] == 60
    assert reads.value <= 3 * 60
    raw, reads = counted(spark, [(*r[:1], f"s{i % 4}", *r[2:]) for i, r in enumerate(ROWS * 15)], RAW)
    prepared = preprocess.preprocess_network(raw, "CICIDS2017")
    values = prepared.data.collect()
    assert reads.value <= 3 * 60 and prepared.summary["rows_after"] == len(values) == 60
    for c in ("proto.name", "state", "bytes"):
        column = np.array([r[c] for r in values])
        assert abs(column.mean()) < 1e-9 and column.std() == pytest.approx(1)


def test_models_are_fitted_on_a_bounded_number_of_rows(spark):
    from threatloom.operators.split import stratified_split, take_per_class

    rows = spark.range(5000).withColumn("label", F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 3 == 0, None).otherwise("most"))
    for digits in (1, 2):
        taken = take_per_class(rows, "label", "id", 150, digits=digits)
        assert {tuple(r) for r in taken.groupBy("label").count().collect()} == {("rare", 100), (None, 150), ("most", 150)}
    again = take_per_class(rows.repartition(7), "label", "id", 150)
    assert again.exceptAll(take_per_class(rows, "label", "id", 150)).count() == 0
    assert stratified_split(rows, "label", "id").where("is_test").count() == round(0.2 * 5000)
    assert take_per_class(rows.limit(0), "label", "id", 150).count() == 0

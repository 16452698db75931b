"""Oversampling, PCA, classifiers and their evaluation."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.catalog import standins as S
from threatloom.fixed_values import (
    EVALUATION_THRESHOLD,
    NET_WEIGHT,
    PCA_VARIANCE_TARGET,
    PE_FEATURES,
    RF_WEIGHT,
    SERVING_THRESHOLD,
)
from threatloom.functions import pe
from threatloom.functions.severity import scan_severity
from threatloom.operators import evaluation as E
from threatloom.operators import models
from threatloom.operators.forest_table import forest_nodes, walk_forest
from threatloom.operators.neighbours import balance_classes, nearest_neighbours
from threatloom.operators.projection_forest import forest_neighbours
from threatloom.plans import scanning, training
from threatloom.plans.preprocess import preprocess_malware

# Each model is fitted once per session and test folder; the queries below share it.
_KEPT = 4


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the five nearest neighbours of every vector."""
    found = nearest_neighbours(S.vectors(spark, sf_dir), "vec_id", "embedding")
    return found.select("vec_id", "rank", F.round("distance", 5).alias("distance"))


NEAREST = """with pairs as (
  select a.vec_id, row_number() over (partition by a.vec_id
      order by list_distance(cast(a.embedding as double[]), cast(b.embedding as double[]))) as rank,
    list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as distance
  from embeddings a join embeddings b on a.vec_id <> b.vec_id
)
select vec_id, cast(rank as int) as rank, round(distance, 5) as distance from pairs where rank <= 5"""


def neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class how many neighbours the forest gives, how many of them no row is nearer than in the exact
    search, and whether those are nine tenths."""
    vectors = S.vectors(spark, sf_dir)
    found = forest_neighbours(vectors, "vec_id", "embedding", group="malware")
    exact = [
        nearest_neighbours(vectors.where(F.col("malware") == c), "vec_id", "embedding").select(
            "vec_id", "neighbour", F.lit(True).alias("hit")
        )
        for c in (0, 1)
    ]
    both = found.join(exact[0].union(exact[1]), ["vec_id", "neighbour"], "left")
    counted = both.join(vectors.select("vec_id", "malware"), "vec_id").groupBy("malware").agg(
        F.count("*").alias("neighbours"), F.min("distance").alias("least"), F.count_if("hit").alias("hits")
    )
    return counted.select(
        "malware", "neighbours", F.round("least", 5).alias("least"),
        (F.col("hits") >= 0.9 * F.col("neighbours")).alias("recalled"),
    )


#: The nearest pair of a class is found whatever a tree parts, and 0.9 is the recall that is promised.
NEIGHBOUR_RECALL = """with vectors as (
  select vec_id, cast(label = 0 as int) as malware, cast(embedding as double[]) as v from embeddings
), nearest as (
  select a.malware, min(list_distance(a.v, b.v)) as least
  from vectors a join vectors b on a.malware = b.malware and a.vec_id < b.vec_id group by a.malware
), sizes as (
  select malware, count(*) as n from vectors group by malware
)
select malware, n * least(5, n - 1) as neighbours, round(least, 5) as least, true as recalled
from sizes join nearest using (malware)"""


def balanced_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per class after oversampling, and how many of them lie within the range of their class's
    own rows, as every row between two of them must."""
    vectors = S.vectors(spark, sf_dir)
    balanced = balance_classes(vectors, "vec_id", "embedding", "malware")
    # One row of 64 least and greatest values per class; there are two classes.
    ranges = vectors.groupBy("malware").agg(
        F.array(*[F.min(c) for c in S.VECTOR_COLUMNS]).alias("low"),
        F.array(*[F.max(c) for c in S.VECTOR_COLUMNS]).alias("high"),
    )
    margin = 1e-9
    above = F.zip_with("embedding", "low", lambda v, low: v >= low - margin)
    below = F.zip_with("embedding", "high", lambda v, high: v <= high + margin)
    within = F.forall(above, lambda ok: ok) & F.forall(below, lambda ok: ok)
    return balanced.join(F.broadcast(ranges), "malware").groupBy("malware", "synthetic").agg(
        F.count("*").alias("n"),
        F.count_if(F.size("embedding") == S.VECTOR_SIZE).alias("whole"),
        F.count_if(within).alias("within"),
    )


BALANCED_CLASSES = """with sizes as (
  select cast(label = 0 as int) as malware, count(*) as n from embeddings group by 1
)
select malware, false as synthetic, n, n as whole, n as within from sizes
union all
select malware, true, (select max(n) from sizes) - n, (select max(n) from sizes) - n, (select max(n) from sizes) - n
from sizes where n < (select max(n) from sizes)"""


def pca_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared length of each scaled vector, from its coordinates on all components."""
    vectors = S.vectors(spark, sf_dir)
    scaling = models.fit_scaled_vectors(vectors, S.VECTOR_COLUMNS)
    scaled = models.apply_stages(vectors, scaling)
    stages, _, _ = models.fit_pca(scaled, S.VECTOR_SIZE)
    values = vector_to_array("pca_all")
    squared = F.aggregate(F.transform(values, lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
    return models.apply_stages(scaled, stages).select("vec_id", F.round(squared, 4).alias("squared_norm"))


PCA_NORMS = """with entries as (
  select vec_id, unnest(range(64)) as i, unnest(cast(embedding as double[])) as x from embeddings
), scaled as (
  select vec_id, (x - avg(x) over (partition by i)) / stddev_pop(x) over (partition by i) as z from entries
)
select vec_id, round(sum(z * z), 4) as squared_norm from scaled group by vec_id"""


# Models are not equal bit for bit to other libraries', so the queries below return what must hold
# of every model: which rows are scored, and facts about each result.


def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the components kept are the fewest above 95 % of the variance, and all of them hold all."""
    vectors = S.vectors(spark, sf_dir)
    scaling = models.fit_scaled_vectors(vectors, S.VECTOR_COLUMNS)
    scaled = models.apply_stages(vectors, scaling)
    stages, _, keep = models.fit_pca(scaled, S.VECTOR_SIZE)
    names = [f"pca_{i + 1}" for i in range(S.VECTOR_SIZE)]
    projected = models.vector_columns(models.apply_stages(scaled, stages), "pca_all", names)
    variance = projected.agg(F.array(*[F.var_pop(n) for n in names]).alias("v"))

    def share(components: int):
        kept = F.slice("v", 1, components)
        return F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / S.VECTOR_SIZE

    return variance.select(
        F.size("v").alias("components"),
        F.round(share(S.VECTOR_SIZE), 6).alias("share_of_all"),
        (share(keep) > PCA_VARIANCE_TARGET).alias("enough"),
        (share(keep - 1) <= PCA_VARIANCE_TARGET).alias("no_more_than_needed"),
        F.forall(F.sequence(F.lit(1), F.lit(S.VECTOR_SIZE - 1)), lambda i: F.element_at("v", i) >= F.element_at("v", i + 1) - 1e-9).alias("falling"),
    )


PCA_VARIANCE = """select len(any_value(embedding)) as components, 1.0::double as share_of_all, true as enough,
  true as no_more_than_needed, true as falling
from embeddings"""


def malware_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The malware preparation to its end: rows per class, and how many have all components."""
    prepared = preprocess_malware(S.executables(spark, sf_dir))
    names = [c for c in prepared.data.columns if c != "malware"]
    whole = F.forall(F.array(*names), lambda v: v.isNotNull() & ~F.isnan(v))
    return prepared.data.groupBy("malware").agg(
        F.count("*").alias("n"),
        F.count_if(whole).alias("whole"),
        F.lit(len(names) == prepared.summary["features_used"]).alias("all_components"),
    )


MALWARE_PCA = f"""with {S.EXECUTABLES}
select Malware as malware, count(*) as n, count(*) as whole, true as all_components from clean group by 1"""


def malware_pca_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of a training run, and of a test run without label on its stages."""
    raw = S.executables(spark, sf_dir)
    trained = preprocess_malware(raw)
    tested = preprocess_malware(raw.drop("Malware", "ImageBase"), "test", trained.stages, trained.features)
    both = trained.summary_frame().unionByName(tested.summary_frame())
    retained = F.col("pca_variance_retained")
    return both.select(
        "dataset_name", "rows_before", "rows_after", "invalid_records_removed",
        F.array_join("dropped_columns", ",").alias("dropped_columns"),
        (F.col("features_used") == F.col("pca_components")).alias("components_used"),
        (F.col("features_used") + F.col("features_discarded")).alias("features"),
        ((retained > PCA_VARIANCE_TARGET) & (retained <= 1 + 1e-9)).alias("retained_enough"), "mode",
        "label_added", F.array_join("missing_features_filled", ",").alias("missing_features_filled"),
        F.array_join("extra_features_dropped", ",").alias("extra_features_dropped"),
    )


MALWARE_PCA_SUMMARY = f"""with {S.EXECUTABLES}, counts as (
  select (select count(*) from executables) as rows_before, (select count(*) from clean) as rows_after
)
select 'Malware Training' as dataset_name, rows_before, rows_after,
  rows_before - rows_after as invalid_records_removed, 'Name,packer,LoaderFlags' as dropped_columns,
  true as components_used, 8 as features, true as retained_enough, 'train' as mode, false as label_added,
  '' as missing_features_filled, '' as extra_features_dropped
from counts
union all
select 'Malware Test', rows_before, rows_after, rows_before - rows_after, 'Name,packer,LoaderFlags', true, 7, true,
  'test', true, 'ImageBase', 'LoaderFlags'
from counts"""


@lru_cache(maxsize=_KEPT)
def _traffic(spark: SparkSession, application: str, sf_dir: str) -> training.Trained:
    rows = S.vectors(spark, sf_dir).drop("embedding", "malware")
    return training.train_traffic(rows, "vec_id", S.VECTOR_COLUMNS)


def _trained_traffic(spark: SparkSession, sf_dir: str) -> training.Trained:
    return _traffic(spark, spark.sparkContext.applicationId, sf_dir)


def _classes(trained: training.Trained) -> list[str]:
    return models.classes_of(trained.model)


def traffic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row scored: a class of the training rows, with a probability no other class can exceed."""
    trained = _trained_traffic(spark, sf_dir)
    classes = _classes(trained)
    rows = S.vectors(spark, sf_dir).drop("embedding", "malware")
    return models.score_traffic(rows, trained.model).select(
        "vec_id", "attack_type", F.col("predicted_attack").isin(classes).alias("known_class"),
        F.col("confidence").between(1 / len(classes) - 1e-9, 1 + 1e-9).alias("confidence_fits"),
    )


TRAFFIC_SCORES = """select vec_id, 'attack' || label as attack_type, true as known_class, true as confidence_fits
from embeddings"""


def traffic_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest classes of every row: falling, of different classes, out of a whole distribution."""
    trained = _trained_traffic(spark, sf_dir)
    rows = S.vectors(spark, sf_dir).drop("embedding", "malware")
    ranked = models.rank_traffic(rows, trained.model)
    chances = F.transform("all_probabilities", lambda p: p["probability"])
    total = F.aggregate(chances, F.lit(0.0), lambda a, v: a + v)
    top = ranked.select(
        "vec_id", "all_probabilities", (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.posexplode("top_predictions").alias("at", "p"),
    )
    later = F.slice("all_probabilities", F.col("at") + 2, F.size("all_probabilities"))
    return top.select(
        "vec_id", (F.col("at") + 1).alias("rank"), "sums_to_one",
        F.forall(later, lambda q: q["probability"] <= F.col("p.probability")).alias("falling"),
        F.size(F.array_distinct(F.transform("all_probabilities", lambda q: q["class"]))).alias("classes"),
    )


TRAFFIC_RANKING = """with known as (select count(distinct label) as classes from embeddings)
select vec_id, cast(r as int) as rank, true as sums_to_one, true as falling, classes
from embeddings, known, range(1, 4) as ranks(r) where r <= classes"""


def traffic_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as a case: its prediction is the first of its ranking, its confidence that probability."""
    trained = _trained_traffic(spark, sf_dir)
    rows = S.vectors(spark, sf_dir).drop("embedding", "malware")
    summary = models.case_summary(models.rank_traffic(rows, trained.model), "vec_id")
    return summary.select(
        "vec_id", (F.col("predicted_attack") == F.col("top_class")).alias("prediction_is_first"),
        (F.abs(F.col("confidence") - F.col("top_probability")) < 1e-9).alias("confidence_is_largest"),
    )


TRAFFIC_CASES = "select vec_id, true as prediction_is_first, true as confidence_is_largest from embeddings"


def traffic_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature's importance lies between 0 and 1; all of them sum to 1."""
    trained = _trained_traffic(spark, sf_dir)
    found = models.feature_importances(trained.model, trained.columns)
    within = F.col("importance").between(0, 1)
    total = found.agg(F.lit("all").alias("feature"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("fits"))
    return found.select("feature", within.alias("fits")).union(total)


TRAFFIC_IMPORTANCE = f"""select 'f' || i as feature, true as fits from range({S.VECTOR_SIZE}) as t(i)
union all select 'all', true"""


def _report_facts(report: DataFrame, *keep: str) -> DataFrame:
    """Support of a report's rows, and whether its measures are shares."""
    shares = [F.col(m).between(0, 1 + 1e-9) for m in ("precision", "recall", "f1")]
    return report.select(*keep, "label", "support", (shares[0] & shares[1] & shares[2]).alias("shares_fit"))


def traffic_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report on the rows held back: a fifth of each class."""
    pairs = training.evaluate_traffic(_trained_traffic(spark, sf_dir))
    return _report_facts(E.classification_report(pairs))


# ``held`` are the rows held back: per class, a fifth of the rows in the order of a hash of their key.
def _held(label: str) -> str:
    return f"""held as (
  select * from (
    select vec_id, {label} as label,
      row_number() over (partition by {label} order by md5('42|' || vec_id), vec_id)
        <= floor(count(*) over (partition by {label}) * 0.2 + 0.5) as is_test
    from embeddings
  ) where is_test
)"""


_ATTACK = "'attack' || label"
_VERDICT = "case when label = 0 then 'Malware' else 'Benign' end"

TRAFFIC_EVALUATION = f"""with {_held(_ATTACK)}
select label, count(*) as support, true as shares_fit from held group by label
union all
select name, count(*), true from held, (values ('macro avg'), ('weighted avg')) as t(name) group by name"""


def traffic_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest as a table of nodes, walked by joins: per row held back, whether its class and probability
    are those the model gives, and how many probabilities it has."""
    trained = _trained_traffic(spark, sf_dir)
    scored = trained.model.transform(trained.test)
    nodes = forest_nodes(spark, models.forest_of(trained.model))
    walked = walk_forest(scored.select("vec_id", "scaled"), "vec_id", "scaled", nodes)
    both = walked.join(scored.select("vec_id", "prediction", vector_to_array("probability").alias("given")), "vec_id")
    own = F.col("probabilities")
    apart = F.exists(F.zip_with(own, "given", lambda a, b: F.abs(a - b) > 1e-9), lambda far: far)
    best = F.array_position(own, F.array_max(own)) - 1
    return both.select(
        "vec_id", F.size(own).alias("classes"), (~apart).alias("same_probability"),
        (F.get(own, F.col("prediction").cast("int")) >= F.array_max(own) - 1e-9).alias("same_class"),
        (best >= 0).alias("decided"),
    )


TRAFFIC_WALK = f"""with {_held(_ATTACK)}
select vec_id, (select count(distinct label) from embeddings) as classes, true as same_probability,
  true as same_class, true as decided
from held"""


def model_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model the rows that were not held back, the share of their largest class, and whether the model
    is right on more of them than one that always says that class."""
    vectors = S.vectors(spark, sf_dir).drop("embedding")
    traffic, malware = _trained_traffic(spark, sf_dir), _trained_malware(spark, sf_dir)
    own = vectors.join(traffic.test.select("vec_id"), "vec_id", "left_anti")
    scored = models.score_traffic(own.drop("malware"), traffic.model)
    own = vectors.join(malware.test.select("vec_id"), "vec_id", "left_anti")
    judged = training.evaluate_malware(malware.model, own.drop("attack_type"))
    parts = [("traffic", E.pair_counts(scored, "attack_type", "predicted_attack"))]
    parts += [(scorer, E.pair_counts(judged, "actual", f"{scorer}_verdict")) for scorer in ("rf", "net")]
    rows = []
    for name, pairs in parts:
        right = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
        by_truth = pairs.groupBy("truth").agg(F.sum("n").alias("n"), right.alias("right"))
        total = by_truth.agg(F.sum("n").alias("rows"), F.max("n").alias("largest"), F.sum("right").alias("right"))
        rows.append(
            total.select(
                F.lit(name).alias("model"), "rows", F.round(F.col("largest") / F.col("rows"), 9).alias("floor"),
                (F.col("right") > F.col("largest")).alias("reached"),
            )
        )
    return reduce(DataFrame.union, rows)


MODEL_FLOORS = f"""with traffic as (
  with {_held(_ATTACK)}
  select 'attack' || e.label as label, count(*) as n from embeddings e where vec_id not in (select vec_id from held) group by 1
), malware as (
  with {_held(_VERDICT)}
  select e.label = 0 as label, count(*) as n from embeddings e where vec_id not in (select vec_id from held) group by 1
)
select 'traffic' as model, cast(sum(n) as bigint) as rows, round(max(n) / sum(n), 9) as floor, true as reached from traffic
union all
select model, cast(sum(n) as bigint), round(max(n) / sum(n), 9), true from malware, (values ('rf'), ('net')) as t(model) group by model"""


def traffic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity per class on the rows held back: its weight, and the score from its counts."""
    scores = E.severity_scores(training.evaluate_traffic(_trained_traffic(spark, sf_dir)))
    expected = (F.col("tp") - 2 * F.col("fn") - F.col("fp")) / (F.col("tp") + F.col("fn"))
    return scores.select(
        "label", F.round("weight", 9).alias("weight"), (F.col("tp") + F.col("fn")).alias("support"),
        (F.abs(F.col("class_severity") - expected) < 1e-9).alias("severity_fits"),
    )


TRAFFIC_SEVERITY = f"""with {_held(_ATTACK)}
select label, round(1.0::double / count(*), 9) as weight, count(*) as support, true as severity_fits
from held group by label"""


@lru_cache(maxsize=_KEPT)
def _malware(spark: SparkSession, application: str, sf_dir: str) -> training.Trained:
    rows = S.vectors(spark, sf_dir).drop("embedding", "attack_type")
    return training.train_malware(rows, "vec_id", S.VECTOR_COLUMNS)


def _trained_malware(spark: SparkSession, sf_dir: str) -> training.Trained:
    return _malware(spark, spark.sparkContext.applicationId, sf_dir)


def malware_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scorers on the rows held back: each verdict follows from its probability at 0.5."""
    trained = _trained_malware(spark, sf_dir)
    found = training.evaluate_malware(trained.model, trained.test)

    def follows(scorer: str):
        score = F.col(f"{scorer}_score")
        verdict = F.when(score >= EVALUATION_THRESHOLD, "Malware").otherwise("Benign")
        return (score.between(0, 1) & (F.col(f"{scorer}_verdict") == verdict)).alias(f"{scorer}_fits")

    return found.select("vec_id", "actual", follows("rf"), follows("net"))


MALWARE_EVALUATION = f"""with {_held(_VERDICT)}
select vec_id, label as actual, true as rf_fits, true as net_fits from held"""


def malware_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of both scorers on the rows held back."""
    trained = _trained_malware(spark, sf_dir)
    found = training.evaluate_malware(trained.model, trained.test)
    reports = [
        training.malware_metrics(found, scorer).withColumn("scorer", F.lit(scorer))
        for scorer in ("rf", "net")
    ]
    return _report_facts(reports[0].unionByName(reports[1]), "scorer")


MALWARE_REPORT = f"""with {_held(_VERDICT)}, scorers as (select * from (values ('rf'), ('net')) as t(scorer))
select scorer, label, count(*) as support, true as shares_fit from held, scorers group by scorer, label
union all
select scorer, name, count(*), true
from held, scorers, (values ('macro avg'), ('weighted avg')) as t(name) group by scorer, name"""


def malware_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of both scorers on the rows held back: a share that turns round with the scores."""
    trained = _trained_malware(spark, sf_dir)
    found = training.evaluate_malware(trained.model, trained.test)

    def facts(scorer: str) -> DataFrame:
        area = E.roc_auc(found, "malware", f"{scorer}_score").first()["auc"]
        turned = found.withColumn("turned", -F.col(f"{scorer}_score"))
        return E.roc_auc(turned, "malware", "turned").select(
            F.lit(scorer).alias("scorer"),
            F.lit(area).between(0, 1).alias("is_share"),
            (F.abs(F.col("auc") + area - 1) < 1e-6).alias("turns_round"),
        )

    return facts("rf").unionByName(facts("net"))


MALWARE_AUC = """select * from (values ('rf', true, true), ('net', true, true)) as t(scorer, is_share, turns_round)
where exists (select * from embeddings)"""


def malware_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble verdict of every row at the serving threshold, recomputed from the two scores."""
    trained = _trained_malware(spark, sf_dir)
    rows = S.vectors(spark, sf_dir).drop("embedding", "attack_type")
    rf, net = F.col("prediction.random_forest.probability"), F.col("prediction.lstm.probability")
    ensemble = F.col("prediction.ensemble")
    mean = RF_WEIGHT * rf + NET_WEIGHT * net
    verdict = F.when(F.least(rf, net, mean) >= SERVING_THRESHOLD, "Malware").otherwise("Benign")
    return models.score_malware(rows, trained.model).select(
        "vec_id", "malware",
        (F.abs(ensemble["probability"] - mean) < 1e-9).alias("mean_fits"),
        (F.abs(ensemble["confidence"] - 2 * F.abs(mean - 0.5)) < 1e-9).alias("confidence_fits"),
        ((ensemble["prediction"] == verdict) & (ensemble["final_prediction"] == verdict)).alias("verdict_fits"),
    )


MALWARE_VERDICTS = """select vec_id, cast(label = 0 as int) as malware, true as mean_fits, true as confidence_fits,
  true as verdict_fits
from embeddings"""


def scanned_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executables scanned from bytes to verdict, with a model fitted on their header fields."""
    programs = S.programs(spark, sf_dir)
    toxic = S.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("malware"))
    labelled = pe.header_fields(programs).join(toxic, "doc_id").select("doc_id", "malware", *PE_FEATURES)
    trained = training.train_malware(
        labelled.withColumns({c: F.col(c).cast("double") for c in PE_FEATURES}),
        "doc_id", PE_FEATURES,
    )
    verdicts = scanning.scan(programs, trained.model, trained.columns)
    found = scanning.events(verdicts)
    contents = programs.select(F.col("path"), F.sha2("content", 256).alias("digest"))
    named = found.join(
        contents.select(F.substring_index("path", "/", -1).alias("file_name"), "digest"), "file_name", "left"
    )
    return named.select(
        "file_name", "file_size", (F.col("file_hash") == F.col("digest")).alias("hash_fits"),
        F.col("prediction").isin("Malware", "Benign").alias("verdict_known"),
        (F.col("severity") == scan_severity(F.col("prediction"))).alias("severity_fits"),
    )


# A program: two signatures' headers, the optional header, two section rows, its text, 64 zero bytes.
SCANNED_PROGRAMS = """select doc_id || '.exe' as file_name,
  octet_length(encode(text)) + 64 + 64 + 24 + 2 * 40 + case when doc_id % 2 = 1 then 240 else 224 end as file_size,
  true as hash_fits, true as verdict_known, true as severity_fits
from documents where text is not null"""


QUERIES = {
    "nearest_neighbours": (nearest, NEAREST),
    "neighbour_recall": (neighbour_recall, NEIGHBOUR_RECALL),
    "balanced_classes": (balanced_classes, BALANCED_CLASSES),
    "pca_norms": (pca_norms, PCA_NORMS),
    "pca_variance": (pca_variance, PCA_VARIANCE),
    "malware_pca": (malware_pca, MALWARE_PCA),
    "malware_pca_summary": (malware_pca_summary, MALWARE_PCA_SUMMARY),
    "traffic_scores": (traffic_scores, TRAFFIC_SCORES),
    "traffic_ranking": (traffic_ranking, TRAFFIC_RANKING),
    "traffic_cases": (traffic_cases, TRAFFIC_CASES),
    "traffic_importance": (traffic_importance, TRAFFIC_IMPORTANCE),
    "traffic_evaluation": (traffic_evaluation, TRAFFIC_EVALUATION),
    "traffic_walk": (traffic_walk, TRAFFIC_WALK),
    "model_floors": (model_floors, MODEL_FLOORS),
    "traffic_severity": (traffic_severity, TRAFFIC_SEVERITY),
    "malware_evaluation": (malware_evaluation, MALWARE_EVALUATION),
    "malware_report": (malware_report, MALWARE_REPORT),
    "malware_auc": (malware_auc, MALWARE_AUC),
    "malware_verdicts": (malware_verdicts, MALWARE_VERDICTS),
    "scanned_programs": (scanned_programs, SCANNED_PROGRAMS),
}

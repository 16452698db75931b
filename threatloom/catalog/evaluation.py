"""Quality of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.catalog import standins as S
from threatloom.functions import scoring
from threatloom.operators import evaluation as E


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_matrix(E.pair_counts(S.actions(spark, sf_dir)))


CONFUSION_MATRIX = f"""with {S.ACTIONS}, pairs as (
  select truth, predicted, count(*) as n from actions group by all
), labels as (select truth as label from actions union select predicted from actions)
select a.label as truth, b.label as predicted, coalesce(n, 0) as n
from labels a cross join labels b left join pairs on truth = a.label and predicted = b.label"""

SCORES = """pairs as (
  select truth, predicted, count(*) as n from actions group by all
), labels as (select truth as label from actions union select predicted from actions
), counts as (
  select label,
    coalesce(sum(n) filter (where truth = label and predicted = label), 0) as tp,
    coalesce(sum(n) filter (where truth = label and predicted <> label), 0) as fn,
    coalesce(sum(n) filter (where truth <> label and predicted = label), 0) as fp
  from labels left join pairs on truth = label or predicted = label group by label
), scores as (
  select label, tp, cast(tp + fn as bigint) as support,
    case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
    case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
    case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1
  from counts
)"""


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = E.classification_report(E.pair_counts(S.actions(spark, sf_dir)))
    return _round(report, "precision", "recall", "f1")


CLASSIFICATION_REPORT = f"""with {S.ACTIONS}, {SCORES}, report as (
  select label, precision, recall, f1, support from scores
  union all
  select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from scores
  union all
  select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), cast(sum(support) as bigint) from scores
)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support
from report"""


def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.overall_scores(E.pair_counts(S.actions(spark, sf_dir)))
    return _round(found, *found.columns)


OVERALL_SCORES = f"""with {S.ACTIONS}, {SCORES}
select round(sum(tp) / sum(support), 6) as accuracy,
  round(sum(precision * support) / sum(support), 6) as weighted_precision,
  round(sum(recall * support) / sum(support), 6) as weighted_recall,
  round(sum(f1 * support) / sum(support), 6) as weighted_f1
from scores"""


def severity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity per true class; predictions of other classes do not count."""
    found = E.severity_scores(E.pair_counts(S.actions(spark, sf_dir)))
    return _round(found, "weight", "class_severity")


_SEVERITY = """pairs as (
  select truth, predicted, count(*) as n from actions group by all
), labels as (select distinct truth as label from actions
), inside as (select * from pairs where predicted in (select label from labels)
), counts as (
  select label, (select cast(sum(n) as bigint) from pairs where truth = label) as support,
    cast(coalesce(sum(n) filter (where truth = label and predicted = label), 0) as bigint) as tp,
    cast(coalesce(sum(n) filter (where truth = label and predicted <> label), 0) as bigint) as fn,
    cast(coalesce(sum(n) filter (where truth <> label and predicted = label), 0) as bigint) as fp
  from labels left join inside on truth = label or predicted = label group by label
)"""

SEVERITY_SCORES = f"""with {S.ACTIONS}, {_SEVERITY}
select label, round(1 / support, 6) as weight, tp, fn, fp,
  round(1 / support * (tp - 2 * fn - fp), 6) as class_severity
from counts"""


def severity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.severity_score(E.pair_counts(S.actions(spark, sf_dir))), "severity_score")


SEVERITY_SCORE = f"""with {S.ACTIONS}, {_SEVERITY}
select round(sum(1 / support * (tp - 2 * fn - fp)), 6) as severity_score from counts"""

_ROC = f"""with {S.SCORED}, steps as (
  select score, count_if(truth = 1) as p, count_if(truth <> 1) as n from scored group by score
), upto as (
  select score, n, p, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as all_p, sum(n) over () as all_n
  from steps window w as (order by score desc)
)"""


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = E.roc_curve(S.scored(spark, sf_dir))
    finite = F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    return _round(points.select(finite.alias("threshold"), "fpr", "tpr"), "fpr", "tpr")


ROC_CURVE = f"""{_ROC}
select score as threshold, round(fp / all_n, 6) as fpr, round(tp / all_p, 6) as tpr from upto
union all select null, 0.0, 0.0"""


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.roc_auc(S.scored(spark, sf_dir)), "auc")


ROC_AUC = f"""{_ROC}
select round(sum(n * (tp - p / 2.0)) / (max(all_p) * max(all_n)), 6) as auc from upto"""


def event_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC over all line items: returned ones as truth, price as score."""
    item = S.table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("truth"), F.col("l_extendedprice").alias("score")
    )
    return _round(E.roc_auc(item), "auc")


EVENT_ROC_AUC = """with steps as (
  select l_extendedprice as score, count_if(l_returnflag = 'R') as p, count_if(l_returnflag <> 'R') as n
  from lineitem group by 1
), upto as (
  select *, sum(p) over (order by score desc) as tp, sum(p) over () as all_p, sum(n) over () as all_n
  from steps
)
select round(sum(n * (tp - p / 2.0)) / (cast(max(all_p) as double) * max(all_n)), 6) as auc from upto"""


def latency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per event type, its values read as milliseconds."""
    samples = S.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), F.col("value").alias("ms")
    )
    found = E.latency_statistics(samples)
    return _round(found, "total_ms", "avg_ms", "throughput_per_sec", "max_ms", "p95_ms")


LATENCY_STATISTICS = """select event_type as model, count(*) as samples, round(sum(value), 6) as total_ms,
  round(avg(value), 6) as avg_ms, round(count(*) / (sum(value) / 1000), 6) as throughput_per_sec,
  round(max(value), 6) as max_ms, round(quantile_cont(value, 0.95), 6) as p95_ms
from events group by 1"""


def joined_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of predictions kept in another table than the truth."""
    labels = S.table(spark, sf_dir, "labels")
    truth = labels.select("doc_id", F.col("toxic").alias("truth"))
    predictions = labels.select("doc_id", (1 - F.col("quality")).alias("predicted"))
    joined = E.join_truth(truth, predictions, "doc_id")
    found = E.overall_scores(E.pair_counts(joined))
    return _round(found.select("accuracy"), "accuracy")


JOINED_TRUTH = """select round(count_if(a.toxic = 1 - b.quality) / count(*), 6) as accuracy
from labels a join labels b using (doc_id)"""


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount and tax of line items as the two scorers' probabilities, near the threshold."""
    return S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(0.97 + F.col("l_discount") / 5, 4).alias("rf"),
        F.round(0.97 + F.col("l_tax") / 4, 4).alias("net"),
    )


def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _probabilities(spark, sf_dir).withColumn(
        "p", scoring.prediction_struct(F.col("rf"), F.col("net"))
    )
    return found.select(
        "l_orderkey", "l_linenumber",
        F.col("p.random_forest.prediction").alias("rf_verdict"),
        F.col("p.lstm.prediction").alias("net_verdict"),
        F.col("p.ensemble.final_prediction").alias("verdict"),
        F.round("p.ensemble.probability", 6).alias("probability"),
        F.round("p.random_forest.confidence", 6).alias("rf_confidence"),
        F.round("p.lstm.confidence", 6).alias("net_confidence"),
        F.round("p.ensemble.confidence", 6).alias("confidence"),
    )


ENSEMBLE_SCORES = """with p as (
  select l_orderkey, l_linenumber, round(0.97::double + l_discount / 5, 4) as rf,
    round(0.97::double + l_tax / 4, 4) as net
  from lineitem
), e as (select *, rf * 0.7::double + net * 0.3::double as both_ from p)
select l_orderkey, l_linenumber,
  case when rf >= 0.98::double then 'Malware' else 'Benign' end as rf_verdict,
  case when net >= 0.98::double then 'Malware' else 'Benign' end as net_verdict,
  case when rf >= 0.98::double and net >= 0.98::double and both_ >= 0.98::double then 'Malware'
    else 'Benign' end as verdict,
  round(both_, 6) as probability, round(abs(rf - 0.5) * 2, 6) as rf_confidence,
  round(abs(net - 0.5) * 2, 6) as net_confidence, round(abs(both_ - 0.5) * 2, 6) as confidence
from e"""


def prediction_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and prediction of the first ten documents."""
    return E.preview(S.scored(spark, sf_dir), "doc_id").select("doc_id", "truth", "predicted")


PREDICTION_PREVIEW = f"""with {S.SCORED}
select doc_id, truth, predicted from scored order by doc_id limit 10"""


QUERIES = {
    "confusion_matrix": (confusion_matrix, CONFUSION_MATRIX),
    "classification_report": (classification_report, CLASSIFICATION_REPORT),
    "overall_scores": (overall_scores, OVERALL_SCORES),
    "severity_scores": (severity_scores, SEVERITY_SCORES),
    "severity_score": (severity_score, SEVERITY_SCORE),
    "roc_curve": (roc_curve, ROC_CURVE),
    "roc_auc": (roc_auc, ROC_AUC),
    "event_roc_auc": (event_roc_auc, EVENT_ROC_AUC),
    "latency_statistics": (latency_statistics, LATENCY_STATISTICS),
    "joined_truth": (joined_truth, JOINED_TRUTH),
    "prediction_preview": (prediction_preview, PREDICTION_PREVIEW),
    "ensemble_scores": (ensemble_scores, ENSEMBLE_SCORES),
}

"""Jobs for spark-submit: python -m threatloom JOB --input PATH --output PATH [--model PATH]"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.fixed_values import PACKET_BATCH, TRAFFIC_FEATURES
from threatloom.operators import evaluation, flows, models
from threatloom.operators.encode import class_mapping
from threatloom.operators.joins import training_rows
from threatloom.operators.quality import align, non_numeric_columns, quoted, with_malware_label
from threatloom.plans import preprocess, scanning, traffic, training
from threatloom.session import build_session, shared_folder
from threatloom.sources import datasets, files, sinks
from threatloom.streaming import pipelines

KEY = "row_id"
# What makes two lines of a threat log the same event.
LOG_IDENTITY = ["@timestamp", "timestamp", "tool", "event_type", "host_name", "attack_type", "connection_key", "file_name", "file_hash"]


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with a number of their own, stored so that the number stays."""
    return training_rows(rows.withColumn(KEY, F.monotonically_increasing_id()))


def prepare_intrusions(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.dataset == "NSL-KDD":
        raw, rejected = datasets.split_rejected(datasets.checked_nsl_kdd(spark, a.input))
        raw = raw.withColumnRenamed("attack_type", "attack")
    else:
        raw, rejected = datasets.split_rejected(datasets.read_csv(spark, a.input))
    stages, columns = preprocess.load_model(spark, a.model) if a.mode == "test" else (None, None)
    done = preprocess.preprocess_network(raw, a.dataset, stages=stages, training_columns=columns)
    if a.model and a.mode == "train":
        preprocess.save_model(spark, done.stages, done.features, a.model)
    done.data.write.mode("overwrite").parquet(f"{a.output}/data")
    sinks.write_rejected(rejected, f"{a.output}/rejected")
    done.summary["rejected_records"] = rejected.count()
    sinks.write_summary(done.summary_frame(), f"{a.output}/summary")


def prepare_malware(spark: SparkSession, a: argparse.Namespace) -> None:
    raw = datasets.read_csv(spark, a.input)
    paths = {"source": a.input, "output": f"{a.output}/data", "pca": a.model, "scaler": a.model, "columns": f"{a.model}/columns"}
    if a.mode == "train":
        done = preprocess.preprocess_malware(raw, paths=paths)
        preprocess.save_model(spark, done.stages, done.features, a.model)
    else:
        stages, columns = preprocess.load_model(spark, a.model)
        done = preprocess.preprocess_malware(raw, "test", stages, columns, paths)
    sinks.write_csv(done.data, f"{a.output}/data", "overwrite")
    sinks.write_summary(done.summary_frame(), f"{a.output}/summary")


def train_traffic(spark: SparkSession, a: argparse.Namespace) -> None:
    _, checked = datasets.training_dataset(spark, a.input)
    raw, rejected = datasets.split_rejected(checked)
    sinks.write_rejected(rejected, f"{a.output}/rejected")
    rows = keyed(preprocess.prepare_training(raw))
    columns = [c for c in TRAFFIC_FEATURES if c in rows.columns]
    trained = training.train_traffic(rows, KEY, columns)
    preprocess.save_model(spark, trained.model.stages, columns, a.model)
    sinks.write_csv(class_mapping(rows, "attack_type"), f"{a.output}/class_mapping", "overwrite")
    pairs = training.evaluate_traffic(trained)
    sinks.write_csv(evaluation.classification_report(pairs), f"{a.output}/report", "overwrite")
    sinks.write_csv(evaluation.overall_scores(pairs), f"{a.output}/scores", "overwrite")
    sinks.write_csv(evaluation.confusion_matrix(pairs), f"{a.output}/confusion", "overwrite")
    sinks.write_csv(evaluation.severity_scores(pairs), f"{a.output}/severity", "overwrite")
    sinks.write_csv(models.feature_importances(trained.model, columns), f"{a.output}/importance", "overwrite")


def score_traffic(spark: SparkSession, a: argparse.Namespace) -> None:
    model, columns = preprocess.load_pipeline(spark, a.model)
    raw = datasets.read_csv(spark, a.input)
    others = [c for c in raw.columns if c not in columns]
    rows, _, _ = align(raw, columns, *others)
    sinks.write_csv(models.score_traffic(rows, model), a.output, "overwrite")


def train_malware(spark: SparkSession, a: argparse.Namespace) -> None:
    raw, _ = with_malware_label(datasets.read_csv(spark, a.input))
    rows = raw.drop(*[quoted(c) for c in non_numeric_columns(raw, "malware")])
    columns = [c for c in rows.columns if c != "malware"]
    trained = training.train_malware(keyed(rows), KEY, columns)
    preprocess.save_model(spark, trained.model.stages, columns, a.model)
    found = training.evaluate_malware(trained.model, trained.test)
    for scorer in ("rf", "net"):
        write_verdict_scores(found, scorer, a.output)
        sinks.write_csv(evaluation.roc_curve(found, "malware", f"{scorer}_score"), f"{a.output}/{scorer}_roc", "overwrite")


def evaluate_malware(spark: SparkSession, a: argparse.Namespace) -> None:
    model, columns = preprocess.load_pipeline(spark, a.model)
    raw, _ = with_malware_label(datasets.read_csv(spark, a.input))
    rows, _, _ = align(raw, columns, "malware")
    found = training.evaluate_malware(model, rows)
    sinks.write_csv(found.select("actual", "rf_verdict", "net_verdict"), f"{a.output}/verdicts", "overwrite")
    for scorer in ("rf", "net"):
        write_verdict_scores(found, scorer, a.output)


def write_verdict_scores(found: DataFrame, scorer: str, output: str) -> None:
    """Report, accuracy and weighted scores, confusion matrix and area under the curve of one scorer."""
    pairs = evaluation.pair_counts(found, "actual", f"{scorer}_verdict")
    sinks.write_csv(evaluation.classification_report(pairs), f"{output}/{scorer}_report", "overwrite")
    sinks.write_csv(evaluation.overall_scores(pairs), f"{output}/{scorer}_scores", "overwrite")
    sinks.write_csv(evaluation.confusion_matrix(pairs), f"{output}/{scorer}_confusion", "overwrite")
    sinks.write_csv(evaluation.roc_auc(found, "malware", f"{scorer}_score"), f"{output}/{scorer}_auc", "overwrite")


def run_cases(spark: SparkSession, a: argparse.Namespace) -> None:
    """CSV files of named cases, one file for each group, whose name is the file's."""
    model, columns = preprocess.load_pipeline(spark, a.model)
    cases = datasets.read_csv(spark, a.input)
    group = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    rows = cases.select("*", group.alias("group"))
    aligned, _, _ = align(rows, columns, "name", "group")
    ranked = models.rank_traffic(aligned, model)
    sinks.write_csv(models.case_summary(ranked, "name", "group"), a.output, "overwrite")


def scan(spark: SparkSession, a: argparse.Namespace) -> None:
    model, columns = preprocess.load_pipeline(spark, a.model)
    shared_folder(spark)
    verdicts = scanning.scan(files.read_corpus(spark, a.input), model, columns).checkpoint()  # three logs read it
    sinks.write_threat_log(scanning.events(verdicts), f"{a.output}/threat_log")
    sinks.write_analysis(scanning.shown(verdicts), f"{a.output}/results")
    lines = sinks.analysis_log(verdicts, F.col("features_analyzed"))
    sinks.write_analysis_log(lines, f"{a.output}/analysis_log")


def flow_features(spark: SparkSession, a: argparse.Namespace) -> None:
    found = flows.connection_flows(files.read_packets(spark, a.input))
    sinks.write_csv(flows.flow_export(found), a.output, "overwrite")


def classify_flows(spark: SparkSession, a: argparse.Namespace) -> None:
    model, _ = preprocess.load_pipeline(spark, a.model)
    found = traffic.classify(datasets.read_flow_features(spark, a.input), model)
    events = traffic.threat_events(found, a.host)
    sinks.write_results(found, f"{a.output}/results", a.batch)
    sinks.write_threat_log(events, f"{a.output}/threat_log")
    sinks.write_alerts(events, f"{a.output}/alerts")


def stream_flows(spark: SparkSession, a: argparse.Namespace) -> None:
    pipelines.flows_from_packets(spark, a.input, a.output, a.progress, a.every).awaitTermination()


def stream_capture(spark: SparkSession, a: argparse.Namespace) -> None:
    pipelines.flows_from_capture(
        spark, a.input, a.output, a.progress, f"{a.sensor} string", a.unit_size, a.every
    ).awaitTermination()


def stream_scores(spark: SparkSession, a: argparse.Namespace) -> None:
    model, _ = preprocess.load_pipeline(spark, a.model)
    start = pipelines.scores_from_flows if a.files == "plain" else pipelines.scores_from_units
    start(spark, a.input, model, a.output, a.progress, a.host, a.every).awaitTermination()


def index_log(spark: SparkSession, a: argparse.Namespace) -> None:
    pipelines.index_threat_log(spark, a.input, a.output, a.progress, a.every).awaitTermination()


def log_events(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The lines of a threat log with a time, as they arrive."""
    return pipelines.with_event_time(files.stream_threat_log(spark, a.input)).where("not parse_failed")


def index_once(spark: SparkSession, a: argparse.Namespace) -> None:
    identity = [c for c in log_events(spark, a).columns if c in LOG_IDENTITY]
    pipelines.index_once(
        log_events(spark, a), identity, a.output, a.progress, late=a.late, every=a.every
    ).awaitTermination()


def window_counts(spark: SparkSession, a: argparse.Namespace) -> None:
    ended(spark, a, lambda e: pipelines.counts_by_window(e, a.keys, a.output, a.progress, a.width, a.slide, late=a.late, every=a.every))


def sessions(spark: SparkSession, a: argparse.Namespace) -> None:
    ended(spark, a, lambda e: pipelines.sessions_by_key(e, a.keys, a.output, a.progress, a.gap, late=a.late, every=a.every))


def ended(spark: SparkSession, a: argparse.Namespace, start) -> None:
    """A stream with an interval goes on; with ``--ended`` its last windows come out, without they wait for more."""
    events = log_events(spark, a)
    if a.ended and not a.every:
        pipelines.run_to_end(events, start, f"{a.progress}-end")
    else:
        start(events).awaitTermination()


JOBS = {
    "prepare-intrusions": prepare_intrusions,
    "prepare-malware": prepare_malware,
    "train-traffic": train_traffic,
    "score-traffic": score_traffic,
    "train-malware": train_malware,
    "evaluate-malware": evaluate_malware,
    "scan": scan,
    "flow-features": flow_features,
    "classify-flows": classify_flows,
    "stream-flows": stream_flows,
    "run-cases": run_cases,
    "stream-capture": stream_capture,
    "stream-scores": stream_scores,
    "index-log": index_log,
    "index-once": index_once,
    "window-counts": window_counts,
    "sessions": sessions,
}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="threatloom", description="Security analytics jobs")
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--model", help="folder of a saved model")
    parser.add_argument("--dataset", default="CICIDS2017", help="name for the summary; NSL-KDD has no header")
    parser.add_argument("--mode", default="train", choices=["train", "test"])
    parser.add_argument("--host", default="sensor")
    parser.add_argument("--batch", default="0", help="name of the result folder of this batch")
    parser.add_argument("--progress", help="checkpoint folder of a stream")
    parser.add_argument("--sensor", default="sensor", help="column that tells sensors apart")
    parser.add_argument("--unit-size", type=int, default=PACKET_BATCH, help="packets of a capture unit")
    parser.add_argument("--files", default="units", choices=["units", "plain"], help="feature files with a ledger, or any")
    parser.add_argument("--keys", nargs="+", default=["severity"], help="columns that counts and sessions are by")
    parser.add_argument("--width", default="1 hour")
    parser.add_argument("--slide")
    parser.add_argument("--gap", default="30 minutes")
    parser.add_argument("--late", default="10 minutes", help="how late an event may come")
    parser.add_argument("--ended", action="store_true", help="the stream is over: its last windows come out too")
    parser.add_argument("--every", help="interval of a stream; without one it stops at the end of its input")
    parsed = parser.parse_args(arguments)
    JOBS[parsed.job](build_session(f"threatloom {parsed.job}"), parsed)


if __name__ == "__main__":
    main()

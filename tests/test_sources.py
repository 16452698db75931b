import datetime
import json

import pytest
from pyspark.sql import functions as F

from threatloom.fixed_values import NSL_KDD_COLUMNS
from threatloom.functions.times import normalise_time
from threatloom.sources import datasets, sinks
from threatloom.sources.files import read_summaries, read_threat_log, summary_overview
from threatloom.plans.preprocess import summary_frame
from threatloom.session import new_folder, shared_folder


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_null_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", "i,d,s,n, p \n1,1.5,x,1,\n2,NaN,NULL,?,\n3,inf,None,2,n/a\n")
    frame = datasets.read_csv(spark, path)
    assert frame.dtypes == [("i", "bigint"), ("d", "double"), ("s", "string"), ("n", "string"), (" p ", "double")]
    rows = [tuple(r) for r in frame.orderBy("i").collect()]
    assert rows == [(1, 1.5, "x", "1", None), (2, None, None, "?", None), (3, float("inf"), None, "2", None)]


def test_repeated_headers(spark, tmp_path):
    assert datasets.distinct_headers(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]
    frame = datasets.read_csv(spark, write(tmp_path / "a.csv", "a,a,b\n1,2,3\n"))
    assert frame.columns == ["a", "a.1", "b"] and tuple(frame.first()) == (1, 2, 3)


def test_nsl_kdd(spark, tmp_path):
    line = ",".join("tcp" if t == "string" else "1" for _, t in NSL_KDD_COLUMNS)
    frame = datasets.read_nsl_kdd(spark, write(tmp_path / "k.csv", f"{line}\n{line}\n"))
    assert frame.count() == 2 and len(frame.columns) == 42 and "difficulty" not in frame.columns


@pytest.mark.parametrize(
    "reader, header, label",
    [(datasets.read_cic_ids, "x, Label", " Label"), (datasets.read_unsw_nb15, "x,label,attack_cat", "attack_cat")],
)
def test_label_is_renamed(spark, tmp_path, reader, header, label):
    n = header.count(",")
    frame = reader(spark, write(tmp_path / "c.csv", f"{header}\n1{',z' * n}\n"))
    assert "attack_type" in frame.columns and label not in frame.columns


def test_first_dataset_found_wins(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        datasets.training_dataset(spark, str(tmp_path))
    write(tmp_path / "UNSW_NB15.csv", "x,attack_cat\n1,a\n")
    assert datasets.training_dataset(spark, str(tmp_path))[0] == "UNSW-NB15"
    write(tmp_path / "CIC_IDS_2017.csv", "x,Label\n1,a\n")
    assert datasets.training_dataset(spark, str(tmp_path))[0] == "CIC-IDS-2017"


def test_threat_log(spark, tmp_path):
    lines = [
        {"@timestamp": "2024-05-01T10:00:00.123456", "tool": "a"},
        {"timestamp": "2024-05-01T12:00:00+02:00", "tool": "b"},
        {"@timestamp": "soon", "tool": "c"},
        {"tool": "d", "file_size": 7},
    ]
    write(tmp_path / "log.json", "\n".join([*map(json.dumps, lines), "{bad", ""]))
    found = normalise_time(read_threat_log(spark, str(tmp_path / "log.json"))).collect()
    got = {r["tool"]: r for r in found}
    utc = datetime.datetime(2024, 5, 1, 10, 0)
    stamp = spark.createDataFrame([("x",)], "s string")
    assert len(found) == 5 and got[None]["bad_line"] == "{bad"
    micros = {
        r["tool"]: r["us"]
        for r in normalise_time(read_threat_log(spark, str(tmp_path / "log.json"))).select(
            "tool", F.unix_micros("event_time").alias("us")
        ).collect()
    }
    base = int(utc.replace(tzinfo=datetime.timezone.utc).timestamp() * 1_000_000)
    assert micros["a"] == base + 123456 and micros["b"] == base
    assert [got[k]["parse_failed"] for k in "abcd"] == [False, False, True, True] and got["d"]["file_size"] == 7


def test_written_events_are_stamped(spark, tmp_path):
    events = spark.createDataFrame([("a", "old")], "tool string, `@timestamp` string")
    sinks.write_threat_log(events, str(tmp_path / "log"))
    sinks.write_threat_log(events, str(tmp_path / "log"))
    rows = normalise_time(read_threat_log(spark, str(tmp_path / "log"))).collect()
    assert len(rows) == 2 and not any(r["parse_failed"] for r in rows)


def test_index_and_analysis_logs(spark, tmp_path):
    events = spark.createDataFrame([("a", "2024-05-01T10:00:00")], "tool string, `@timestamp` string").withColumn("timestamp", F.lit(None).cast("string"))
    sinks.write_index(normalise_time(events), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).first()["event_date"] == datetime.date(2024, 5, 1)
    from threatloom.functions.scoring import fixed_prediction

    verdicts = spark.createDataFrame([("f.exe",)], "filename string").withColumn("prediction", fixed_prediction("Benign"))
    sinks.write_analysis_log(sinks.analysis_log(verdicts, F.lit(28)), str(tmp_path / "runs"))
    row = spark.read.json(str(tmp_path / "runs")).first()
    assert (row["filename"], row["prediction"], row["features_analyzed"], row["ip_address"]) == ("f.exe", "Benign", 28, "127.0.0.1")
    sinks.write_analysis(verdicts, str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results")).first()["prediction"]["ensemble"]["final_prediction"] == "Benign"
    sinks.write_alerts(spark.createDataFrame([("normal",)], "attack_type string"), str(tmp_path / "alerts"))
    assert spark.read.json(str(tmp_path / "alerts")).first()["level"] == "INFO"
    sinks.write_results(verdicts.select("filename"), str(tmp_path / "scored"), "b1")
    sinks.write_results(verdicts.select("filename"), str(tmp_path / "scored"), "b1")
    assert spark.read.csv(str(tmp_path / "scored"), header=True).count() == 1


def test_overview_lists_missing_summaries(spark, tmp_path):
    summary = {"dataset_name": "CICIDS2017", "rows_before": 9, "rows_after": 8, "preprocessing_status": "Completed"}
    sinks.write_summary(summary_frame(spark, summary), str(tmp_path / "s"))
    rows = summary_overview(read_summaries(spark, {"cicids_summary": str(tmp_path / "s")})).orderBy("position").collect()
    assert [(r["dataset_name"], r["status"]) for r in rows] == [
        ("MALWARE", "Missing"), ("DATASET_TEST", "Missing"), ("CICIDS2017", "Completed"), ("NSLKDD", "Missing"), ("UNSW", "Missing"),
    ]
    assert summary_overview(read_summaries(spark, {})).where("status = 'Missing'").count() == 5


def test_shared_folder_comes_from_the_session(spark):
    assert new_folder(spark, "x").startswith(shared_folder(spark))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_null_tokens_with_and_without_a_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\nNA,NA\n 3,y\n")
    pinned = datasets.read_csv(spark, str(tmp_path / "t.csv"), "a int, b string").collect()
    inferred = datasets.read_csv(spark, str(tmp_path / "t.csv")).collect()
    assert [tuple(r) for r in pinned] == [(1, "x"), (None, None), (3, "y")]
    assert [r["b"] for r in inferred] == ["x", None, "y"]


def test_files_with_another_order_of_columns_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "2.csv").write_text("b,a\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        datasets.read_csv(spark, str(tmp_path)).collect()
    (tmp_path / "2.csv").write_text("a,b\n2,y\n")
    assert sorted(tuple(r) for r in datasets.read_csv(spark, str(tmp_path)).collect()) == [(1, "x"), (2, "y")]

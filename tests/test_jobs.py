"""The jobs, one after the other, as a user would run them."""

import random

import pytest
from pyspark.sql import functions as F

from threatloom.__main__ import JOBS, main
from threatloom.fixed_values import NSL_KDD_COLUMNS, PE_FEATURES, TRAFFIC_FEATURES
from threatloom.operators import models


@pytest.fixture(scope="module")
def small_models(spark):
    """Smaller forests, so that the jobs run quickly."""
    patch = pytest.MonkeyPatch()
    traffic, malware, network = models.traffic_forest, models.malware_forest, models.malware_network
    patch.setattr(models, "traffic_forest", lambda f, l, t, d: traffic(f, l, 5, 5))
    patch.setattr(models, "malware_forest", lambda f, l, t, d: malware(f, l, 5, 5))
    patch.setattr(models, "malware_network", lambda f, l, s, i: network(f, l, s, 10))
    yield
    patch.undo()


# Columns whose values tell the classes apart; five trees need several to meet one.
TELLING = [n for n in TRAFFIC_FEATURES if n.endswith("count")] + ["hot", "urgent", "src_bytes", "dst_bytes", "duration", "num_root"]


def kdd_line(rng):
    attack = rng.choice(["normal", "neptune", "satan"])
    cells = []
    for name, dtype in NSL_KDD_COLUMNS:
        if name == "attack_type":
            cells.append(attack)
        elif dtype == "string":
            cells.append(rng.choice(["tcp", "udp"]))
        elif name in TELLING:
            cells.append(str({"normal": 1, "neptune": 200, "satan": 90}[attack] + rng.randrange(5)))
        else:
            cells.append(str(rng.randrange(3)))
    return ",".join(cells)


def run(job, **options):
    main([job, *[part for k, v in options.items() for part in (f"--{k}", str(v))]])


def test_traffic_jobs(spark, small_models, tmp_path):
    rng = random.Random(4)
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "NSL_KDD.csv").write_text("\n".join(kdd_line(rng) for _ in range(300)) + "\n")
    kdd = {"input": tmp_path / "data" / "NSL_KDD.csv", "dataset": "NSL-KDD", "model": tmp_path / "codes"}
    run("prepare-intrusions", output=tmp_path / "prepared", **kdd)
    run("prepare-intrusions", output=tmp_path / "alike", mode="test", **kdd)
    prepared, alike = (spark.read.parquet(str(tmp_path / n / "data")) for n in ("prepared", "alike"))
    assert prepared.count() == 300 and "y" in prepared.columns
    assert prepared.exceptAll(alike).count() == 0
    run("train-traffic", input=tmp_path / "data", output=tmp_path / "trained", model=tmp_path / "model")
    mapping = spark.read.csv(str(tmp_path / "trained" / "class_mapping"), header=True, inferSchema=True)
    assert [tuple(r) for r in mapping.orderBy("encoded_value").collect()] == [(0, "neptune"), (1, "normal"), (2, "satan")]
    report = {r["label"]: r for r in spark.read.csv(str(tmp_path / "trained" / "report"), header=True).collect()}
    assert float(report["weighted avg"]["f1"]) > 0.9
    assert float(spark.read.csv(str(tmp_path / "trained" / "scores"), header=True).first()["accuracy"]) > 0.9
    assert spark.read.csv(str(tmp_path / "trained" / "confusion"), header=True).count() == 9

    # Other order than in training, and without "land".
    others = [c for c in TRAFFIC_FEATURES if c not in TELLING and c != "land"]
    lines = [",".join([*TELLING, *others, "id"])]
    lines += [",".join([str(c)] * len(TELLING) + ["1"] * len(others) + [str(i)]) for i, c in enumerate([1, 201, 92])]
    (tmp_path / "batch.csv").write_text("\n".join(lines) + "\n")
    run("score-traffic", input=tmp_path / "batch.csv", output=tmp_path / "scored", model=tmp_path / "model")
    scored = spark.read.csv(str(tmp_path / "scored"), header=True).orderBy("id").collect()
    assert [r["predicted_attack"] for r in scored] == ["normal", "neptune", "satan"]

    (tmp_path / "cases").mkdir()
    for name, value in (("quiet", 1), ("flood", 201)):
        (tmp_path / "cases" / f"{name}.csv").write_text("name," + ",".join(TELLING) + f"\ncase {name}," + ",".join([str(value)] * len(TELLING)) + "\n")
    run("run-cases", input=tmp_path / "cases", output=tmp_path / "summary", model=tmp_path / "model")
    cases = {r["name"]: (r["group"], r["predicted_attack"]) for r in spark.read.csv(str(tmp_path / "summary"), header=True).collect()}
    assert cases == {"case quiet": ("quiet", "normal"), "case flood": ("flood", "neptune")}

    packets = spark.range(60).select(
        F.col("id").alias("seq"), F.timestamp_seconds(F.col("id")).alias("ts"), F.concat(F.lit("s"), F.col("id") % 3).alias("src_ip"),
        F.lit("d").alias("dst_ip"), F.lit("tcp").alias("proto"), F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"),
        F.lit(9).cast("bigint").alias("ip_len"), F.lit(0).alias("urgptr"), F.lit(False).alias("icmp_inner_ip"),
        F.lit("http").alias("service"), F.lit("SF").alias("conn_state"),
    )
    packets.coalesce(1).write.parquet(str(tmp_path / "packets"))
    run("flow-features", input=tmp_path / "packets", output=tmp_path / "features")
    run("classify-flows", input=tmp_path / "features", output=tmp_path / "out", model=tmp_path / "model", host="h1")
    assert spark.read.json(str(tmp_path / "out" / "threat_log")).where("host_name = 'h1'").count() == 3
    run("stream-flows", input=tmp_path / "packets", output=tmp_path / "units", progress=tmp_path / "p1")
    run("stream-scores", input=tmp_path / "units", output=tmp_path / "events", model=tmp_path / "model", progress=tmp_path / "p2")
    assert spark.read.parquet(str(tmp_path / "events")).count() == 3
    packets.withColumn("sensor", F.lit("n")).coalesce(1).write.parquet(str(tmp_path / "capture"))
    run("stream-capture", **{"input": tmp_path / "capture", "output": tmp_path / "cut", "progress": tmp_path / "p5", "unit-size": 25})
    run("stream-scores", input=tmp_path / "cut", output=tmp_path / "cut-events", model=tmp_path / "model", progress=tmp_path / "p6")
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "cut-events")).select("unit").collect()} == {"n-0", "n-1"}
    run("stream-scores", input=tmp_path / "features", output=tmp_path / "e2", model=tmp_path / "model", progress=tmp_path / "p7", files="plain")
    assert spark.read.parquet(str(tmp_path / "e2")).count() == 3
    run("index-log", input=tmp_path / "out" / "threat_log", output=tmp_path / "index", progress=tmp_path / "p3")
    from threatloom.sources.files import open_index

    open_index(spark, str(tmp_path / "index"))
    assert spark.sql("select count(*) from threat_logs where not parse_failed").first()[0] == 3

    log = tmp_path / "log"
    log.mkdir()
    lines = [f'{{"@timestamp": "2024-05-01T0{i % 3}:10:00", "host_name": "h", "severity": "low", "connection_key": "{i}"}}' for i in range(9)]
    (log / "a.json").write_text("\n".join(lines))
    (log / "b.json").write_text("\n".join([*lines, "no line"]))
    run("index-once", input=log, output=tmp_path / "once", progress=tmp_path / "p8", late="1 day")
    assert spark.read.parquet(str(tmp_path / "once")).count() == 9
    main(["window-counts", "--input", str(log), "--output", str(tmp_path / "hours"), "--progress", str(tmp_path / "p9"), "--ended", "--keys", "severity", "host_name"])
    assert sorted(tuple(r)[-1] for r in spark.read.parquet(str(tmp_path / "hours")).collect()) == [6, 6, 6]
    main(["sessions", "--input", str(log), "--output", str(tmp_path / "visits"), "--progress", str(tmp_path / "p10"), "--ended", "--keys", "host_name", "--gap", "70 minutes"])
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "visits")).collect()] == [18]


def test_malware_jobs(spark, small_models, tmp_path):
    from tests_programs import program

    rng = random.Random(6)
    header = "Name," + ",".join(PE_FEATURES) + ",Malware"
    lines = [header]
    for i in range(200):
        label = int(i % 4 == 0)
        lines.append(f"n{i}," + ",".join(str(rng.randrange(50) + 40 * label) for _ in PE_FEATURES) + f",{label}")
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    run("prepare-malware", input=tmp_path / "m.csv", output=tmp_path / "train", model=tmp_path / "pca")
    run("prepare-malware", input=tmp_path / "m.csv", output=tmp_path / "test", model=tmp_path / "pca", mode="test")
    one = spark.read.csv(str(tmp_path / "train" / "data"), header=True)
    two = spark.read.csv(str(tmp_path / "test" / "data"), header=True)
    assert one.columns == two.columns and one.count() == two.count() == 200
    run("train-malware", input=tmp_path / "m.csv", output=tmp_path / "fit", model=tmp_path / "model")
    assert spark.read.csv(str(tmp_path / "fit" / "rf_roc"), header=True).count() >= 2
    for scorer in ("rf", "net"):
        assert 0.5 < float(spark.read.csv(str(tmp_path / "fit" / f"{scorer}_auc"), header=True).first()["auc"]) <= 1
        assert float(spark.read.csv(str(tmp_path / "fit" / f"{scorer}_scores"), header=True).first()["accuracy"]) > 0.7
    run("evaluate-malware", input=tmp_path / "m.csv", output=tmp_path / "eval", model=tmp_path / "model")
    assert spark.read.csv(str(tmp_path / "eval" / "verdicts"), header=True).count() == 200
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.exe").write_bytes(program(False, b"x" * 64))
    (tmp_path / "bin" / "eicar.exe").write_bytes(b"-")
    run("scan", input=tmp_path / "bin", output=tmp_path / "scanned", model=tmp_path / "model")
    log = {r["file_name"]: r for r in spark.read.json(str(tmp_path / "scanned" / "threat_log")).collect()}
    assert set(log) == {"a.exe", "eicar.exe"} and log["eicar.exe"]["prediction"] == "Malware"
    daily = {r["filename"]: r for r in spark.read.json(str(tmp_path / "scanned" / "analysis_log")).collect()}
    assert set(daily) == set(log) and daily["a.exe"]["features_analyzed"] == len(PE_FEATURES)


def test_job_names():
    assert len(JOBS) == 17
    with pytest.raises(SystemExit):
        main(["no-such-job", "--input", "a", "--output", "b"])

import json

from pyspark.sql import functions as F

from threatloom import schemas
from threatloom.functions.times import normalise_time
from threatloom.operators import flows, threats
from threatloom.sources.datasets import read_flow_features
from threatloom.sources.files import read_threat_log, stream_threat_log
from threatloom.streaming import pipelines


def capture(spark, path, name, first, count):
    rows = spark.range(first, first + count).select(
        F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 3).alias("ts"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("src_ip"), F.lit("d").alias("dst_ip"), F.lit("tcp").alias("proto"),
        (F.col("id") % 2).cast("int").alias("src_port"), F.lit(80).alias("dst_port"), F.lit(40).cast("bigint").alias("ip_len"),
        F.lit(1).alias("urgptr"), F.lit(False).alias("icmp_inner_ip"), F.lit("http").alias("service"), F.lit("SF").alias("conn_state"),
    )
    rows.coalesce(1).write.mode("append").parquet(path)
    return rows


def test_flows_per_file_and_restart(spark, tmp_path):
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "ck"))
    one = capture(spark, source, "one", 0, 60)
    two = capture(spark, source, "two", 30, 60)
    run = lambda: pipelines.flows_from_packets(spark, source, output, progress).awaitTermination()
    run()
    first = read_flow_features(spark, output)
    want = flows.connection_flows(one).unionAll(flows.connection_flows(two))
    got = sorted((r["connection_key"], r["src_bytes"], r["duration"], r["urgent"]) for r in first.collect())
    assert got == sorted((r["connection_key"], r["bytes_sent_src_to_dst"], r["duration"], r["urgent_packets"]) for r in want.collect())
    run()
    assert read_flow_features(spark, output).count() == len(got)
    capture(spark, source, "three", 500, 12)
    run()
    assert read_flow_features(spark, output).count() == len(got) + 6


def log_lines(tmp_path, n, name="log.json"):
    folder = tmp_path / "log"
    folder.mkdir(exist_ok=True)
    lines = [
        {"@timestamp": f"2024-05-01T{i // 60:02d}:{i % 60:02d}:00", "tool": "t", "attack_type": "normal" if i % 4 else "neptune", "connection_key": str(i)}
        for i in range(n)
    ]
    (folder / name).write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    return str(folder)


def test_index_equals_batch(spark, tmp_path):
    log = log_lines(tmp_path, 300)
    output, progress = str(tmp_path / "index"), str(tmp_path / "ck")
    pipelines.index_threat_log(spark, log, output, progress).awaitTermination()
    batch = normalise_time(read_threat_log(spark, log))
    columns = ["connection_key", "event_time", "parse_failed", "bad_line"]
    assert {tuple(r) for r in spark.read.parquet(output).select(columns).collect()} == {tuple(r) for r in batch.select(columns).collect()}


def test_lines_read_twice_are_indexed_once(spark, tmp_path):
    log = log_lines(tmp_path, 200)
    log_lines(tmp_path, 200, "again.json")
    # One line many times over.
    line = json.dumps({"@timestamp": "2024-05-01T01:00:00", "tool": "hot"})
    (tmp_path / "log" / "hot.json").write_text("\n".join([line] * 300))
    events = normalise_time(stream_threat_log(spark, log)).where("not parse_failed")
    output, progress = str(tmp_path / "once"), str(tmp_path / "ck")
    identity = ["@timestamp", "tool", "attack_type", "connection_key"]
    pipelines.index_once(events, identity, output, progress, late="1 day").awaitTermination()
    assert spark.read.parquet(output).count() == 201


def test_windows_equal_batch_where_complete(spark, tmp_path):
    log = log_lines(tmp_path, 300)
    events = normalise_time(stream_threat_log(spark, log)).where("not parse_failed")
    output, progress = str(tmp_path / "hours"), str(tmp_path / "ck")
    pipelines.counts_by_window(events, ["attack_type"], output, progress, width="1 hour").awaitTermination()
    batch = threats.window_counts(
        normalise_time(read_threat_log(spark, log)).where("not parse_failed"), "event_time", "1 hour", ["attack_type"]
    ).where("window_end <= timestamp'2024-05-01 04:49:00'")
    assert {tuple(r) for r in spark.read.parquet(output).collect()} == {tuple(r) for r in batch.collect()}
    assert batch.count() == 8


def test_ended_stream_equals_batch(spark, tmp_path):
    log = log_lines(tmp_path, 300)
    events = normalise_time(stream_threat_log(spark, log)).where("not parse_failed")
    batch = normalise_time(read_threat_log(spark, log)).where("not parse_failed")
    hours, sessions = str(tmp_path / "hours"), str(tmp_path / "sessions")
    pipelines.run_to_end(
        events, lambda e: pipelines.counts_by_window(e, ["attack_type"], hours, hours + "-ck"), str(tmp_path / "m1")
    )
    pipelines.run_to_end(
        events, lambda e: pipelines.sessions_by_key(e, ["attack_type"], sessions, sessions + "-ck"), str(tmp_path / "m2")
    )
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(spark.read.parquet(hours)) == rows(threats.window_counts(batch, "event_time", "1 hour", ["attack_type"]))
    assert rows(spark.read.parquet(sessions)) == rows(threats.sessions(batch, "event_time", "30 minutes", ["attack_type"]))


def test_flow_schema_matches_positions(spark):
    assert len(schemas.FLOW_EXPORT.split(", ")) == len(schemas.FLOW_POSITIONAL_NAMES) == 39


def test_sessions_by_stretches_equal_plain_sessions(spark):
    # Pauses just below, exactly at and above the gap, and a busy key.
    seconds = [0, 10, 1799, 3599, 5399, 7200, 9001, 20000, *range(30000, 40000, 7), 41800, 43601]
    events = spark.createDataFrame([(k, s) for k in ("hot", "b") for s in seconds], "k string, s long").withColumn(
        "t", F.timestamp_seconds("s")
    )
    plain = events.groupBy(F.session_window("t", "30 minutes").alias("w"), "k").agg(F.count("*").alias("n"))
    want = {(r["w"]["start"], r["w"]["end"], r["k"], r["n"]) for r in plain.collect()}
    assert {tuple(r) for r in threats.sessions(events, "t", "30 minutes", ["k"]).collect()} == want

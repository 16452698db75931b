"""Capture units on a live stream, and streams that are broken off between writing and entering."""

import shutil

import pytest
from pyspark.sql import functions as F

from threatloom.fixed_values import TRAFFIC_FEATURES
from threatloom.operators import flows, models
from threatloom.sources.datasets import read_flow_features
from threatloom.streaming import pipelines
from threatloom.streaming.ledger import ledger_of, read_finished
from threatloom.streaming.units import unit_packets


def packets(spark, first, count):
    i = F.col("id")
    return spark.range(first, first + count).select(
        i.alias("seq"), F.timestamp_seconds(i * 3).alias("ts"), F.concat(F.lit("s"), i % 5).alias("src_ip"),
        F.lit("d").alias("dst_ip"), F.lit("tcp").alias("proto"), (i % 2).cast("int").alias("src_port"),
        F.lit(80).alias("dst_port"), (40 + i % 7).cast("bigint").alias("ip_len"), F.lit(1).alias("urgptr"),
        F.lit(False).alias("icmp_inner_ip"), F.lit("http").alias("service"), F.lit("SF").alias("conn_state"),
        F.when(i % 4 == 0, "north").otherwise("south").alias("sensor"),
    )


def arrive(spark, path, first, count):
    packets(spark, first, count).coalesce(1).write.mode("append").parquet(path)


def expected(spark, total, size):
    """Connections of the full units, in one batch."""
    found = {}
    for sensor in ("north", "south"):
        own = packets(spark, 0, total).where(F.col("sensor") == sensor)
        for r in flows.connection_flows(flows.packet_batches(own, size), ["batch_id"]).collect():
            found[f"{sensor}-{r['batch_id']}", r["connection_key"]] = (r["bytes_sent_src_to_dst"], r["duration"], r["urgent_packets"])
    return found


def finished(spark, output):
    rows = read_finished(spark, output).collect()
    got = {(r["unit"], r["connection_key"]): (r["src_bytes"], r["duration"], r["urgent"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_units_span_files_batches_and_restarts(spark, tmp_path):
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def run():
        pipelines.flows_from_capture(spark, source, output, progress, size=60, files_per_trigger=1).awaitTermination()

    for first, count in ((0, 130), (130, 9), (139, 200)):
        arrive(spark, source, first, count)
    run()
    assert finished(spark, output) == expected(spark, 339, 60)
    arrive(spark, source, 339, 161)
    run()
    got = finished(spark, output)
    assert got == expected(spark, 500, 60)
    assert {unit for unit, _ in got} == {*(f"north-{i}" for i in range(2)), *(f"south-{i}" for i in range(6))}
    run()
    assert finished(spark, output) == got


def forget_last_commit(progress):
    """Take back a stream's record that its last micro-batch is done; returns its number."""
    last = max((progress / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    return last.name


def test_a_replayed_batch_is_no_new_input(spark, tmp_path):
    source, output, progress = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "ck"

    def run():
        pipelines.flows_from_packets(spark, source, output, str(progress), unit="sensor string").awaitTermination()

    arrive(spark, source, 0, 80)
    run()
    files = sorted(r["file"] for r in spark.read.json(f"{ledger_of(output)}/*").collect())
    # As if the run had ended after the ledger and before the stream's own record.
    forget_last_commit(progress)
    run()
    assert sorted(r["file"] for r in spark.read.json(f"{ledger_of(output)}/*").collect()) == files
    assert read_finished(spark, output).count() == read_flow_features(spark, output).count() == 15
    # As if it had ended before the ledger: the files are written anew, under other names.
    shutil.rmtree(f"{ledger_of(output)}/batch={forget_last_commit(progress)}")
    run()
    again = sorted(r["file"] for r in spark.read.json(f"{ledger_of(output)}/*").collect())
    assert len(again) == len(files) and again != files
    assert read_finished(spark, output).count() == read_flow_features(spark, output).count() == 15


def test_each_connection_has_one_event_however_often_streams_start_anew(spark, tmp_path):
    source, units, events = (str(tmp_path / n) for n in ("in", "units", "events"))
    rng = spark.range(60).select(*[(F.rand(i) * 9 + F.col("id") % 2 * 50).alias(c) for i, c in enumerate(TRAFFIC_FEATURES)],
                                 F.when(F.col("id") % 2 == 0, "normal").otherwise("neptune").alias("attack_type"))
    model = models.fit_traffic_model(rng, TRAFFIC_FEATURES, "attack_type", trees=3, depth=3)

    def run():
        pipelines.flows_from_packets(spark, source, units, str(tmp_path / "ck1"), unit="sensor string").awaitTermination()
        pipelines.scores_from_units(spark, units, model, events, str(tmp_path / "ck2"), "h").awaitTermination()

    arrive(spark, source, 0, 80)
    run()
    want = {(r["unit"], r["connection_key"]) for r in read_finished(spark, units).collect()}

    def scored():
        rows = spark.read.parquet(events).collect()
        return len(rows), {(r["unit"], r["connection_key"]) for r in rows}

    assert scored() == (15, want)
    for stream in ("ck1", "ck2"):
        forget_last_commit(tmp_path / stream)
        run()
        assert scored() == (15, want)
    shutil.rmtree(f"{ledger_of(events)}/batch={forget_last_commit(tmp_path / 'ck2')}")
    run()
    assert scored() == (15, want)
    arrive(spark, source, 80, 8)
    run()
    count, found = scored()
    assert count > 15 and {u for u, _ in found} == {"north", "south"}


@pytest.mark.parametrize("text", ["plain-1", "file:///a b/ü=%.parquet", "x" * 300])
def test_units_of_any_name_are_folders(spark, text):
    name = spark.range(1).select(pipelines._folder_name(F.lit(text))).first()[0]
    assert len(name) <= 120 and set(name) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
    assert name == text or text not in ("plain-1",)


def test_a_capture_batch_that_runs_again_finds_the_open_units_it_found(spark, tmp_path):
    """Broken off before the ledger, and before the stream's own record; no task holds a sensor's packets."""
    source, output, progress = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "ck"

    def run():
        pipelines.flows_from_capture(spark, source, output, str(progress), size=60).awaitTermination()

    for first, count in ((0, 130), (130, 99), (229, 171)):
        arrive(spark, source, first, count)
        run()
        want = finished(spark, output)
        assert want == expected(spark, first + count, 60)
        shutil.rmtree(f"{ledger_of(output)}/batch={forget_last_commit(progress)}")
        run()
        assert finished(spark, output) == want
        forget_last_commit(progress)
        run()
        assert finished(spark, output) == want


def test_open_units_are_kept_beside_the_ledger(spark, tmp_path):
    """Packets arrive in many files; a sensor may have no name or no packet in a micro-batch."""
    ledger = str(tmp_path / "ledger")
    own = packets(spark, 0, 100).withColumn("sensor", F.when(F.col("seq") % 4 != 0, F.col("sensor"))).repartition(7)
    parts = [own.where("seq < 50"), own.where("seq >= 50 and sensor is null"), own.where("seq >= 50 and sensor is not null")]
    units = {}
    for n, part in enumerate(parts):
        for r in unit_packets(part, n, "sensor", 20, ledger).collect():
            units.setdefault((r["sensor"], r["unit"]), []).append(r["seq"])
    order = {None: [i for i in range(100) if i % 4 == 0], "south": [i for i in range(100) if i % 4]}
    assert {k: sorted(v) for k, v in units.items()} == {
        (s, u): seqs[20 * u : 20 * u + 20] for s, seqs in order.items() for u in range(len(seqs) // 20)
    }

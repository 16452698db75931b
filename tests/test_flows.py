import random

import pytest
from pyspark.sql import functions as F

from threatloom import schemas
from threatloom.fixed_values import FLOW_EXPORT_COLUMNS, TRAFFIC_FEATURES
from threatloom.operators import flows
from threatloom.plans.traffic import packets_to_features

BASE = 1_700_000_000


def packet(seq, ts, src="a", dst="b", proto="tcp", sport=1, dport=2, size=10, urg=0, frag=False, service="http", state="SF"):
    return (seq, ts, src, dst, proto, sport, dport, size, urg, frag, service, state)


def packets(spark, rows):
    frame = spark.createDataFrame(
        [(r[0], BASE + r[1], *r[2:]) for r in rows],
        "seq bigint, t double, src_ip string, dst_ip string, proto string, src_port int, dst_port int, "
        "ip_len bigint, urgptr int, icmp_inner_ip boolean, service string, conn_state string",
    )
    return frame.withColumn("ts", F.timestamp_micros((F.col("t") * 1000000).cast("bigint"))).drop("t")


def by_key(frame):
    return {r["connection_key"]: r for r in frame.collect()}


def test_one_packet(spark):
    row = by_key(flows.connection_flows(packets(spark, [packet(1, 5.0, urg=3, frag=True)])))["a_1_b_2"]
    assert row["packet_count"] == 1 and row["duration"] == 0
    assert row["bytes_sent_src_to_dst"] == 10 and row["bytes_sent_dst_to_src"] == 10
    assert row["urgent_packets"] == 0 and row["wrong_fragments"] == 0 and row["land"] == 0


def test_order_is_arrival_not_time(spark):
    rows = [packet(1, 9.0), packet(2, 4.0), packet(3, 5.5)]
    row = by_key(flows.connection_flows(packets(spark, rows)))["a_1_b_2"]
    assert row["duration"] == pytest.approx(-3.5)


def test_bytes_back_only_for_self_talk(spark):
    rows = [
        packet(1, 0.0, "a", "a", sport=5, dport=5, size=7), packet(2, 1.0, "a", "a", sport=5, dport=5, size=8),
        packet(3, 0.0, "a", "a", sport=5, dport=6, size=1), packet(4, 1.0, "a", "a", sport=5, dport=6, size=2),
        packet(5, 0.0, size=3), packet(6, 1.0, size=4),
    ]
    found = by_key(flows.connection_flows(packets(spark, rows)))
    assert (found["a_5_a_5"]["bytes_sent_dst_to_src"], found["a_5_a_5"]["land"]) == (15, 1)
    assert (found["a_5_a_6"]["bytes_sent_dst_to_src"], found["a_5_a_6"]["land"]) == (3, 0)
    assert found["a_1_b_2"]["bytes_sent_dst_to_src"] == 3


def test_counters_skip_first_packet_and_protocols_merge(spark):
    rows = [
        packet(1, 0.0, urg=1, frag=True), packet(2, 1.0, urg=1, frag=True),
        packet(3, 2.0, proto="udp", urg=9, frag=False),
    ]
    row = by_key(flows.connection_flows(packets(spark, rows)))["a_1_b_2"]
    assert (row["packet_count"], row["urgent_packets"], row["wrong_fragments"]) == (3, 1, 1)


def test_ports_and_packets_without_ip(spark):
    rows = [
        packet(1, 0.0, proto="icmp", sport=None, dport=None), packet(2, 0.0, src=None, dst=None),
        packet(3, 0.0, proto="other", sport=8, dport=9),
    ]
    found = by_key(flows.connection_flows(packets(spark, rows)))
    assert set(found) == {"a_0_b_0"} and found["a_0_b_0"]["packet_count"] == 2


def test_unfilled_batch_is_left_out(spark):
    rows = [packet(i * 3, float(i)) for i in range(2500)]
    counted = flows.packet_batches(packets(spark, rows)).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")
    )
    assert sorted(tuple(r) for r in counted.collect()) == [(0, 1000, 0, 2997), (1, 1000, 3000, 5997)]


def test_export_layout_and_constants(spark):
    exported = flows.flow_export(flows.connection_flows(packets(spark, [packet(1, 0.0)])))
    assert exported.columns == [*FLOW_EXPORT_COLUMNS, "connection_key"]
    row = exported.first().asDict()
    ones = {c for c in FLOW_EXPORT_COLUMNS[6:] if row[c] == 1}
    assert ones == {"hot", "count", "srv_count"}
    assert all(row[c] == 0 for c in FLOW_EXPORT_COLUMNS[6:] if c not in ones)


def test_features_have_model_names(spark):
    rows = packets(spark, [packet(i, i / 2, src=f"s{i % 3}", dst=f"d{i % 2}") for i in range(40)])
    for mode in ("reference", "kdd"):
        found = packets_to_features(rows, mode)
        assert found.columns == [*TRAFFIC_FEATURES, "connection_key"]
        assert found.count() == 6
    with pytest.raises(ValueError):
        packets_to_features(rows, "other")


def _random_connections(n, hosts, span, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # One host takes a third of all connections; times repeat often.
        dst = "hot" if rng.random() < 0.34 else f"d{rng.randrange(hosts)}"
        rows.append(
            packet(
                i, round(rng.random() * span * 4) / 4, src=f"s{rng.randrange(4)}", dst=dst, sport=rng.randrange(3),
                service=rng.choice("xyz"), state=rng.choice(["S0", "REJ", "SF"]),
            )
        )
    return rows


@pytest.mark.parametrize("blocks", [1, 7, 60])
def test_time_windows_match_brute_force(spark, blocks):
    rows = _random_connections(300, 5, 60, 1)
    found = flows.time_window_features(packets(spark, rows), 2.0, blocks)
    got = {r["seq"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for r in rows:
        near = [o for o in rows if r[1] - 2.0 <= o[1] <= r[1]]
        host = [o for o in near if o[3] == r[3]]
        srv = [o for o in near if o[10] == r[10]]
        both = [o for o in host if o[10] == r[10]]
        g = got[r[0]]
        assert g["count"] == len(host) and g["srv_count"] == len(srv)
        assert g["serror_rate"] == pytest.approx(sum(o[11] == "S0" for o in host) / len(host))
        assert g["srv_rerror_rate"] == pytest.approx(sum(o[11] == "REJ" for o in srv) / len(srv))
        assert g["same_srv_rate"] == pytest.approx(len(both) / len(host))
        assert g["diff_srv_rate"] == pytest.approx(1 - len(both) / len(host))
        assert g["srv_diff_host_rate"] == pytest.approx(1 - len(both) / len(srv))


def test_one_service_with_most_rows_is_many_blocks(spark, monkeypatch):
    """Nine tenths of the rows are one service; no block of running totals has more than its share."""
    from threatloom.operators import ranking

    seen = []
    shift = ranking.shift_by_blocks

    def watched(df, keys, sums):
        seen.append((keys, max(r["n"] for r in df.groupBy(*keys, ranking.BLOCK).agg(F.count("*").alias("n")).collect()), df.count()))
        return shift(df, keys, sums)

    monkeypatch.setattr(ranking, "shift_by_blocks", watched)
    connections = spark.range(6000).select(
        F.timestamp_micros(F.col("id") * 50_000).alias("ts"), F.concat(F.lit("h"), F.col("id") % 50).alias("dst_ip"),
        F.when(F.col("id") % 10 == 0, "dns").otherwise("http").alias("service"), F.lit("SF").alias("conn_state"),
    )
    found = flows.time_window_features(connections, 2.0, 30).where("service = 'http'")
    assert found.agg(F.max("srv_count")).first()[0] == 37 and found.count() == 5400
    keys, most, rows = next(s for s in seen if s[0] == ["service"])
    assert most <= 2 * rows / 30


@pytest.mark.parametrize("block", [5, 9, 10_000])
def test_host_windows_match_brute_force(spark, block):
    rows = _random_connections(200, 3, 60, 2)
    found = flows.host_window_features(packets(spark, rows), last=10, block=block)
    got = {r["seq"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for r in rows:
        host = [o for o in rows if o[3] == r[3] and o[0] <= r[0]][-10:]
        srv = [o for o in host if o[10] == r[10]]
        g = got[r[0]]
        assert g["dst_host_count"] == len(host) and g["dst_host_srv_count"] == len(srv)
        assert g["dst_host_same_src_port_rate"] == pytest.approx(sum(o[5] == r[5] for o in srv) / len(srv))
        assert g["dst_host_srv_diff_host_rate"] == pytest.approx(sum(o[2] != r[2] for o in srv) / len(srv))
        assert g["dst_host_serror_rate"] == pytest.approx(sum(o[11] == "S0" for o in host) / len(host))
        assert g["dst_host_srv_rerror_rate"] == pytest.approx(sum(o[11] == "REJ" for o in srv) / len(srv))


def test_packet_schema_is_complete(spark):
    rows = packets(spark, [packet(1, 0.0)])
    assert set(rows.columns) == {f.split(" ")[0] for f in schemas.PACKETS.split(", ")}

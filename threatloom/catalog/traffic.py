"""Packets, connections and threat events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.catalog import standins as S
from threatloom.fixed_values import TRAFFIC_FEATURES
from threatloom.functions.connections import split_connection_key
from threatloom.functions.severity import attack_severity, join_severity
from threatloom.functions.times import normalise_time
from threatloom.operators import flows, profile, threats
from threatloom.plans.traffic import model_features, packets_to_features
from threatloom.session import new_folder
from threatloom.sources.datasets import read_flow_features
from threatloom.sources.files import read_threat_log
from threatloom.sources.sinks import write_csv

SIX_HOURS = 6 * 3600

FLOW_COLUMNS = """
    count(*) as packet_count,
    round((max_by(us, seq) - min_by(us, seq)) / 1000000.0, 6) as duration,
    cast(sum(ip_len) as bigint) as bytes_sent_src_to_dst,
    case when src_ip = dst_ip then cast(sum(ip_len) as bigint) else min_by(ip_len, seq) end
      as bytes_sent_dst_to_src,
    cast(src_ip = dst_ip and src_port = dst_port as int) as land,
    count_if(icmp_inner_ip) - cast(min_by(icmp_inner_ip, seq) as int) as wrong_fragments,
    count_if(proto = 'tcp' and urgptr <> 0)
      - cast(min_by(proto = 'tcp' and urgptr <> 0, seq) as int) as urgent_packets,
    src_ip || '_' || src_port || '_' || dst_ip || '_' || dst_port as connection_key"""


def flow_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flows.connection_flows(S.packets(spark, sf_dir))
    return found.select(
        "src_ip", "dst_ip", F.col("src_port").cast("bigint").alias("src_port"),
        F.col("dst_port").cast("bigint").alias("dst_port"), "packet_count",
        F.round("duration", 6).alias("duration"), "bytes_sent_src_to_dst", "bytes_sent_dst_to_src",
        "land", "wrong_fragments", "urgent_packets", "connection_key",
    )


FLOW_AGGREGATION = f"""with {S.PACKETS}
select src_ip, dst_ip, cast(src_port as bigint) as src_port, cast(dst_port as bigint) as dst_port,
  {FLOW_COLUMNS}
from packets group by src_ip, src_port, dst_ip, dst_port"""


def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow export written as CSV and read back by position."""
    exported = flows.flow_export(flows.connection_flows(S.packets(spark, sf_dir)))
    path = new_folder(spark, "flow-features")
    write_csv(exported, path)
    read = read_flow_features(spark, path)
    return read.select(
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in TRAFFIC_FEATURES], "connection_key"
    )


def _flow_features_sql() -> str:
    measured = dict(
        duration="duration", src_bytes="bytes_sent_src_to_dst", dst_bytes="bytes_sent_dst_to_src",
        land="land", wrong_fragment="wrong_fragments", urgent="urgent_packets",
        hot="1", count="1", srv_count="1",
    )
    columns = ", ".join(f'cast({measured.get(c, "0")} as double) as "{c}"' for c in TRAFFIC_FEATURES)
    return f"""with {S.PACKETS}, flows as (
  select {FLOW_COLUMNS} from packets group by src_ip, src_port, dst_ip, dst_port
) select {columns}, connection_key from flows"""


def flow_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections, rated by what they carried, per severity."""
    features = packets_to_features(S.packets(spark, sf_dir))
    attack = (
        F.when(F.col("land") == 1, "land")
        .when(F.col("wrong_fragment") > 0, "teardrop")
        .when(F.col("urgent") > 12, "portsweep")
        .when(F.col("src_bytes") > 1500, "warezclient")
        .otherwise("normal")
    )
    return (
        join_severity(features.withColumn("attack_type", attack))
        .groupBy("severity", "attack_type")
        .agg(F.count("*").alias("connections"), F.sum("src_bytes").cast("bigint").alias("bytes"))
    )


FLOW_SEVERITY_COUNTS = f"""with {S.PACKETS}, flows as (
  select {FLOW_COLUMNS} from packets group by src_ip, src_port, dst_ip, dst_port
), named as (
  select *, case when land = 1 then 'land' when wrong_fragments > 0 then 'teardrop'
    when urgent_packets > 12 then 'portsweep' when bytes_sent_src_to_dst > 1500 then 'warezclient'
    else 'normal' end as attack_type
  from flows
)
select {S.SEVERITY} as severity, attack_type, count(*) as connections,
  cast(sum(bytes_sent_src_to_dst) as bigint) as bytes
from named group by 1, 2"""


def packet_batch_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows within capture units of 1000 packets."""
    batches = flows.packet_batches(S.packets(spark, sf_dir))
    found = flows.connection_flows(batches, ["batch_id"])
    return found.select(
        "batch_id", "packet_count", F.round("duration", 6).alias("duration"), "bytes_sent_src_to_dst",
        "bytes_sent_dst_to_src", "land", "wrong_fragments", "urgent_packets", "connection_key",
    )


PACKET_BATCH_FLOWS = f"""with {S.PACKETS}, numbered as (
  select *, (row_number() over (order by seq) - 1) // 1000 as batch_id, count(*) over () as total
  from packets
)
select batch_id, {FLOW_COLUMNS}
from numbered where batch_id < total // 1000
group by batch_id, src_ip, src_port, dst_ip, dst_port"""

TIME_FEATURES = [
    "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
]


def time_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flows.time_window_features(S.packets(spark, sf_dir), SIX_HOURS)
    return found.select("seq", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in TIME_FEATURES])


TIME_WINDOW_FEATURES = f"""with {S.PACKETS}, counted as (
  select seq,
    count(*) over host as c, count(*) over srv as s, count(*) over both_ as b,
    count(*) filter (where conn_state = 'S0') over host as hs,
    count(*) filter (where conn_state = 'REJ') over host as hr,
    count(*) filter (where conn_state = 'S0') over srv as ss,
    count(*) filter (where conn_state = 'REJ') over srv as sr
  from packets
  window host as (partition by dst_ip order by us range between 21600000000 preceding and current row),
    srv as (partition by service order by us range between 21600000000 preceding and current row),
    both_ as (partition by dst_ip, service order by us range between 21600000000 preceding and current row)
)
select seq, cast(c as double) as count, cast(s as double) as srv_count,
  round(hs / c, 6) as serror_rate, round(ss / s, 6) as srv_serror_rate,
  round(hr / c, 6) as rerror_rate, round(sr / s, 6) as srv_rerror_rate,
  round(b / c, 6) as same_srv_rate, round(1 - b / c, 6) as diff_srv_rate,
  round(1 - b / s, 6) as srv_diff_host_rate
from counted"""

HOST_FEATURES = [
    "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]


def host_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = flows.ip_packets(S.packets(spark, sf_dir))
    found = flows.host_window_features(resolved)
    return found.select("seq", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in HOST_FEATURES])


HOST_WINDOW_FEATURES = f"""with {S.PACKETS}, numbered as (
  select *, row_number() over (partition by dst_ip order by seq) as pos from packets
), counted as (
  select seq,
    count(*) over host as h, count(*) over srv as s,
    count(*) filter (where conn_state = 'S0') over host as hs,
    count(*) filter (where conn_state = 'REJ') over host as hr,
    count(*) filter (where conn_state = 'S0') over srv as ss,
    count(*) filter (where conn_state = 'REJ') over srv as sr,
    count(*) over port as p, count(*) over src as i
  from numbered
  window host as (partition by dst_ip order by pos range between 99 preceding and current row),
    srv as (partition by dst_ip, service order by pos range between 99 preceding and current row),
    port as (partition by dst_ip, service, src_port order by pos range between 99 preceding and current row),
    src as (partition by dst_ip, service, src_ip order by pos range between 99 preceding and current row)
)
select seq, cast(h as double) as dst_host_count, cast(s as double) as dst_host_srv_count,
  round(s / h, 6) as dst_host_same_srv_rate, round(1 - s / h, 6) as dst_host_diff_srv_rate,
  round(p / s, 6) as dst_host_same_src_port_rate, round(1 - i / s, 6) as dst_host_srv_diff_host_rate,
  round(hs / h, 6) as dst_host_serror_rate, round(ss / s, 6) as dst_host_srv_serror_rate,
  round(hr / h, 6) as dst_host_rerror_rate, round(sr / s, 6) as dst_host_srv_rerror_rate
from counted"""


def measured_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model features with measured traffic counts instead of constants."""
    return packets_to_features(S.packets(spark, sf_dir), "kdd").select(
        "connection_key", "src_bytes",
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in [*TIME_FEATURES, *HOST_FEATURES]],
    )


MEASURED_FEATURES = f"""with {S.PACKETS}, first as (
  select src_ip, src_port, dst_ip, dst_port, min(seq) as seq, min_by(us, seq) as us,
    min_by(service, seq) as service, max_by(conn_state, seq) as conn_state,
    cast(sum(ip_len) as bigint) as src_bytes
  from packets group by all
), numbered as (
  select *, row_number() over (partition by dst_ip order by seq) as pos from first
), counted as (
  select src_ip || '_' || src_port || '_' || dst_ip || '_' || dst_port as connection_key, src_bytes,
    count(*) over t_host as c, count(*) over t_srv as ts, count(*) over t_both as b,
    count(*) filter (where conn_state = 'S0') over t_host as ths,
    count(*) filter (where conn_state = 'REJ') over t_host as thr,
    count(*) filter (where conn_state = 'S0') over t_srv as tss,
    count(*) filter (where conn_state = 'REJ') over t_srv as tsr,
    count(*) over host as h, count(*) over srv as s,
    count(*) filter (where conn_state = 'S0') over host as hs,
    count(*) filter (where conn_state = 'REJ') over host as hr,
    count(*) filter (where conn_state = 'S0') over srv as ss,
    count(*) filter (where conn_state = 'REJ') over srv as sr,
    count(*) over port as p, count(*) over src as i
  from numbered
  window t_host as (partition by dst_ip order by us range between 2000000 preceding and current row),
    t_srv as (partition by service order by us range between 2000000 preceding and current row),
    t_both as (partition by dst_ip, service order by us range between 2000000 preceding and current row),
    host as (partition by dst_ip order by pos range between 99 preceding and current row),
    srv as (partition by dst_ip, service order by pos range between 99 preceding and current row),
    port as (partition by dst_ip, service, src_port order by pos range between 99 preceding and current row),
    src as (partition by dst_ip, service, src_ip order by pos range between 99 preceding and current row)
)
select connection_key, src_bytes, cast(c as double) as count, cast(ts as double) as srv_count,
  round(ths / c, 6) as serror_rate, round(tss / ts, 6) as srv_serror_rate,
  round(thr / c, 6) as rerror_rate, round(tsr / ts, 6) as srv_rerror_rate,
  round(b / c, 6) as same_srv_rate, round(1 - b / c, 6) as diff_srv_rate,
  round(1 - b / ts, 6) as srv_diff_host_rate,
  cast(h as double) as dst_host_count, cast(s as double) as dst_host_srv_count,
  round(s / h, 6) as dst_host_same_srv_rate, round(1 - s / h, 6) as dst_host_diff_srv_rate,
  round(p / s, 6) as dst_host_same_src_port_rate, round(1 - i / s, 6) as dst_host_srv_diff_host_rate,
  round(hs / h, 6) as dst_host_serror_rate, round(ss / s, 6) as dst_host_srv_serror_rate,
  round(hr / h, 6) as dst_host_rerror_rate, round(sr / s, 6) as dst_host_srv_rerror_rate
from counted"""


def connection_key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections per source and destination port, from the keys in a log."""
    keys = S.classified(spark, sf_dir)
    parts = keys.select(split_connection_key(F.col("connection_key")).alias("p")).select("p.*")
    return parts.groupBy("src_ip", "src_port", "dst_ip", "dst_port").agg(F.count("*").alias("n"))


CONNECTION_KEY_PARTS = f"""with {S.CLASSIFIED}
select split_part(connection_key, '_', 1) as src_ip, cast(split_part(connection_key, '_', 2) as int) as src_port,
  split_part(connection_key, '_', 3) as dst_ip, cast(split_part(connection_key, '_', 4) as int) as dst_port,
  count(*) as n
from classified group by all"""


def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.class_distribution(S.classified(spark, sf_dir), "attack_type")
    return found.withColumn("percent", F.round("percent", 6))


CLASS_SHARE = f"""with {S.CLASSIFIED}
select attack_type, count(*) as n, round(count(*) / sum(count(*)) over () * 100, 6) as percent
from classified group by attack_type"""


def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_classes(S.connections(spark, sf_dir), "attack_type", 10)


TOP_CLASSES = """select l_partkey || '-' || l_suppkey as attack_type, count(*) as n
from lineitem group by 1 order by n desc, attack_type limit 10"""


def severity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity by lookup, next to the expression that gives the same."""
    found = join_severity(S.classified(spark, sf_dir))
    return (
        found.withColumn("expression", attack_severity(F.col("attack_type")))
        .groupBy("attack_type", "severity", "expression")
        .agg(F.count("*").alias("n"))
    )


SEVERITY_LOOKUP = f"""with {S.CLASSIFIED}
select attack_type, {S.SEVERITY} as severity, {S.SEVERITY} as expression, count(*) as n
from classified group by all"""


def _connection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threats.connection_events(S.classified(spark, sf_dir), "sensor-1")


def threat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _connection_events(spark, sf_dir)


_EVENTS_SELECT = f"""'NetworkTrafficClassifier' as tool, 'network_connection' as event_type,
  'sensor-1' as host_name, attack_type, connection_key, {S.SEVERITY} as severity,
  case when attack_type = 'normal' then 0.85::double else 0.98::double end as confidence,
  'RandomForest' as model, 'v1.0' as model_version"""

THREAT_EVENTS = f"with {S.CLASSIFIED} select {_EVENTS_SELECT} from classified"


def threat_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threats.alerts(_connection_events(spark, sf_dir)).select("connection_key", "level", "message")


THREAT_ALERTS = f"""with {S.CLASSIFIED}
select connection_key, case when attack_type = 'normal' then 'INFO' else 'ERROR' end as level,
  case when attack_type = 'normal' then 'Normal traffic detected.'
    else 'Alert! Attack detected: ' || attack_type end as message
from classified"""


def threat_log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log written as JSON lines, read back, its times normalised.

    Some lines carry ``@timestamp``, some only ``timestamp``, some neither or no time.
    """
    found = S.classified(spark, sf_dir)
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("attack_type")
    lines = found.select(
        F.when(kind == "normal", iso).when(kind == "portsweep", "yesterday").alias("@timestamp"),
        F.when(kind != "guess_passwd", F.concat(iso, F.lit("Z"))).alias("timestamp"),
        F.lit("sensor").alias("tool"),
        "attack_type",
        "connection_key",
        F.round("value", 2).alias("confidence"),
    )
    path = new_folder(spark, "threat-log")
    lines.write.json(path)
    timed = normalise_time(read_threat_log(spark, path))
    return timed.select(
        "attack_type", "connection_key", "confidence",
        F.unix_micros("event_time").alias("event_us"), "parse_failed",
    )


THREAT_LOG_TIMES = f"""with {S.CLASSIFIED}
select attack_type, connection_key, round(value, 2) as confidence,
  case when attack_type in ('normal', 'neptune') then epoch_us(event_time) end as event_us,
  attack_type not in ('normal', 'neptune') as parse_failed
from classified"""


def threat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour, severity and attack type."""
    events = S.classified(spark, sf_dir).withColumn("severity", attack_severity(F.col("attack_type")))
    found = threats.window_counts(events, "event_time", "1 hour", ["severity", "attack_type"])
    return found.select(
        F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"),
        "severity", "attack_type", "n",
    )


THREAT_WINDOWS = f"""with {S.CLASSIFIED}
select epoch_us(date_trunc('hour', event_time)) as start_us,
  epoch_us(date_trunc('hour', event_time)) + 3600000000 as end_us,
  {S.SEVERITY} as severity, attack_type, count(*) as n
from classified group by all"""


def threat_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per source over two hours, every hour."""
    found = threats.window_counts(
        S.classified(spark, sf_dir), "event_time", "2 hours", ["src_ip"], "1 hour"
    )
    return found.select(
        F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"),
        "src_ip", "n",
    )


THREAT_SLIDING_WINDOWS = f"""with {S.CLASSIFIED}, placed as (
  select src_ip, epoch_us(date_trunc('hour', event_time)) - unnest([0, 3600000000]) as start_us
  from classified
)
select start_us, start_us + 7200000000 as end_us, src_ip, count(*) as n from placed group by all"""


def threat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events per source with no pause of 30 minutes."""
    found = threats.sessions(S.classified(spark, sf_dir), "event_time", "30 minutes", ["src_ip"])
    return found.select(
        F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"),
        "src_ip", "n",
    )


THREAT_SESSIONS = f"""with {S.CLASSIFIED}, gaps as (
  select src_ip, epoch_us(event_time) as us,
    coalesce(epoch_us(event_time) - lag(epoch_us(event_time)) over w > 1800000000, true) as starts
  from classified window w as (partition by src_ip order by event_time, event_id)
), runs as (
  select *, sum(cast(starts as int)) over (partition by src_ip order by us, starts desc
    rows unbounded preceding) as run
  from gaps
)
select min(us) as start_us, max(us) + 1800000000 as end_us, src_ip, count(*) as n
from runs group by src_ip, run"""


QUERIES = {
    "flow_aggregation": (flow_aggregation, FLOW_AGGREGATION),
    "flow_features": (flow_features, _flow_features_sql()),
    "flow_severity_counts": (flow_severity_counts, FLOW_SEVERITY_COUNTS),
    "packet_batch_flows": (packet_batch_flows, PACKET_BATCH_FLOWS),
    "time_window_features": (time_window_features, TIME_WINDOW_FEATURES),
    "host_window_features": (host_window_features, HOST_WINDOW_FEATURES),
    "measured_features": (measured_features, MEASURED_FEATURES),
    "connection_key_parts": (connection_key_parts, CONNECTION_KEY_PARTS),
    "class_share": (class_share, CLASS_SHARE),
    "top_classes": (top_classes, TOP_CLASSES),
    "severity_lookup": (severity_lookup, SEVERITY_LOOKUP),
    "threat_events": (threat_events, THREAT_EVENTS),
    "threat_alerts": (threat_alerts, THREAT_ALERTS),
    "threat_log_times": (threat_log_times, THREAT_LOG_TIMES),
    "threat_windows": (threat_windows, THREAT_WINDOWS),
    "threat_sliding_windows": (threat_sliding_windows, THREAT_SLIDING_WINDOWS),
    "threat_sessions": (threat_sessions, THREAT_SESSIONS),
}

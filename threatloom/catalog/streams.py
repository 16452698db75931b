"""Streams over the test tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import schemas
from threatloom.catalog import standins as S
from threatloom.fixed_values import TRAFFIC_FEATURES
from threatloom.functions.severity import attack_severity
from threatloom.operators import flows
from threatloom.plans.traffic import packets_to_features
from threatloom.operators.models import fit_traffic_model
from threatloom.session import new_folder
from threatloom.sources.datasets import read_flow_features
from threatloom.streaming import ledger, pipelines

#: Runs of files in which the packets of ``stream_units`` arrive; the files of a run are one micro-batch.
ARRIVALS = 5
ALL_FILES = 1_000_000


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of classified connections."""
    schema = S.table(spark, sf_dir, "events").schema
    # A pattern, since a stream takes a plain path for a folder and the table may be one file.
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events[.]parquet")
    attack = S.attack_of(F.col("event_type"))
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 16).alias("src_ip"),
        attack.alias("attack_type"),
        attack_severity(attack).alias("severity"),
    )


def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture units of 1000 packets arrive as files and leave as flow feature files."""
    units = flows.packet_batches(S.packets(spark, sf_dir))
    captured, features, progress = (
        new_folder(spark, name) for name in ("captured", "flow-units", "flow-progress")
    )
    # Every unit lies whole in one file; a file holds as many units as its task got.
    units.repartition("batch_id").write.parquet(captured)
    pipelines.flows_from_packets(
        spark, captured, features, progress, unit="batch_id bigint"
    ).awaitTermination()
    read = read_flow_features(spark, features)
    return read.select(
        "connection_key", F.round("duration", 6).alias("duration"), "src_bytes", "dst_bytes", "land",
        "wrong_fragment", "urgent", "hot", "count",
    )


STREAM_FLOWS = f"""with {S.PACKETS}, numbered as (
  select *, (row_number() over (order by seq) - 1) // 1000 as batch_id, count(*) over () as total
  from packets
)
select src_ip || '_' || src_port || '_' || dst_ip || '_' || dst_port as connection_key,
  round((max_by(us, seq) - min_by(us, seq)) / 1000000.0, 6) as duration,
  cast(sum(ip_len) as bigint) as src_bytes,
  case when src_ip = dst_ip then cast(sum(ip_len) as bigint) else min_by(ip_len, seq) end as dst_bytes,
  cast(src_ip = dst_ip and src_port = dst_port as int) as land,
  count_if(icmp_inner_ip) - cast(min_by(icmp_inner_ip, seq) as int) as wrong_fragment,
  count_if(proto = 'tcp' and urgptr <> 0) - cast(min_by(proto = 'tcp' and urgptr <> 0, seq) as int) as urgent,
  1 as hot, 1 as count
from numbered where batch_id < total // 1000
group by batch_id, src_ip, src_port, dst_ip, dst_port"""


def stream_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of three sensors arrive in five runs of files; units of 1000 packets of a sensor
    are cut as they fill, across runs, and their connections are read by the ledger."""
    ordered = S.packets(spark, sf_dir).withColumn("sensor", (F.substring_index("src_ip", ".", -1).cast("int") % 3).cast("string"))
    captured, features, progress = (new_folder(spark, name) for name in ("arrivals", "units", "units-progress"))
    last = ordered.agg(F.max("seq")).first()[0] or 0
    for part in range(ARRIVALS):  # one run after the other, as a capture writes them; the stream takes up each
        span = ordered.where((F.col("seq") * ARRIVALS >= part * (last + 1)) & (F.col("seq") * ARRIVALS < (part + 1) * (last + 1)))
        span.write.mode("append").parquet(captured)
        pipelines.flows_from_capture(spark, captured, features, progress, files_per_trigger=ALL_FILES).awaitTermination()
    return ledger.read_finished(spark, features).select(
        "unit", "connection_key", F.round("duration", 6).alias("duration"), "src_bytes", "dst_bytes", "land",
        "wrong_fragment", "urgent",
    )


STREAM_UNITS = f"""with {S.PACKETS}, sensors as (
  select *, cast(split_part(src_ip, '.', 4) as int) % 3 as sensor from packets
), numbered as (
  select *, (row_number() over (partition by sensor order by seq) - 1) // 1000 as unit,
    count(*) over (partition by sensor) as total
  from sensors
)
select sensor || '-' || unit as unit, src_ip || '_' || src_port || '_' || dst_ip || '_' || dst_port as connection_key,
  round((max_by(us, seq) - min_by(us, seq)) / 1000000.0, 6) as duration,
  cast(sum(ip_len) as bigint) as src_bytes,
  case when src_ip = dst_ip then cast(sum(ip_len) as bigint) else min_by(ip_len, seq) end as dst_bytes,
  cast(src_ip = dst_ip and src_port = dst_port as int) as land,
  count_if(icmp_inner_ip) - cast(min_by(icmp_inner_ip, seq) as int) as wrong_fragment,
  count_if(proto = 'tcp' and urgptr <> 0) - cast(min_by(proto = 'tcp' and urgptr <> 0, seq) as int) as urgent
from numbered where unit < total // 1000
group by sensor, numbered.unit, src_ip, src_port, dst_ip, dst_port"""


def _threat_lines(spark: SparkSession, sf_dir: str) -> str:
    """``events`` written as a threat log; returns its folder."""
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    path = new_folder(spark, "threat-lines")
    S.classified(spark, sf_dir).select(
        F.when(F.col("attack_type") != "portsweep", iso).alias("@timestamp"),
        F.when(F.col("attack_type") == "portsweep", iso).alias("timestamp"),
        F.lit("sensor").alias("tool"),
        "attack_type",
        F.concat_ws("/", "event_id", "connection_key").alias("connection_key"),
        F.col("value").alias("confidence"),
    ).write.json(path)
    return path


def stream_threat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines indexed by event date, counted per date and type from the index."""
    index, progress = new_folder(spark, "index"), new_folder(spark, "index-progress")
    pipelines.index_threat_log(spark, _threat_lines(spark, sf_dir), index, progress).awaitTermination()
    return (
        spark.read.parquet(index)
        .groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "attack_type")
        .agg(
            F.count("*").alias("n"),
            F.count_if("parse_failed").alias("failed"),
            F.max(F.unix_micros("event_time")).alias("last_us"),
        )
    )


STREAM_THREAT_INDEX = f"""with {S.CLASSIFIED}
select strftime(event_time, '%Y-%m-%d') as event_date, attack_type, count(*) as n, 0 as failed,
  max(epoch_us(event_time)) as last_us
from classified group by 1, 2"""


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log read twice, as after a restart without a record of progress; each event is kept once."""
    twice = _event_stream(spark, sf_dir).union(_event_stream(spark, sf_dir))
    output, progress = new_folder(spark, "once"), new_folder(spark, "once-progress")
    pipelines.index_once(
        twice, ["event_id", "src_ip", "attack_type"], output, progress, late="60 days"
    ).awaitTermination()
    return spark.read.parquet(output).select(
        "event_id", F.unix_micros("event_time").alias("event_us"), "src_ip", "attack_type", "severity"
    )


STREAM_ONCE = f"""with {S.CLASSIFIED}
select event_id, epoch_us(event_time) as event_us, src_ip, attack_type, {S.SEVERITY} as severity
from classified"""


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per severity, written as each hour is complete, the last ones at the end."""
    output, progress, marks = (new_folder(spark, n) for n in ("hours", "hours-progress", "hours-end"))
    pipelines.run_to_end(
        _event_stream(spark, sf_dir),
        lambda events: pipelines.counts_by_window(events, ["severity", "attack_type"], output, progress),
        marks,
    )
    return spark.read.parquet(output).select(
        F.unix_micros("window_start").alias("start_us"), "severity", "attack_type", "n"
    )


STREAM_WINDOW_COUNTS = f"""with {S.CLASSIFIED}
select epoch_us(date_trunc('hour', event_time)) as start_us, {S.SEVERITY} as severity, attack_type,
  count(*) as n
from classified group by all"""


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per source, written as each is over, the last ones at the end."""
    output, progress, marks = (new_folder(spark, n) for n in ("sessions", "sessions-progress", "sessions-end"))
    pipelines.run_to_end(
        _event_stream(spark, sf_dir),
        lambda events: pipelines.sessions_by_key(events, ["src_ip"], output, progress),
        marks,
    )
    return spark.read.parquet(output).select(
        F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"),
        "src_ip", "n",
    )


STREAM_SESSIONS = f"""with {S.CLASSIFIED}, gaps as (
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


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow feature files scored as they arrive: one event per connection, with the severity of its
    attack and the probability of the likeliest of three classes."""
    features = packets_to_features(S.packets(spark, sf_dir))
    attack = F.when(F.col("land") == 1, "land").when(F.col("urgent") > 12, "portsweep").otherwise("normal")
    labelled = features.withColumn("attack_type", attack)
    model = fit_traffic_model(labelled, TRAFFIC_FEATURES, "attack_type")
    arriving, output, progress = (
        new_folder(spark, name) for name in ("arriving", "scored", "scored-progress")
    )
    exported = flows.flow_export(flows.connection_flows(S.packets(spark, sf_dir)))
    exported.write.csv(arriving, header=True)
    pipelines.scores_from_flows(spark, arriving, model, output, progress, "sensor-1").awaitTermination()
    return spark.read.parquet(output).select(
        "connection_key",
        F.col("attack_type").isin("land", "portsweep", "normal").alias("known_class"),
        (F.col("severity") == attack_severity(F.col("attack_type"))).alias("severity_fits"),
        F.col("confidence").between(1 / 3 - 1e-9, 1 + 1e-9).alias("confidence_fits"),
    )


STREAM_SCORES = f"""with {S.PACKETS}
select src_ip || '_' || src_port || '_' || dst_ip || '_' || dst_port as connection_key,
  true as known_class, true as severity_fits, true as confidence_fits
from packets group by src_ip, src_port, dst_ip, dst_port"""


QUERIES = {
    "stream_flows": (stream_flows, STREAM_FLOWS),
    "stream_units": (stream_units, STREAM_UNITS),
    "stream_threat_index": (stream_threat_index, STREAM_THREAT_INDEX),
    "stream_once": (stream_once, STREAM_ONCE),
    "stream_window_counts": (stream_window_counts, STREAM_WINDOW_COUNTS),
    "stream_sessions": (stream_sessions, STREAM_SESSIONS),
    "stream_scores": (stream_scores, STREAM_SCORES),
}

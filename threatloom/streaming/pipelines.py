"""Streams over arriving files. Progress lives in the checkpoint; input files are not deleted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from threatloom import schemas
from threatloom.fixed_values import PACKET_BATCH
from threatloom.functions.times import normalise_time
from threatloom.operators import flows, threats
from threatloom.operators.models import score_traffic
from threatloom.plans.traffic import threat_events
from threatloom.sources.datasets import read_flow_features
from threatloom.sources.files import stream_packets, stream_threat_log
from threatloom.streaming.ledger import LINE, finish, follow, is_finished, ledger_of, with_units
from threatloom.streaming.units import UNIT, unit_packets

# State on local disk with snapshots in the checkpoint, so that it may outgrow memory;
# sessions of one key merge within a task before they are shuffled.
_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}
# Copies of one line meet first within this many groups of input partitions.
COPY_SPREAD = 64
# Later than any event. An end mark of this time moves the watermark past all open windows.
END_OF_TIME = "9999-01-01 00:00:00"


def _start(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    """Run over what is there and stop, or look for more at an interval."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _start_stateful(
    spark: SparkSession, writer: DataStreamWriter, checkpoint: str, every: str | None
) -> StreamingQuery:
    before = {name: spark.conf.get(name, None) for name in _STATE_SETTINGS}
    for name, value in _STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        return _start(writer, checkpoint, every)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _folder_name(text: Column) -> Column:
    """A unit as the name of a folder: its readable end, and a hash where that is not all of it."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9_.-]", "_")
    return F.when((plain == text) & (F.length(text) <= 80), text).otherwise(
        F.concat(F.substring(plain, -80, 80), F.lit("-"), F.md5(text))
    )


def _unit_writer(spark: SparkSession, output: str, ledger: str, keys: list[str]):
    """Write the connections of whole units, and enter them in the ledger last."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if is_finished(spark, ledger, batch_id):
            return
        found = flows.connection_flows(batch, keys)
        unit = _folder_name(F.concat_ws("-", *keys))
        folder = f"{output}/batch={batch_id}"
        flows.flow_export(found.withColumn("unit", unit), "unit").repartition("unit").write.mode(
            "overwrite"
        ).partitionBy("unit").csv(folder, header=True)
        try:
            written = spark.read.schema(f"{schemas.FLOW_EXPORT}, unit string").csv(folder, header=True)
        except AnalysisException as error:  # no unit, no file
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            finish(written, ledger, batch_id)

    return write


def flows_from_packets(
    spark: SparkSession,
    packets: str,
    output: str,
    checkpoint: str,
    every: str | None = None,
    file_format: str = "parquet",
    unit: str | None = None,
    ledger: str | None = None,
) -> StreamingQuery:
    """Connections of each capture unit, as feature files in a folder for each micro-batch and unit.

    A connection is counted within one unit: a packet file, or the values of a column
    (``unit``, as "name type") of files that hold whole units.
    """
    key = unit.split()[0] if unit else "source_file"
    stream = stream_packets(spark, packets, file_format, extra=unit)
    write = _unit_writer(spark, output, ledger or ledger_of(output), [key])
    return _start(stream.writeStream.foreachBatch(write), checkpoint, every)


def flows_from_capture(
    spark: SparkSession,
    packets: str,
    output: str,
    checkpoint: str,
    sensor: str = "sensor string",
    size: int = PACKET_BATCH,
    every: str | None = None,
    file_format: str = "parquet",
    files_per_trigger: int = 1000,
    ledger: str | None = None,
) -> StreamingQuery:
    """Connections of units of ``size`` packets, cut from each sensor's packets as they arrive.

    ``sensor`` is the column that tells sensors apart, as "name type". A unit is given out by the
    micro-batch that fills it, whole.
    """
    key, ledger = sensor.split()[0], ledger or ledger_of(output)
    stream = stream_packets(spark, packets, file_format, files_per_trigger, extra=sensor).drop("source_file")
    write_units = _unit_writer(spark, output, ledger, [key, UNIT])

    def write(batch: DataFrame, batch_id: int) -> None:
        if not is_finished(spark, ledger, batch_id):
            write_units(unit_packets(batch, batch_id, key, size, ledger), batch_id)

    return _start(stream.writeStream.foreachBatch(write), checkpoint, every)


def scores_from_units(
    spark: SparkSession,
    feature_files: str,
    model: PipelineModel,
    output: str,
    checkpoint: str,
    host_name: str,
    every: str | None = None,
    ledger: str | None = None,
) -> StreamingQuery:
    """Threat events of the connections of finished units, with their ``unit``, in a folder for each micro-batch.

    Follows the ledger of the stream that writes the units. A micro-batch that runs again replaces its
    folder, so each connection has one event however often either stream starts anew.
    """
    scored_ledger = ledger_of(output)

    def write(lines: DataFrame, batch_id: int) -> None:
        if is_finished(spark, scored_ledger, batch_id):
            return
        named = lines.collect()  # files of a micro-batch, whose number the trigger bounds
        if not named:
            return
        features = read_flow_features(spark, [r["file"] for r in named])
        units = F.broadcast(spark.createDataFrame(named, LINE).select("file", "unit"))
        scored = score_traffic(with_units(features, units), model)
        events = threat_events(scored.withColumnRenamed("predicted_attack", "attack_type"), host_name, keep=("unit",))
        folder = f"{output}/batch={batch_id}"
        events.write.mode("overwrite").parquet(folder)
        finish(spark.read.parquet(folder), scored_ledger, batch_id)

    stream = follow(spark, ledger or ledger_of(feature_files))
    return _start(stream.writeStream.foreachBatch(write), checkpoint, every)


def scores_from_flows(
    spark: SparkSession,
    feature_files: str,
    model: PipelineModel,
    output: str,
    checkpoint: str,
    host_name: str,
    every: str | None = None,
) -> StreamingQuery:
    """Threat events of the connections in arriving feature files. The model is loaded once."""
    features = (
        spark.readStream.schema(schemas.FLOW_EXPORT)
        .option("header", "true")
        .option("recursiveFileLookup", "true")
        .csv(feature_files)
        .toDF(*schemas.FLOW_POSITIONAL_NAMES)
    )
    scored = score_traffic(features, model).withColumnRenamed("predicted_attack", "attack_type")
    events = threat_events(scored, host_name)
    writer = events.writeStream.format("parquet").option("path", output).outputMode("append")
    return _start(writer, checkpoint, every)


def with_event_time(lines: DataFrame) -> DataFrame:
    return normalise_time(lines).withColumn("event_date", F.to_date("event_time"))


def index_threat_log(
    spark: SparkSession, log: str, output: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Log lines from the beginning, their time normalised, into parquet by event date."""
    events = with_event_time(stream_threat_log(spark, log))
    writer = (
        events.writeStream.format("parquet")
        .option("path", output)
        .partitionBy("event_date")
        .outputMode("append")
    )
    return _start(writer, checkpoint, every)


def run_to_end(
    events: DataFrame, start: Callable[[DataFrame], StreamingQuery], marks: str, time: str = "event_time"
) -> None:
    """Run a stream that is over: after all events, an end mark brings out its last windows and sessions.

    ``start`` starts a query on the stream it is given, reading what is there and stopping.
    The first run takes the events, the second an end mark from the folder ``marks``. The
    mark's own window is never complete, so it is not in the result. Events that arrive
    afterwards count as late.
    """
    spark = events.sparkSession
    schema = f"`{time}` timestamp"
    mark = spark.range(1).select(F.lit(END_OF_TIME).cast("timestamp").alias(time))
    mark.limit(0).write.mode("append").parquet(marks)
    marked = events.unionByName(spark.readStream.schema(schema).parquet(marks), allowMissingColumns=True)
    start(marked).awaitTermination()
    mark.write.mode("append").parquet(marks)
    start(marked).awaitTermination()


def index_once(
    events: DataFrame, identity: list[str], output: str, checkpoint: str, time: str = "event_time", late: str = "1 hour", every: str | None = None
) -> StreamingQuery:
    """Events without those read twice within ``late``, into parquet.

    Copies are removed in two steps, per group of input partitions and then overall:
    a line that makes up a third of the input reaches its final task a bounded number
    of times.
    """
    spark = events.sparkSession
    unique = (
        events.withColumn("event_hash", threats.event_hash(events, identity))
        .withColumn("__spread", F.spark_partition_id() % COPY_SPREAD)
        .withWatermark(time, late)
        .dropDuplicatesWithinWatermark(["event_hash", "__spread"])
        .drop("__spread")
        .dropDuplicatesWithinWatermark(["event_hash"])
    )
    writer = unique.writeStream.format("parquet").option("path", output).outputMode("append")
    return _start_stateful(spark, writer, checkpoint, every)


def counts_by_window(
    events: DataFrame,
    keys: list[str],
    output: str,
    checkpoint: str,
    width: str = "1 hour",
    slide: str | None = None,
    time: str = "event_time",
    late: str = "10 minutes",
    every: str | None = None,
) -> StreamingQuery:
    """Counts per window and key, written once a window is complete."""
    counted = threats.window_counts(events.withWatermark(time, late), time, width, keys, slide)
    writer = counted.writeStream.format("parquet").option("path", output).outputMode("append")
    return _start_stateful(events.sparkSession, writer, checkpoint, every)


def sessions_by_key(
    events: DataFrame,
    keys: list[str],
    output: str,
    checkpoint: str,
    gap: str = "30 minutes",
    time: str = "event_time",
    late: str = "10 minutes",
    every: str | None = None,
) -> StreamingQuery:
    """Sessions per key, written once they are complete."""
    found = threats.sessions(events.withWatermark(time, late), time, gap, keys)
    writer = found.writeStream.format("parquet").option("path", output).outputMode("append")
    return _start_stateful(events.sparkSession, writer, checkpoint, every)

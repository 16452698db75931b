"""Threat events from verdicts, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions.scoring import override_known_benign
from threatloom.functions.severity import attack_severity, log_confidence, scan_severity


def connection_events(
    scored: DataFrame,
    host_name: str | Column,
    attack_type: str = "attack_type",
    confidence: Column | None = None,
    model: str = "RandomForest",
    version: str = "v1.0",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One event per classified connection. Confidence is the model's, or the log's constants."""
    attack = F.col(attack_type)
    return scored.select(
        F.lit("NetworkTrafficClassifier").alias("tool"),
        F.lit("network_connection").alias("event_type"),
        (F.lit(host_name) if isinstance(host_name, str) else host_name).alias("host_name"),
        attack.alias("attack_type"),
        F.col("connection_key").cast("string").alias("connection_key"),
        attack_severity(attack).alias("severity"),
        (log_confidence(attack) if confidence is None else confidence).alias("confidence"),
        F.lit(model).alias("model"),
        F.lit(version).alias("model_version"),
        *keep,
    )


def scan_events(verdicts: DataFrame) -> DataFrame:
    """One event per scanned file with ``filename``, ``length``, ``file_hash`` and ``prediction``.

    The event of the antivirus test file carries its fixed hash and confidence.
    """
    final = F.col("prediction.ensemble.final_prediction")
    eicar = F.lower("filename") == V.EICAR_NAME
    return verdicts.select(
        F.lit("MalwareAnalysis").alias("tool"),
        F.lit("file_scan").alias("event_type"),
        F.col("filename").alias("file_name"),
        F.col("length").alias("file_size"),
        F.when(eicar, V.EICAR_HASH).otherwise(F.col("file_hash")).alias("file_hash"),
        final.alias("prediction"),
        F.when(eicar, F.lit(V.EICAR_LOG_CONFIDENCE))
        .otherwise(F.col("prediction.ensemble.confidence"))
        .alias("confidence"),
        scan_severity(final).alias("severity"),
    )


def all_events(connections: DataFrame, scans: DataFrame) -> DataFrame:
    """Both event shapes in one log."""
    return connections.unionByName(scans, allowMissingColumns=True)


def shown_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts as shown to users: known harmless tools overridden, after logging."""
    return verdicts.withColumn(
        "prediction", override_known_benign(F.col("filename"), F.col("prediction"))
    )


def alerts(events: DataFrame) -> DataFrame:
    """An ERROR line per attack and an INFO line per normal connection."""
    attack = F.col("attack_type")
    normal = attack == V.NORMAL_ATTACK
    return events.select(
        "*",
        F.when(normal, "INFO").otherwise("ERROR").alias("level"),
        F.when(normal, "Normal traffic detected.")
        .otherwise(F.concat(F.lit("Alert! Attack detected: "), attack))
        .alias("message"),
    )


def window_counts(
    events: DataFrame, time: str, width: str, keys: list[str], slide: str | None = None
) -> DataFrame:
    """Events per time window and key, on batches and streams; pre-aggregated in each task."""
    return (
        events.groupBy(F.window(time, width, slide or width).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n"
        )
    )


def sessions(events: DataFrame, time: str, gap: str, keys: list[str]) -> DataFrame:
    """Events per key in runs with no pause as long as ``gap``.

    On a batch, events of a key within one stretch of ``gap`` are first counted
    together: none of them can be a gap apart. A key with a third of all events then
    has no more rows than such stretches. On a stream, tasks merge sessions before the
    shuffle (see the streaming settings).
    """
    if events.isStreaming:
        grouped = events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    else:
        stretches = events.groupBy(F.window(time, gap).alias("__w"), *keys).agg(
            F.min(time).alias("__first"), F.max(time).alias("__last"), F.count("*").alias("__n")
        )
        gap_micros = F.unix_micros(F.expr(f"timestamp'1970-01-01 00:00:00Z' + interval {gap}"))
        length = F.unix_micros("__last") - F.unix_micros("__first") + gap_micros
        reach = F.make_interval(secs=(length / 1000000).cast("decimal(18,6)"))
        grouped = stretches.groupBy(F.session_window("__first", reach).alias("w"), *keys).agg(
            F.sum("__n").alias("n")
        )
    return grouped.select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n"
    )


def event_hash(events: DataFrame, columns: list[str]) -> Column:
    """Identity of an event for removing lines read twice."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])), 256)

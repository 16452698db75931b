"""Writers. Each run appends files; none rewrites what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.operators.threats import alerts


def utc_stamp() -> Column:
    """Time of writing as ISO text in UTC."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


# Spaces in headers and cells are data; Spark would strip them on writing.
_KEEP_SPACES = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).csv(path, header=True, **_KEEP_SPACES)


def write_results(df: DataFrame, path: str, batch_id: str) -> None:
    """Scored rows of one batch in a folder of their own; a batch run again replaces its folder."""
    df.write.mode("overwrite").csv(f"{path}/batch={batch_id}", header=True, **_KEEP_SPACES)


def write_threat_log(events: DataFrame, path: str) -> None:
    """JSON lines, each stamped with the time of writing."""
    events.withColumn("@timestamp", utc_stamp()).write.mode("append").json(path)


def write_rejected(rejected: DataFrame, path: str) -> None:
    """Rejected rows as JSON lines, each stamped with the time of writing."""
    rejected.withColumn("@timestamp", utc_stamp()).write.mode("append").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_analysis(results: DataFrame, path: str) -> None:
    """Analysis results as JSON, one folder per run day."""
    results.withColumn("day", F.date_format(F.current_timestamp(), "yyyyMMdd")).write.mode(
        "append"
    ).partitionBy("day").json(path)


def analysis_log(verdicts: DataFrame, features: Column, ip_address: str = "127.0.0.1") -> DataFrame:
    """The log line of each analysed file."""
    return verdicts.select(
        utc_stamp().alias("timestamp"),
        "filename",
        F.col("prediction.ensemble.final_prediction").alias("prediction"),
        F.col("prediction.ensemble.confidence").alias("confidence"),
        features.alias("features_analyzed"),
        F.lit(ip_address).alias("ip_address"),
    )


def write_analysis_log(lines: DataFrame, path: str) -> None:
    lines.withColumn("day", F.replace(F.substring("timestamp", 1, 10), F.lit("-"), F.lit(""))).write.mode(
        "append"
    ).partitionBy("day").json(path)


def write_alerts(events: DataFrame, path: str) -> None:
    """Alert lines of connection events."""
    alerts(events).select(utc_stamp().alias("time"), "level", "message").write.mode("append").json(path)


def write_index(events: DataFrame, path: str) -> None:
    """Events with ``event_time`` as parquet, one folder per event date."""
    events.withColumn("event_date", F.to_date("event_time")).write.mode("append").partitionBy(
        "event_date"
    ).parquet(path)

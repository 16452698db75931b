"""Event times of log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a timestamp; text without a zone is UTC, other text is null."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(zoned)
    return F.when(iso, F.replace(whole, F.lit(","), F.lit("."))).try_cast("timestamp")


def normalise_time(df: DataFrame) -> DataFrame:
    """``event_time`` from ``@timestamp``, else from ``timestamp``, and ``parse_failed``."""
    text = F.coalesce(F.col("@timestamp"), F.col("timestamp"))
    return df.withColumn("event_time", parse_iso(text)).withColumn(
        "parse_failed", F.col("event_time").isNull()
    )

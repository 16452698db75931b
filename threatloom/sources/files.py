"""Packets, file corpora, threat logs and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import schemas
from threatloom.fixed_values import EXPECTED_SUMMARIES


def read_packets(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.format(file_format).schema(schemas.PACKETS).load(path)


def stream_packets(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    files_per_trigger: int = 1000,
    extra: str | None = None,
) -> DataFrame:
    """Packet files as they arrive, with the file each packet came from and ``extra`` columns."""
    return (
        spark.readStream.format(file_format)
        .schema(f"{schemas.PACKETS}, {extra}" if extra else schemas.PACKETS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def read_corpus(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content; contents are read only where a query uses them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def parse_threat_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to events; lines that are no JSON keep ``bad_line`` and nothing else."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}
    event = F.from_json(column, f"{schemas.THREAT_EVENT}, bad_line string", options)
    return lines.where(F.length(F.trim(F.col(column))) > 0).select(event.alias("e")).select("e.*")


def read_threat_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_threat_lines(spark.read.text(path))


def stream_threat_log(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return parse_threat_lines(
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    )


def open_index(spark: SparkSession, path: str, view: str = "threat_logs") -> DataFrame:
    """The event index, also as a view for SQL; its folders by date prune scans by ``event_date``."""
    events = spark.read.parquet(path)
    events.createOrReplaceTempView(view)
    return events


def read_summaries(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row per summary found among ``paths`` (stem to path), with its ``stem``; absent files have none."""
    found = []
    for stem, path in paths.items():
        try:
            summary = spark.read.schema(schemas.DATASET_SUMMARY).json(path, multiLine=True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            found.append(summary.withColumn("stem", F.lit(stem)))
    if not found:
        return spark.createDataFrame([], f"{schemas.DATASET_SUMMARY}, stem string")
    return reduce(DataFrame.unionByName, found)


def summary_overview(summaries: DataFrame, expected: list[str] = EXPECTED_SUMMARIES) -> DataFrame:
    """Every expected summary with its status; ``Missing`` where there is none."""
    wanted = summaries.sparkSession.createDataFrame(
        [(i, stem) for i, stem in enumerate(expected)], "position int, stem string"
    )
    missing_name = F.upper(F.replace(F.col("stem"), F.lit("_summary"), F.lit("")))
    present = summaries.withColumn("__present", F.lit(True))
    joined = wanted.join(present, "stem", "left")
    there = F.col("__present").isNotNull()
    return joined.select(
        "position",
        "stem",
        F.when(there, F.coalesce("dataset_name", "stem")).otherwise(missing_name).alias("dataset_name"),
        F.when(there, F.coalesce("preprocessing_status", F.lit("Completed")))
        .otherwise("Missing")
        .alias("status"),
        "rows_before",
        "rows_after",
        "invalid_records_removed",
        "features_used",
    )

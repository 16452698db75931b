"""What one stream has finished for the next: a ledger of micro-batches and their files.

A micro-batch writes its files first and its lines in the ledger last, as one file. A micro-batch that
runs again finds its lines and does nothing; one that broke off before them writes its files anew,
and no reader has seen the old ones. The next stream follows the ledger, not the folder, so a file
that is written twice is read once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.sources.datasets import read_flow_features

LINE = "unit string, file string, rows bigint"


def ledger_of(folder: str) -> str:
    """Where the ledger of a folder lies if no other place is named."""
    return f"{folder.rstrip('/')}-ledger"


def is_finished(spark: SparkSession, ledger: str, batch_id: int) -> bool:
    try:
        return bool(spark.read.schema(LINE).json(f"{ledger}/batch={batch_id}").take(1))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def finish(written: DataFrame, ledger: str, batch_id: int) -> None:
    """Enter the files of a micro-batch, read back from where they lie, by unit."""
    lines = written.groupBy("unit", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    lines.coalesce(1).write.mode("overwrite").json(f"{ledger}/batch={batch_id}")


def follow(spark: SparkSession, ledger: str, batches_per_trigger: int = 1000) -> DataFrame:
    """Finished files as they are entered."""
    return (
        spark.readStream.schema(LINE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", batches_per_trigger)
        .json(ledger)
    )


def read_finished(spark: SparkSession, folder: str, ledger: str | None = None) -> DataFrame:
    """The connections of all finished units of a folder of feature files, with their ``unit``."""
    lines = spark.read.schema(LINE).option("recursiveFileLookup", "true").json(ledger or ledger_of(folder))
    return with_units(read_flow_features(spark, folder), lines.select("file", "unit"))


def with_units(features: DataFrame, lines: DataFrame) -> DataFrame:
    """Features with the unit of their file; files that are in no line are left out."""
    named = features.select("*", F.col("_metadata.file_path").alias("file"))
    return named.join(lines, "file").drop("file")

"""Features of file corpora: one row per file in, features or long tables out."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom import fixed_values as V
from threatloom.functions import files, pe, text

# Entropy counts bytes in pieces of this size, so that no Arrow batch holds whole files.
CHUNK_BYTES = 16 * 1024


def file_info(corpus: DataFrame) -> DataFrame:
    """Name, size, modification time, extension with its dot, and path. Does not read contents."""
    name = files.file_name(F.col("path"))
    return corpus.select(
        name.alias("filename"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        files.suffix(name).alias("extension"),
        "path",
    )


def admit(corpus: DataFrame, max_mb: int = V.MAX_FILE_MB) -> DataFrame:
    """Add ``filename``, ``allowed``, ``valid`` and ``reason`` from name and size alone."""
    name = files.safe_name(files.file_name(F.col("path")))
    return corpus.withColumns(
        {
            "filename": name,
            "allowed": files.is_allowed(name),
            "valid": F.coalesce(files.size_ok(F.col("length"), max_mb), F.lit(False)),
            "reason": files.validation_reason(F.col("length"), max_mb),
        }
    )


def string_features(
    corpus: DataFrame, tokens: Iterable[str] = V.API_TOKENS, prefix_bytes: int | None = None
) -> DataFrame:
    """Add printable characters, URL and address counts and the token count map.

    Reads whole contents; pass ``SCAN_PREFIX_BYTES`` to look at the first MiB only.
    """
    body = F.col("__text")
    return (
        corpus.withColumn("__text", text.latin1_text(F.col("content"), prefix_bytes))
        .withColumns(
            {
                "printable_chars": text.printable_chars(body),
                "url_count": text.url_count(body),
                "ip_count": text.ip_count(body),
                "tokens": text.token_counts(body, tokens),
            }
        )
        .drop("__text")
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def byte_histogram(pieces: pd.Series) -> pd.Series:
    return pieces.map(lambda b: np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256).astype(np.int32))


def byte_entropy(blobs: DataFrame, keys: list[str], content: str = "bytes") -> DataFrame:
    """Shannon entropy (0 to 8 bits) of the bytes of each key; 0 for empty contents.

    Contents are cut into pieces and counted piece by piece; at most 256 counts per
    piece reach the aggregation, which sums them up within each task first.
    """
    body = F.col(content)
    last = ((F.length(body) - 1) / CHUNK_BYTES).cast("int")
    starts = F.when(F.length(body) > 0, F.sequence(F.lit(0), last))
    pieces = blobs.withColumn("__piece", F.explode_outer(starts)).withColumn(
        "__piece",
        F.coalesce(
            F.substr(body, F.col("__piece") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)),
            F.lit(bytearray()),
        ),
    )
    histograms = pieces.select(*keys, byte_histogram("__piece").alias("__counts"))
    # One zero count per piece stays, so that empty contents keep their row. The outer form
    # keeps the optimizer from counting twice to look for empty arrays, which there are none of.
    exploded = histograms.select(*keys, F.posexplode_outer("__counts").alias("__byte", "__n")).where(
        (F.col("__n") > 0) | (F.col("__byte") == 0)
    )
    counts = exploded.groupBy(*keys, "__byte").agg(F.sum("__n").alias("__n"))
    n = F.col("__n").cast("double")
    per_key = counts.groupBy(*keys).agg(
        F.sum("__n").alias("size"),
        F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0)).alias("__nlogn"),
    )
    # -sum p log2 p = log2 N - (sum n log2 n) / N
    entropy = F.when(
        F.col("size") > 0, F.log2(F.col("size").cast("double")) - F.col("__nlogn") / F.col("size")
    ).otherwise(0.0)
    return per_key.select(*keys, "size", F.greatest(entropy, F.lit(0.0)).alias("entropy"))


def section_features(corpus: DataFrame, key: str = "path") -> DataFrame:
    """Raw size and entropy of each named section."""
    keys = [key, "section_index", "section", "raw_size"]
    return byte_entropy(pe.sections(corpus, key), keys).drop("size")


def import_features(imports: DataFrame) -> DataFrame:
    """Number of DLLs per file and imports from the four common ones, from (file, dll, symbol) rows."""
    per_dll = (
        imports.withColumn("dll", F.lower("dll"))
        .groupBy("file", "dll")
        .agg(F.count("*").alias("n"))  # imports by ordinal have no symbol
    )
    common = [
        F.sum(F.when(F.col("dll") == dll, F.col("n")).otherwise(0)).alias(f"import_{dll}")
        for dll in V.COMMON_DLLS
    ]
    return per_dll.groupBy("file").agg(F.count("*").alias("num_imports"), *common)


def detected_features(features: DataFrame, key: str, counts: str) -> DataFrame:
    """Features of a count map that occur, with their importance."""
    return (
        # The outer form, since the plain one makes the optimizer count everything twice to
        # drop empty maps early; rows of empty maps go with the filter.
        features.select(key, F.explode_outer(counts).alias("feature", "value"))
        .where((F.col("value") > 0) & (F.col("feature") != "hash"))
        .withColumn("importance", files.importance(F.col("value")))
    )


def expired_files(corpus: DataFrame, as_of: Column, hours: float = V.RETENTION_HOURS) -> DataFrame:
    """Files last changed more than ``hours`` before ``as_of``. Lists them; deletes nothing."""
    limit = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))
    return corpus.where(F.col("modificationTime") < limit)

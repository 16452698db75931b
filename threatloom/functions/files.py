"""Names, sizes, hashes and admission of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom import fixed_values as V

HASHES = {
    "sha256": lambda c: F.sha2(c, 256),
    "sha224": lambda c: F.sha2(c, 224),
    "sha384": lambda c: F.sha2(c, 384),
    "sha512": lambda c: F.sha2(c, 512),
    "sha1": F.sha1,
    "md5": F.md5,
}


def file_hash(content: Column, algorithm: str = "sha256") -> Column:
    if algorithm not in HASHES:
        raise ValueError(f"unknown hash {algorithm!r}; one of {sorted(HASHES)}")
    return HASHES[algorithm](content)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def suffix(name: Column) -> Column:
    """Lower-case extension with its dot; names that start or end with their only dot have none."""
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))


def is_allowed(name: Column) -> Column:
    return extension(name).isin(V.ALLOWED_EXTENSIONS)


def safe_name(name: Column) -> Column:
    """A name without path separators, spaces or characters outside [A-Za-z0-9_.-]."""
    spaced = F.regexp_replace(name, r"[/\\]", " ")
    joined = F.regexp_replace(F.trim(F.regexp_replace(spaced, r"\s+", " ")), " ", "_")
    kept = F.regexp_replace(joined, r"[^A-Za-z0-9_.\-]", "")
    return F.regexp_replace(kept, r"^[._]+|[._]+$", "")


def format_bytes(size: Column) -> Column:
    """Size with a unit, base 1024, two decimals, ties to the even digit."""
    value = size.cast("double")

    def text(scaled: Column, unit: str) -> Column:
        return F.format_string(f"%.2f {unit}", F.bround(scaled, 2))

    result = F.when(value < 1024.0, text(value, "B"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        scaled = value / float(1024**power)
        result = result.when(scaled < 1024.0, text(scaled, unit))
    return result.otherwise(text(value / float(1024**5), "PB"))


def size_ok(length: Column, max_mb: int = V.MAX_FILE_MB) -> Column:
    return length <= max_mb * 1024 * 1024


def validation_reason(length: Column, max_mb: int = V.MAX_FILE_MB) -> Column:
    return (
        F.when(length.isNull(), "File does not exist")
        .when(~size_ok(length, max_mb), f"File size exceeds {max_mb}MB limit")
        .otherwise("File is valid")
    )


def importance(count: Column) -> Column:
    """Rank of a detected feature by how often it occurs."""
    return F.when(count > 10, "High").when(count > 5, "Medium").when(count > 0, "Low")

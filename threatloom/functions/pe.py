"""PE header fields decoded from file bytes with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom import fixed_values as V

# Bytes of the COFF header and of the longer optional header with its directories.
_COFF_BYTES = 24
_HEADER_BYTES = _COFF_BYTES + 112 + 16 * 8


def reversed_hex(data: Column, size: int) -> Column:
    """Hex text of the bytes, last byte first, as if the data were padded with zeros to ``size``.

    A little-endian number is then one constant slice of the text.
    """
    padded = F.rpad(F.hex(data), 2 * size, "0")
    return F.regexp_replace(F.reverse(padded), "(.)(.)", "$2$1")


def little_endian(text: Column, total: int, offset: int, size: int) -> Column:
    """Hex digits of the number of ``size`` bytes at ``offset`` in a reversed text of ``total`` bytes."""
    return F.substring(text, 2 * (total - offset - size) + 1, 2 * size)


def unsigned(digits: Column, size: int) -> Column:
    number = F.conv(digits, 16, 10)
    return number.cast("decimal(20,0)" if size == 8 else "bigint")


def with_offset(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``pe_offset``, where the PE signature stands; null where the file is not PE."""
    body = F.col(content)
    looks_dos = (F.substring(body, 1, 2) == F.lit(bytearray(b"MZ"))) & (F.length(body) >= 64)
    pointed = unsigned(reversed_hex(F.substring(body, 61, 4), 4), 4)
    at = F.col("pe_offset")
    signed = F.substr(body, (at + 1).cast("int"), F.lit(4)) == F.lit(bytearray(b"PE\0\0"))
    return df.withColumn("pe_offset", F.when(looks_dos & (pointed < F.length(body)), pointed)).withColumn(
        "pe_offset", F.when(signed, at)
    )


def with_header(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``pe_offset``, ``pe_header`` (reversed hex from the signature on) and ``pe_bytes``, the
    header bytes the file has. All are null where the file is not PE."""
    body, at = F.col(content), F.col("pe_offset")
    head = F.substr(body, (at + 1).cast("int"), F.lit(_HEADER_BYTES))
    return with_offset(df, content).withColumns(
        {
            "pe_header": F.when(at.isNotNull(), reversed_hex(head, _HEADER_BYTES)),
            "pe_bytes": F.least(F.length(body) - at, F.lit(_HEADER_BYTES)),
        }
    )


HEADER_COLUMNS = ["pe_offset", "pe_header", "pe_bytes"]


def header_number(offset: int, size: int) -> Column:
    """A number of the header by its offset from the signature; null past the end of the file."""
    digits = little_endian(F.col("pe_header"), _HEADER_BYTES, offset, size)
    return unsigned(F.when(F.col("pe_bytes") >= offset + size, digits), size)


def _is_plus() -> Column:
    return header_number(_COFF_BYTES, 2) == V.PE32_PLUS_MAGIC


def is_pe(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``is_pe``: DOS magic, and the PE signature where the DOS header points."""
    return with_offset(df, content).withColumn("is_pe", F.col("pe_offset").isNotNull()).drop("pe_offset")


def header_fields(df: DataFrame, content: str = "content") -> DataFrame:
    """Add the 28 header features, null for files that are not PE."""
    df = with_header(df, content).withColumn("pe_plus", _is_plus())
    fields: dict[str, Column] = {}
    for name, offset, size in V.COFF_FIELDS:
        fields[name] = header_number(4 + offset, size)
    for name, offset, size, plus_offset, plus_size in V.OPTIONAL_FIELDS:
        plain = header_number(_COFF_BYTES + offset, size)
        if (offset, size) == (plus_offset, plus_size):
            fields[name] = plain
        else:
            plus = header_number(_COFF_BYTES + plus_offset, plus_size)
            target = "decimal(20,0)" if plus_size == 8 else "bigint"
            fields[name] = F.when(F.col("pe_plus"), plus.cast(target)).otherwise(plain.cast(target))
    name, offset, size = V.COFF_SECTION_COUNT
    fields[name] = header_number(4 + offset, size)
    return df.withColumns(fields).drop(*HEADER_COLUMNS, "pe_plus")


def has_resources(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``has_resources``: 1 where the resource directory is not empty, 0 otherwise."""
    plain, plus = (_COFF_BYTES + at + 8 * V.RESOURCE_DIRECTORY_INDEX + 4 for at in V.DATA_DIRECTORY_OFFSET)
    size = F.when(_is_plus(), header_number(plus, 4)).otherwise(header_number(plain, 4))
    return (
        with_header(df, content)
        .withColumn("has_resources", F.coalesce((size > 0).cast("int"), F.lit(0)))
        .drop(*HEADER_COLUMNS)
    )


def with_section_table(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``sections``: name, claimed raw size, and where its bytes lie in the contents (start, held),
    for every section whose table row the file has; null where the file is not PE."""
    body, total = F.col(content), V.SECTION_HEADER_BYTES
    counted = with_header(df, content).withColumns(
        {
            "__count": header_number(4 + V.COFF_SECTION_COUNT[1], 2),
            "__table": F.col("pe_offset") + _COFF_BYTES + header_number(4 + 16, 2),
        }
    )
    end = F.length(body).cast("bigint")
    whole = F.greatest(F.lit(0), F.least(F.col("__count"), F.floor((end - F.col("__table")) / total)))

    def row(i: Column) -> Column:
        start = (F.col("__table") + i * total).cast("int")
        entry = reversed_hex(F.substr(body, start + 1, F.lit(total)), total)
        name = F.decode(F.substr(body, start + 1, F.lit(8)), "ISO-8859-1")
        raw_size = unsigned(little_endian(entry, total, 16, 4), 4)
        raw_offset = unsigned(little_endian(entry, total, 20, 4), 4)
        begin = F.least(raw_offset, end)
        return F.struct(
            F.regexp_replace(name, r"^\x00+|\x00+$", "").alias("name"),
            raw_size.alias("raw_size"),
            begin.alias("start"),
            F.least(raw_size, end - begin).alias("held"),
        )

    numbers = F.when(whole > 0, F.sequence(F.lit(0), whole.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    table = F.when(F.col("__count").isNotNull(), F.transform(numbers, row))
    return counted.withColumn("sections", table).drop(*HEADER_COLUMNS, "__count", "__table")


def sections(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row per section of PE files: position, name, raw size and raw bytes."""
    body = F.col(content)
    counted = with_header(df, content).withColumns(
        {
            "__count": header_number(4 + V.COFF_SECTION_COUNT[1], 2),
            "__table": F.col("pe_offset") + _COFF_BYTES + header_number(4 + 16, 2),
        }
    )
    # The outer form: the plain one would decode the header twice to look for empty ranges.
    numbered = counted.where("__count > 0").withColumn(
        "section_index", F.explode_outer(F.sequence(F.lit(0), F.col("__count").cast("int") - 1))
    )
    total = V.SECTION_HEADER_BYTES
    start = (F.col("__table") + F.col("section_index") * total).cast("int")
    entry = reversed_hex(F.substr(body, start + 1, F.lit(total)), total)
    placed = numbered.where(F.length(body) >= start + total).withColumns(
        {"__entry": entry, "__name": F.decode(F.substr(body, start + 1, F.lit(8)), "ISO-8859-1")}
    )
    raw_size = unsigned(little_endian(F.col("__entry"), total, 16, 4), 4)
    raw_offset = unsigned(little_endian(F.col("__entry"), total, 20, 4), 4)
    # A file can claim any offset and size; both end with the content.
    end = F.length(body).cast("bigint")
    start_at, size = F.least(raw_offset.cast("bigint"), end), F.least(raw_size.cast("bigint"), end)
    return placed.select(
        key,
        "section_index",
        F.regexp_replace("__name", r"^\x00+|\x00+$", "").alias("section"),
        raw_size.alias("raw_size"),
        F.substr(body, (start_at + 1).cast("int"), size.cast("int")).alias("bytes"),
    )

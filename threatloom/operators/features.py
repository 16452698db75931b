"""The whole feature vector of a file: several extractors, one read, one map of what was measured.

Extractors give maps from feature name to value: header fields, structure (sizes, sections, resources),
string statistics, imports, and counts of tokens. A name that an extractor measures is that value; any
other name of more than three characters is a token to count in the contents. The merged map is
aligned to the columns a model was fitted on: what is absent is 0, what is not asked for is not
computed where that saves a pass over the contents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom import fixed_values as V
from threatloom.functions import pe, text
from threatloom.operators.corpus import import_features
from threatloom.operators.quality import align_map

FEATURES = "features"
STRUCTURE = ["size", "file_size", "num_sections", "has_resources"]
STRINGS = ["printable_chars", "url_count", "ip_count"]
IMPORTS = ["num_imports", *[f"import_{dll}" for dll in V.COMMON_DLLS]]
_SECTION = re.compile(r"section_.*_(size|entropy)", re.DOTALL)
# Contents are counted in blocks, so that sections which overlap cost their edges only.
BLOCK_BYTES = 4_096
# Blocks counted at once: what is held beside a content does not grow by eight bytes for each of its bytes.
PIECE_BLOCKS = 64
_MAP = "map<string,double>"


def is_measured(name: str) -> bool:
    """True for names that an extractor measures."""
    return name in {*V.PE_FEATURES, *STRUCTURE, *STRINGS, *IMPORTS} or bool(_SECTION.fullmatch(name))


def token_names(columns: Iterable[str]) -> list[str]:
    """Columns that are counted as tokens."""
    return [c for c in columns if not is_measured(c) and len(c) >= V.MIN_TOKEN_LENGTH and c != "hash"]


def _block_counts(data: np.ndarray) -> np.ndarray:
    """Counts of each byte value in each block, a piece of the content at a time."""
    counts = np.zeros((-(-len(data) // BLOCK_BYTES), 256), dtype=np.int64)
    for first in range(0, len(counts), PIECE_BLOCKS):
        part = data[first * BLOCK_BYTES : (first + PIECE_BLOCKS) * BLOCK_BYTES]
        blocks = -(-len(part) // BLOCK_BYTES)
        at = np.arange(len(part), dtype=np.int32) // BLOCK_BYTES
        counts[first : first + blocks] = np.bincount(at * 256 + part, minlength=blocks * 256).reshape(blocks, 256)
    return counts


def _entropies(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Entropy in bits per byte of parts of a content, 0 for empty ones."""
    upto = np.concatenate([np.zeros((1, 256), dtype=np.int64), _block_counts(data)])
    np.cumsum(upto, axis=0, out=upto)
    result = np.zeros(len(starts))
    for i, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
        if not size:
            continue
        first, last = -(-start // BLOCK_BYTES), (start + size) // BLOCK_BYTES
        if first < last:
            edges = np.concatenate([data[start : first * BLOCK_BYTES], data[last * BLOCK_BYTES : start + size]])
            n = upto[last] - upto[first] + np.bincount(edges, minlength=256)
        else:
            n = np.bincount(data[start : start + size], minlength=256)
        share = n[n > 0] / size
        result[i] = max(0.0, float(-(share * np.log2(share)).sum()))
    return result


@F.arrow_udf(T.MapType(T.StringType(), T.DoubleType()))
def section_map(content: pa.Array, sections: pa.Array) -> pa.Array:
    """``section_<name>_size`` and ``section_<name>_entropy``; of equal names the last counts.

    Contents are read where they lie in the batch, one after the other; none is copied.
    """

    def one(i):
        entries = sections[i].as_py()
        if not entries:
            return []
        data = np.frombuffer(content[i].as_buffer(), dtype=np.uint8)
        starts, sizes = (np.array([e[k] for e in entries], dtype=np.int64) for k in ("start", "held"))
        entropies = _entropies(data, starts, sizes)
        found = {}
        for entry, entropy in zip(entries, entropies.tolist()):
            found[f"section_{entry['name']}_size"] = float(entry["raw_size"])
            found[f"section_{entry['name']}_entropy"] = entropy
        return list(found.items())

    return pa.array([one(i) for i in range(len(content))], pa.map_(pa.string(), pa.float64()))


def _map(values: dict[str, Column]) -> Column:
    """A map of the values that are there."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), v.cast("double").alias("value")) for n, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def _merged(first: Column, second: Column) -> Column:
    """Both maps in one; a name in both has the first one's value."""
    return F.map_zip_with(first, second, lambda _, a, b: F.coalesce(a, b))


def with_features(
    corpus: DataFrame,
    columns: list[str] | None = None,
    imports: DataFrame | None = None,
    key: str = "path",
    prefix_bytes: int | None = None,
) -> DataFrame:
    """Add ``features``, the map of all that is measured in ``content``, and token counts.

    ``columns`` are the names a model wants; without them all extractors run and the tokens are the
    usual API names. ``imports`` is a table of (file, dll, symbol) whose ``file`` is the key. Strings
    are searched in whole contents, or in their first ``prefix_bytes``.
    """
    wanted = None if columns is None else set(columns)

    def asked(names: Iterable[str]) -> list[str]:
        return [n for n in names if wanted is None or n in wanted]

    before = corpus.columns
    described = pe.has_resources(pe.header_fields(corpus))
    length = F.length("content").cast("bigint")
    in_pe = F.col(V.COFF_SECTION_COUNT[0]).isNotNull()
    measured = {
        **{n: F.col(n) for n in V.PE_FEATURES},
        "size": F.when(in_pe, length),
        "file_size": length,
        "num_sections": F.col(V.COFF_SECTION_COUNT[0]),
        "has_resources": F.when(in_pe, F.col("has_resources")),
    }
    body = text.latin1_text(F.col("content"), prefix_bytes)
    strings = {"printable_chars": text.printable_chars, "url_count": text.url_count, "ip_count": text.ip_count}
    measured |= {n: strings[n](body) for n in asked(STRINGS)}
    found = _map({n: measured[n] for n in asked(measured)}) if asked(measured) else F.create_map().cast(_MAP)
    tokens = V.API_TOKENS if columns is None else token_names(columns)
    if tokens:
        found = _merged(found, text.token_counts(body, tokens).cast(_MAP))
    if wanted is None or any(_SECTION.fullmatch(c) for c in wanted):
        described = pe.with_section_table(described)
        found = _merged(found, F.coalesce(section_map("content", "sections"), F.create_map().cast(_MAP)))
    result = described.withColumn(FEATURES, found).select(*before, FEATURES)
    if imports is None or not asked(IMPORTS):
        return result
    counted = import_features(imports)
    given = counted.select(
        F.col("file").alias("__file"), _map({n: F.col(f"`{n}`") for n in asked(IMPORTS)}).alias("__imports")
    )
    joined = result.join(given, F.col(key) == F.col("__file"), "left")
    both = _merged(F.col(FEATURES), F.coalesce("__imports", F.create_map().cast(_MAP)))
    return joined.withColumn(FEATURES, both).select(*before, FEATURES)


def file_features(
    corpus: DataFrame, columns: list[str], *keep: str, imports: DataFrame | None = None, key: str = "path",
    prefix_bytes: int | None = None,
) -> DataFrame:
    """The columns a model was fitted on, in their order, after the columns ``keep``."""
    found = with_features(corpus, columns, imports, key, prefix_bytes).select(*keep, FEATURES)
    return align_map(found, FEATURES, columns).drop(FEATURES)

"""Word hashes and hashed shingle sets of Arrow text columns, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are parted at once; a longer text is a slice of its own.
SLICE_BYTES = 8_000_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit words (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds at most ``most`` bytes of the text column, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def parted(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts in order as a dictionary array, and the number of words of each text.

    Words are parted by the six ASCII space characters; null is an empty text.
    """
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    upto = np.concatenate([[0], np.cumsum(there, dtype=np.int64)])[offsets]
    if not there.all():
        flat = flat.filter(pa.array(there))
    return flat.dictionary_encode(), np.diff(upto)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, ASCII letters lower-cased, and the number of words of each text."""
    flat, counts = parted(pc.ascii_lower(texts))
    unique = flat.dictionary.to_pandas().to_numpy(dtype=object)
    hashes = pd.util.hash_array(unique, categorize=False) if len(unique) else np.empty(0, np.uint64)
    return hashes[flat.indices.to_numpy()], counts


def _folded(parts: list[np.ndarray], count: int) -> np.ndarray:
    """One hash for each row of neighbouring words; their number is part of it."""
    value = np.full(len(parts[0]), np.uint64(count))
    for part in parts:
        value = mixed(value * _STEP + part)
    return value


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text.

    Fewer words than ``size``: the whole sequence is one shingle. No word: an empty set.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    last = len(hashes) - size + 1
    grams = _folded([hashes[k : last + k] for k in range(size)], size) if last > 0 else hashes[:0]
    sets = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        start = end - count
        if count >= size:
            sets.append(np.unique(grams[start : end - size + 1]))
        elif count:
            sets.append(_folded([hashes[i : i + 1] for i in range(start, end)], count))
        else:
            sets.append(grams[:0])
    return sets

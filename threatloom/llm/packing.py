"""Packing along a space-filling curve: neighbours in content become neighbours in a sequence.

A document's token ids are hashed to a vector of counts, damped by a square root and brought
to unit length; fixed random axes project it to three coordinates, whose Hilbert index orders
the documents. Along that order tokens get one running position, and a sequence is the next
``length`` of them. Documents are cut where a sequence is full, so only the last sequence of
all is not full.

Positions come from blocks of the order (see ``operators.ranking``); the curve's lower bits
hold a hash of the document, so a large group of copies is cut into blocks like any other rows.

Ids are the tokenizer's own, its added tokens included where a text holds their strings. Null or
empty text: the end token alone. Repeated rows are packed each. Rows without a
``doc_id`` are packed too and keep their null. A text longer than a segment is several rows
with ids, so no row grows with a text. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import named, stored
from threatloom.llm.hilbert import hilbert_index
from threatloom.llm.shingles import mixed, slices
from threatloom.operators.ranking import running_sums

SEQUENCE = 1024
END_ID = 0
#: Ids of a long document that stay in one row.
SEGMENT = 65_536
DIMENSIONS = 64
AXES = 3
BITS = 10
TIE_BITS = 22
#: Bytes of pieces whose ids a worker keeps; beyond it starts anew.
CACHE_BYTES = 96_000_000
#: Ids of a block of the order.
BLOCK_IDS = 8_000_000


# Fixed value: how a byte-level tokenizer of this family parts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The function from a text to its ids, for a tokenizer file; its added tokens are tokens where a text holds them.

    Where a merge's place in the file is the order of its id, and words are parted by the plain
    pattern, the vocabulary holds all there is to know, and tiktoken merges by it; it encodes short
    pieces several times faster and gives the same ids. Any other tokenizer encodes by itself.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, letters = content["model"], byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocabulary = model["vocab"]
    made = [vocabulary.get("".join(pair)) for pair in merges]
    if is_plain(content) and None not in made and made == sorted(made):
        import tiktoken

        special = {token["content"]: token["id"] for token in content["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in piece): rank for piece, rank in vocabulary.items() if piece not in special
        }
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return functools.partial(encoding.encode, allowed_special="all")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def is_plain(content: dict) -> bool:
    """True for a byte-level tokenizer that changes nothing before or after and parts words by its usual
    pattern, so that a text may be cut before the last space of every run."""
    parting = content.get("pre_tokenizer") or {}
    return (
        parting.get("type") == "ByteLevel"
        and not parting.get("add_prefix_space")
        and parting.get("use_regex", True)
        and not content.get("normalizer")
        and (content.get("post_processor") or {}).get("type") in (None, "ByteLevel")
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"]
            for t in content.get("added_tokens", [])
        )
    )


@functools.lru_cache(maxsize=2)
def _cuttable(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        return is_plain(json.load(file))


class _Known:
    """Ids, as bytes, of the pieces seen so far in this process, bounded by bytes."""

    def __init__(self):
        self.ids: dict[str, bytes] = {}
        self.held = 0


_KNOWN: dict[str, _Known] = {}


def _piece_ids(path: str, pieces: list[str]) -> list[bytes]:
    encode, known = encoder(path), _KNOWN.setdefault(path, _Known())
    if known.held > CACHE_BYTES:
        known.ids.clear()
        known.held = 0
    for piece in pieces:
        if piece not in known.ids:
            found = known.ids[piece] = array("I", encode(piece)).tobytes()
            known.held += 200 + len(piece) + len(found)
    return [known.ids[piece] for piece in pieces]


_EMPTY, _SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())

# White space as the pattern above sees it. A run of it is one piece but for its last character.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?=[{_WHITE}][^{_WHITE}])|[{_WHITE}]+")
#: Pieces of a text that are held at once.
PIECES = 100_000


def _run_ids(path: str, text: str) -> np.ndarray:
    """Ids of a text with runs of white space, piece by piece."""
    if not _cuttable(path):
        return np.array(encoder(path)(text), dtype=np.uint32)
    found, pieces = [], []
    for match in _PIECES.finditer(text):
        pieces.append(match[0])
        if len(pieces) == PIECES:
            found += _piece_ids(path, pieces)
            found, pieces = [b"".join(found)], []
    return np.frombuffer(b"".join([*found, *_piece_ids(path, pieces)]), dtype=np.uint32)


def token_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each text.

    A byte-level tokenizer of this kind never joins across a single space that precedes a
    word, so a text is cut there and each distinct piece is encoded once. Texts with doubled,
    leading or trailing spaces are cut by a pattern that keeps runs of white space together.
    """
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(texts, r"^ |  | $")
    if not _cuttable(path):
        odd = pa.array([True] * len(texts))
    plain = pc.if_else(odd, "", texts)
    lists = pc.split_pattern(plain, " ")
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    first = np.zeros(len(flat), dtype=bool)
    first[offsets[:-1]] = True
    pieces = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(_EMPTY, flat, _SPACE))
    coded = pieces.dictionary_encode()
    ids = _piece_ids(path, coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = coded.indices.to_numpy()
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    pool = np.frombuffer(b"".join(ids), dtype=np.uint32)
    at = np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    result = pool[at]
    upto = np.concatenate([[0], ends])[offsets]
    counts = np.diff(upto)
    if pc.any(odd).as_py():
        parts, counts = [], counts.copy()
        for i, whole in enumerate(odd.to_pylist()):
            part = result[upto[i] : upto[i + 1]]
            if whole:
                part = _run_ids(path, texts[i].as_py())
                counts[i] = len(part)
            parts.append(part)
        result = np.concatenate(parts)
    return result, counts


def curve_positions(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert index of each document from its token ids."""
    rows = np.repeat(np.arange(len(counts)), counts)
    hashed = mixed(ids.astype(np.uint64) + np.uint64(1))
    buckets = (hashed % np.uint64(DIMENSIONS)).astype(np.int64)
    vectors = np.sqrt(
        np.bincount(rows * DIMENSIONS + buckets, minlength=len(counts) * DIMENSIONS)
    ).reshape(len(counts), DIMENSIONS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    axes = np.random.default_rng(7).standard_normal((DIMENSIONS, AXES))
    axes -= axes.mean(axis=0)  # the part that all documents share says nothing
    axes /= np.linalg.norm(axes, axis=0)
    cells = np.clip((vectors @ axes + 1) / 2, 0, 1 - 1e-9) * (1 << BITS)
    return hilbert_index(cells.astype(np.int64), BITS)


def _tokenizing(path: str):
    """Arrow function: (doc_id, text) to segments of ids with the document's place on the curve."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 4_000_000):
                ids, counts = token_ids(path, part.column(1))
                places = curve_positions(ids, counts)
                keys = part.column(0).to_pylist()
                rows, at = [], 0
                for key, place, n in zip(keys, places.tolist(), counts.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(END_ID))
                    at += n
                    tie = int(mixed(np.array([(key or 0) % 2**64], dtype=np.uint64))[0]) >> (64 - TIE_BITS)
                    for start in range(0, n + 1, SEGMENT):
                        piece = own[start : start + SEGMENT]
                        rows.append((key, place << TIE_BITS | tie, start, len(piece), n + 1, narrow(piece)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows), _SEGMENT.types)], schema=_SEGMENT
                )

    return run


_SEGMENT = pa.schema(
    [("doc_id", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("n", pa.int64()),
     ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)


def narrow(ids: np.ndarray) -> bytes:
    """Ids as 16-bit words if all fit, else as 32-bit words; the length tells which."""
    return ids.astype("<u2" if len(ids) and ids.max() < 65_536 else "<u4").tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def _cutting(length: int):
    """Arrow function: segments with their place in the order to pieces of sequences."""

    def run(batches):
        for batch in batches:
            for part in batch_rows(batch, 256):
                columns = [part.column(c).to_pylist() for c in range(part.num_columns)]
                rows = []
                for key, start, n, total, data, position in zip(*columns):
                    ids, at = widened(data, n), 0
                    while at < n:
                        sequence, offset = divmod(position + at, length)
                        size = min(length - offset, n - at)
                        rows.append((key, start + at, size, total, sequence, offset, ids[at : at + size].tobytes()))
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows), _PIECE.types)], schema=_PIECE
                )

    return run


_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)


def batch_rows(batch: pa.RecordBatch, rows: int):
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` are little-endian unsigned 32-bit words. Each document ends with ``END_ID``.
    Sequence ``i`` holds the positions ``i * length`` and up of the whole order.
    """
    base = docs.select(named(docs, "doc_id").cast("bigint").alias("doc_id"), named(docs, "text").alias("text"))
    segments = stored(
        base.mapInArrow(
            _tokenizing(tokenizer_path),
            "doc_id bigint, place bigint, start bigint, n bigint, doc_tokens bigint, ids binary",
        ),
        "segments",
    )
    total = segments.agg(F.sum("n")).first()[0] or 0
    blocks = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_IDS))
    placed = running_sums(
        segments, [], F.col("place"), {"upto": F.col("n")}, ties=["doc_id", "start", "ids"], blocks=blocks
    ).select("doc_id", "start", "n", "doc_tokens", "ids", (F.col("upto") - F.col("n")).alias("position"))
    return placed.mapInArrow(
        _cutting(length),
        "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, ids binary",
    )

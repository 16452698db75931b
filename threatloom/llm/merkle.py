"""Merkle trees over paragraphs and sections, so that equal roots mean equal texts.

Leaves are paragraphs (lines with their line end), a long one in pieces of ``PIECE`` code
points from its start. A section is a run of leaves that ends after a blank line or after a
leaf whose digest says so, so an insertion moves the bounds near it only. A section's digest
covers its leaves, the root covers the sections. Two trees are compared from the root down:
equal sections are skipped, and the leaves of the others locate the edits.

The fingerprint is the root followed by its branches, ``root/section:leaf.leaf/...``, with
inner digests cut to 32 bits; the root has 128 bits and decides equality. The likeness of
two fingerprints is the share of leaves they have in common.

Null text is empty; an empty text is a root without branches, and two of them are alike (1.0).
A text's neighbour is the next row by ``doc_id``, then text; rows without a ``doc_id`` come
last; after the last row comes the first, so a single row is its own neighbour. Repeated rows
are rows each. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import named
from threatloom.operators.ranking import BLOCK, with_blocks

PIECE = 128
#: One of so many leaves ends a section.
SECTION = 8


def _digest(content: bytes) -> bytes:
    return blake2b(content, digest_size=16).digest()


def leaves(text: str) -> list[str]:
    """The pieces of all paragraphs in order; put together they are the text."""
    found = []
    for paragraph in text.split("\n"):
        paragraph += "\n"
        if len(paragraph) <= PIECE:
            found.append(paragraph)
        else:
            found.extend(paragraph[i : i + PIECE] for i in range(0, len(paragraph), PIECE))
    last = found[-1][:-1]  # the text's end is no line end
    return [*found[:-1], last] if last else found[:-1]


class Tree:
    """Root, sections and leaf digests of a text."""

    def __init__(self, text: str):
        pieces = leaves(text)
        self.leaves = [_digest(piece.encode("utf-8", "replace")) for piece in pieces]
        self.lengths = [len(piece) for piece in pieces]
        self.sections: list[tuple[bytes, int, int]] = []
        start = 0
        for i, (digest, piece) in enumerate(zip(self.leaves, pieces), 1):
            if i == len(pieces) or piece == "\n" or digest[0] % SECTION == 0:
                self.sections.append((_digest(b"".join(self.leaves[start:i])), start, i))
                start = i
        self.root = _digest(b"".join(section for section, _, _ in self.sections))

    def fingerprint(self) -> str:
        branches = (
            section[:4].hex() + ":" + ".".join(leaf[:4].hex() for leaf in self.leaves[start:end])
            for section, start, end in self.sections
        )
        return "/".join([self.root.hex(), *branches])


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common; branches alike are not opened."""
    (root_a, *left), (root_b, *right) = a.split("/"), b.split("/")
    if root_a == root_b:
        return 1.0
    sections_a, sections_b = Counter(left), Counter(right)
    same = sections_a & sections_b
    common = sum(n * _leaf_count(branch) for branch, n in same.items())
    rest = [
        Counter(leaf for branch, n in (s - same).items() for leaf in branch[9:].split(".") * n)
        for s in (sections_a, sections_b)
    ]
    total = 2 * common + sum(rest[0].values()) + sum(rest[1].values())
    return 2 * (common + sum((rest[0] & rest[1]).values())) / total if total else 1.0


def _leaf_count(branch: str) -> int:
    return (len(branch) - 8) // 9


def edits(old: str, new: str) -> list[tuple[int, int]]:
    """Spans (start, end) of ``new``, in code points, that lie in no leaf of an unchanged branch.

    Sections of the old text are matched first, then single leaves within the others.
    """
    before, after = Tree(old), Tree(new)
    if before.root == after.root:
        return []
    known = Counter(section for section, _, _ in before.sections)
    opened = Counter(
        leaf for section, i, j in before.sections
        if section not in {s for s, _, _ in after.sections} for leaf in before.leaves[i:j]
    )
    spans, at = [], 0
    for section, start, end in after.sections:
        whole = known[section] > 0
        known[section] -= whole
        for leaf, length in zip(after.leaves[start:end], after.lengths[start:end]):
            if not whole:
                if opened[leaf] > 0:
                    opened[leaf] -= 1
                elif spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + length)
                else:
                    spans.append((at, at + length))
            at += length
    return spans


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the following."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_from", pa.int64()),
])


def _compared(batches):
    """Arrow function over rows sorted by block: each row against the one after it."""
    previous = None
    for batch in batches:
        rows = []
        for block, halo, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
            text = text or ""
            tree = Tree(text)
            mark = tree.fingerprint()
            if previous and previous[0] == block and not previous[1]:
                _, _, own_id, own, own_mark = previous
                changed = edited(own, text)
                other = Tree(changed).fingerprint() if changed != own else own_mark
                spans = edits(own, changed) if changed != own else []
                rows.append((
                    own_id, len(own), sha256(changed.encode("utf-8", "replace")).hexdigest(), own_mark, other,
                    likeness(own_mark, other), likeness(own_mark, mark), spans[0][0] if spans else None,
                ))
            previous = (block, halo, doc_id, text, mark)
        columns = list(zip(*rows)) if rows else [[] for _ in _RESULT]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and how alike they are.

    The rows are cut into blocks of neighbouring ids. The first row of a block also goes to
    the end of the block before it (the very first to the end of the last block), so every
    row meets its neighbour in one task that reads its block once, in order.
    """
    spark = docs.sparkSession
    base = docs.select(named(docs, "doc_id").cast("bigint").alias("doc_id"), named(docs, "text").alias("text"))
    blocks = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocked = with_blocks(base, F.col("doc_id"), blocks)
    firsts = sorted(  # one id for each block: as many rows as blocks
        (row[BLOCK] if row[BLOCK] is not None else blocks, row["first"])
        for row in blocked.groupBy(BLOCK).agg(F.min("doc_id").alias("first")).collect()
    )
    numbers = [block for block, _ in firsts]
    targets = [(first, numbers[i - 1]) for i, (_, first) in enumerate(firsts)]
    halo = F.broadcast(spark.createDataFrame(targets, "first bigint, target int"))
    own = blocked.select(F.coalesce(BLOCK, F.lit(blocks)).alias("block"), F.lit(0).alias("halo"), "doc_id", "text")
    extra = base.join(halo, F.col("doc_id").eqNullSafe(F.col("first"))).select(
        F.col("target").alias("block"), F.lit(1).alias("halo"), "doc_id", "text"
    )
    ordered = own.union(extra).repartition(blocks, "block").sortWithinPartitions(
        "block", "halo", F.col("doc_id").asc_nulls_last(), "text"
    )
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double, edited_from bigint"
    )
    return ordered.mapInArrow(_compared, schema)

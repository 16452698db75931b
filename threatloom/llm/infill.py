"""Fill-in-the-middle: texts cut in three and rejoined so that the middle comes last.

Cuts are drawn in code points, texts are bytes. A learned index maps ranks to offsets: the
boundaries of a text's code points are a rising curve of byte offsets over ranks, which straight
segments follow with an error of at most ``ERROR`` bytes. A segment keeps its first rank, the offset
there and its slope; the error that is left at each boundary is stored as one signed byte, and not
at all in a segment without errors. A cut is predicted by its segment and made exact by its residual.

Draws come from the sha256 of ``seed:doc_id``, so they depend on nothing else; a missing id is an
empty one. Null text is empty. An empty text, one that holds a mark, or one that is not drawn stays
plain. Marks are parts of the output that no other part of it holds, so the text is rebuilt from
output and form. Repeated rows get equal results. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import named
from threatloom.llm.shingles import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are cut, and of those that begin with the suffix.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SEED = 1
#: Bytes by which a segment may be wrong: what a signed byte holds.
ERROR = 127
PLAIN, PSM, SPM = "plain", "psm", "spm"


def boundaries(text: bytes) -> np.ndarray:
    """Byte offset of every code point of a UTF-8 text, and the end."""
    data = np.frombuffer(text, dtype=np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


class RankIndex:
    """Offsets by rank: straight segments and the residuals they leave."""

    def __init__(self, first, base, slope, residuals):
        self.first, self.base, self.slope, self.residuals = first, base, slope, residuals

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Segments through the offsets: a span whose chord is more than ``error`` off at some rank
        is halved there, so every segment keeps the bound."""
        first, base, slope, residuals = [], [], [], []
        spans = [(0, len(offsets) - 1)]
        while spans:
            start, end = spans.pop()
            part = offsets[start : end + 1]
            rise = (int(part[-1]) - int(part[0])) / max(1, end - start)
            off = part - _line(int(part[0]), rise, np.arange(len(part)))
            worst = int(np.abs(off).argmax())
            if abs(int(off[worst])) > error:
                spans += [(start + worst, end), (start, start + worst)]
                continue
            first.append(start)
            base.append(int(part[0]))
            slope.append(rise)
            residuals.append(off.astype(np.int8) if off.any() else None)
        return cls(np.array(first), np.array(base), np.array(slope), residuals)

    def offset(self, rank: int) -> int:
        """The exact offset of a rank: prediction and stored residual."""
        at = int(np.searchsorted(self.first, rank, side="right")) - 1
        inside = rank - int(self.first[at])
        left = self.residuals[at]
        predicted = int(_line(int(self.base[at]), float(self.slope[at]), np.array([inside]))[0])
        return predicted + (int(left[inside]) if left is not None else 0)

    def nbytes(self) -> int:
        return 24 * len(self.first) + sum(len(r) for r in self.residuals if r is not None)


def _line(base: int, slope: float, inside: np.ndarray) -> np.ndarray:
    return base + np.rint(slope * inside).astype(np.int64)


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2**32 from the hash of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def planned(
    docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT
) -> DataFrame:
    """doc_id, n (code points), form, the ranks of both cuts, and the text."""
    rows = docs.select(
        named(docs, "doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(named(docs, "text"), F.lit("")).alias("text"),
    ).withColumn("n", F.length("text").cast("bigint"))
    one, two, three, four = drawn(F.col("doc_id"), seed)
    a, b = one % (F.col("n") + 1), two % (F.col("n") + 1)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (three % 100 >= cut_percent)
    form = F.when(plain, PLAIN).when(four % 100 < suffix_first_percent, SPM).otherwise(PSM)
    return rows.select(
        "doc_id", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"), "text"
    )


def _cutting(error: int):
    """Arrow function: texts with form and ranks to outputs, by the learned index of each text."""
    prefix, suffix, middle = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text"), 1_000_000):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                forms, firsts, seconds = (part.column(c).to_pylist() for c in ("form", "first", "second"))
                outputs, segments, sizes = [], [], []
                for text, form, first, second in zip(texts, forms, firsts, seconds):
                    if form == PLAIN:
                        outputs.append(text)
                        segments.append(None)
                        sizes.append(None)
                        continue
                    index = RankIndex.fit(boundaries(text), error)
                    one, two = index.offset(first), index.offset(second)
                    start, end = (prefix, text[:one]), (suffix, text[two:])
                    if form == SPM:
                        start, end = end, start
                    outputs.append(b"".join([*start, *end, middle, text[one:two]]))
                    segments.append(len(index.first))
                    sizes.append(index.nbytes())
                cut = pc.not_equal(part.column("form"), PLAIN)
                span = pc.subtract(part.column("second"), part.column("first"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("n"), part.column("form"),
                        pc.if_else(cut, part.column("first"), None), pc.if_else(cut, span, None),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                        pa.array(segments, pa.int32()), pa.array(sizes, pa.int64()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "segments", "index_bytes"],
                )

    return run


def infilled(
    docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    error: int = ERROR,
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, and the size of the index (segments, index_bytes)."""
    return planned(docs, seed, cut_percent, suffix_first_percent).mapInArrow(
        _cutting(error),
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, "
        "segments int, index_bytes bigint",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""

    def parts(mark: str) -> tuple[Column, Column, Column]:
        """What lies between the first mark and this one, up to the last mark, and after it."""
        first = F.substring(F.split_part(output, F.lit(mark), F.lit(1)), len(mark) + 1, 2**31 - 1)
        rest = F.split_part(output, F.lit(mark), F.lit(2))
        return first, F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))

    prefix, suffix, middle = parts(SUFFIX)
    late_suffix, late_prefix, late_middle = parts(PREFIX)
    return (
        F.when(form == PSM, F.concat(prefix, middle, suffix))
        .when(form == SPM, F.concat(late_prefix, late_middle, late_suffix))
        .otherwise(output)
    )

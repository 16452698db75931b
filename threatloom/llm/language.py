"""Language by compression: the language whose dictionary makes a text smallest.

Each language has a dictionary of raw text from a bounded sample of labelled rows. A text is
lower-cased, reduced to its letters and their marks, cut into chunks, and every chunk of it is encoded with
zstandard once for each language; the smallest sum wins. A margin below ``min_margin`` of the
runner-up's size is no evidence, and the document is marked as rejected.

A letter is a character of Unicode's category L, for fitting and predicting alike. Null text and
text without letters: ``und``, score 0, rejected. With no labelled rows every
text is ``und``. Equal sums go to the language that is first by code point, rejected.
Repeated rows are predicted alike. Columns beside ``doc_id``, ``text`` and (for fitting)
``lang`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import ROW, named, unpacked, whole_row
from threatloom.llm.shingles import slices
from threatloom.operators.joins import checked_broadcast

#: The one bound of what is learned: labelled rows of a language whose whole texts may go into its
#: dictionary, taken by the order of a hash until the dictionary is full.
SAMPLE_ROWS = 400
#: How many times the sample is drawn to take the least hashes of.
OVERSAMPLE = 4
#: Bytes of a dictionary, and of all of them: of very many languages each has a smaller one.
DICTIONARY_BYTES, ALL_BYTES = 65_536, 64_000_000
CHUNK = 2_048
MIN_MARGIN = 0.001
UNKNOWN = "und"
FOLDS = 5

_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def letters(text: str) -> bytes:
    """The words of a text in lower case; nothing if it has no letter."""
    if not _LETTER.search(text):
        return b""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def _sampled(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """lang, order and text of at most about ``OVERSAMPLE`` times ``sample_rows`` rows of each language.

    Rows are counted by language first. Only rows whose hash lies below a share that holds
    about ``OVERSAMPLE`` times the sample are dealt by language, so what is dealt does not
    grow with the rows of a language; equal rows have one hash and are dealt once.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"))
    order = F.xxhash64("doc_id", "text")
    share = (order / F.lit(2.0**64) + 0.5) * F.col("rows")
    return (
        known.join(checked_broadcast(counts), "lang").where(share <= OVERSAMPLE * sample_rows)
        .select("lang", order.alias("order"), "text")
        .distinct()
    )


def _filling(sample_rows: int, dictionary_bytes: int):
    """Arrow function: the sampled rows of a language to its dictionary, row by row until it is full."""

    def fill(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("order").to_pylist(), range(group.num_rows)))[:sample_rows]
        content = b""
        for _, i in rows:
            if len(content) >= dictionary_bytes:
                break
            content += (b" " if content else b"") + letters(group.column("text")[i].as_py())
        return pa.table({"lang": group.column("lang").slice(0, 1), "content": [content[:dictionary_bytes]]})

    return fill


def fit(
    labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES, all_bytes: int = ALL_BYTES
) -> dict[str, bytes]:
    """Language to dictionary, from columns ``doc_id``, ``text`` and ``lang``.

    ``sample_rows`` bounds what is learned from each language, whatever the input's size; every
    labelled language is learned. Dictionaries are filled in the executors, and only they come to
    the driver: ``all_bytes`` at most.
    """
    sample = _sampled(labelled, sample_rows)
    languages = labelled.agg(F.count_distinct("lang")).first()[0]
    own = min(dictionary_bytes, all_bytes // max(1, languages))
    filled = sample.groupBy("lang").applyInArrow(_filling(sample_rows, own), "lang string, content binary")
    return {row["lang"]: bytes(row["content"]) for row in filled.orderBy("lang").collect()}


def _compressors(dictionaries: dict[str, bytes]):
    import zstandard

    made = []
    for content in dictionaries.values():
        settings = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=17, hash_log=17, search_log=3, min_match=4, target_length=16,
            strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings))
    return made


def sizes(compressors, content: bytes) -> list[int]:
    """Bytes of the content under each dictionary, chunk by chunk over the whole of it."""
    chunks = [content[i : i + CHUNK] for i in range(0, len(content), CHUNK)]
    return [sum(len(c.compress(chunk)) for chunk in chunks) for c in compressors]


def decide(langs: list[str], costs: list[int], min_margin: float) -> tuple[str, float, bool]:
    """Language, score and rejection from the sizes under each dictionary.

    The score is one half of evidence: 0.5 where best and second are alike, towards 1 as
    the best becomes smaller than the second.
    """
    if len(costs) == 1:
        return langs[0], 1.0, False
    best, second = np.argsort(costs, kind="stable")[:2].tolist()
    margin = (costs[second] - costs[best]) / costs[second]
    score = 1 / (1 + 2.0 ** (-40 * margin))
    return langs[best], score, margin < min_margin


_RESULT = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def _predicting(dictionaries: dict[str, bytes], min_margin: float):
    """Arrow function: appends prediction, score and rejection to rows whose last column is the text."""

    def run(batches):
        compressors, langs = _compressors(dictionaries), list(dictionaries)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                answers = []
                for text in part.column(part.num_columns - 1):
                    content = letters(text.as_py() or "")
                    if content and langs:
                        answers.append(decide(langs, sizes(compressors, content), min_margin))
                    else:
                        answers.append((UNKNOWN, 0.0, True))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*answers), _RESULT.types)]
                names = [*part.schema.names[:-1], *_RESULT.names]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names)

    return run


def predict(rows: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``rows`` without their last column, the text, and with lang_pred, score and rejected."""
    schema = T.StructType(rows.schema.fields[:-1])
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(_predicting(dictionaries, min_margin), schema)


def keep_identified(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    rows = docs.select(whole_row(docs).alias(ROW), named(docs, "text").alias("text"))
    found = predict(rows, fit(training_rows(docs)), min_margin)
    return unpacked(found.where(~F.col("rejected")), docs.columns)


def training_rows(docs: DataFrame) -> DataFrame:
    """The labelled rows that may be learned from: all folds but the held-out one."""
    doc_id, text, lang = (named(docs, c) for c in ("doc_id", "text", "lang"))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), lang.alias("lang"))
    return rows.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))


def identify(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row; a null ``doc_id`` is held out."""
    dictionaries = fit(training_rows(docs))
    doc_id = named(docs, "doc_id")
    out = F.coalesce(held_out(doc_id), F.lit(True))
    rows = docs.select(doc_id.alias("doc_id"), out.alias("held_out"), named(docs, "text").alias("text"))
    return predict(rows, dictionaries, min_margin)

"""Token counts of a unigram tokenizer without its tokens: best score and piece count only.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a position; the
dynamic program keeps, for each position, the best score and the number of pieces that gave
it. Ties go the tokenizer's way: a later candidate must be strictly better, and candidates
come by ascending start, so of equal scores the longest piece stays. A character that is no
piece costs the least score minus ``UNKNOWN_PENALTY``; it counts as its bytes where the
vocabulary has byte pieces, else a run of such characters is one.

Scores are whole numbers in the files used here, and sums of them are exact in a double, so
a text may be cut before each space mark without changing a comparison. That holds when no
piece has a space mark after another character; ``Vocabulary`` checks it. Each distinct word
is then solved once per worker and its two numbers are added up.

Null and empty texts have no tokens and score 0. Repeated rows are counted alike. Other
columns are not read.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from threatloom.llm.common import named
from threatloom.llm.shingles import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose result a worker keeps, beyond it starts anew; longer words are not kept.
CACHE_WORDS, CACHED_CHARS = 1_000_000, 64
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Vocabulary:
    """Pieces with scores of a model file, the automaton over them, and solved words."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool, dummy_prefix: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces, self.dummy_prefix = byte_pieces, dummy_prefix
        exact = all(float(score).is_integer() for _, score in pieces)
        self.cuttable = exact and byte_pieces and all(
            MARK not in piece.lstrip(MARK) for piece, _ in pieces
        )
        self.known: dict[str, tuple[int, float]] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The ordinary pieces of a SentencePiece model, with the scores in the file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ordinary = [
            (model.id_to_piece(i), float(model.get_score(i)))
            for i in range(size)
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
        ]
        return cls(ordinary, any(model.is_byte(i) for i in range(size)))

    def solve(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path through a text with its space marks.

        A piece reaches back no further than the longest one, so as many states are kept.
        """
        span = self.longest + 1
        score, count = [0.0] * span, [0] * span
        unknown_run = [False] * span  # the best path ends here with an unknown character
        found = self.automaton.iter(text)
        last, piece = next(found, (-1, None))
        for end in range(1, len(text) + 1):
            ending = []
            while piece is not None and last + 1 == end:
                ending.append(piece)
                last, piece = next(found, (-1, None))
            best, pieces, unknown = None, 0, False
            single = False
            for length, own in sorted(ending, reverse=True):  # by ascending start
                candidate = score[(end - length) % span] + own
                single = single or length == 1
                if best is None or candidate > best:
                    best, pieces = candidate, count[(end - length) % span] + 1
            if not single:
                before = (end - 1) % span
                candidate = score[before] + self.unknown
                if best is None or candidate > best:
                    best, unknown = candidate, True
                    if self.byte_pieces:
                        pieces = count[before] + len(text[end - 1].encode("utf-8", "replace"))
                    else:
                        pieces = count[before] + (not unknown_run[before])
            score[end % span], count[end % span], unknown_run[end % span] = best, pieces, unknown
        return count[len(text) % span], score[len(text) % span]

    def word(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            found = self.solve(word)
            if len(word) <= CACHED_CHARS:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[word] = found
        return found

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a whole text, word by word where it may be cut: no piece joins a
        character to a mark after it, so a text may be cut before every run of marks."""
        if not text:
            return 0, 0.0
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if not self.cuttable:
            return self.solve(marked)
        pieces, score = 0, 0.0
        for word in _WORD.finditer(marked):
            n, own = self.word(word[0])
            pieces, score = pieces + n, score + own
        return pieces, score


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def counts(vocab: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and scores of the texts; distinct words are solved once where texts may be cut."""
    texts = pc.fill_null(texts, "")
    if not vocab.cuttable or not vocab.dummy_prefix:
        found = [vocab.count(text) for text in texts.to_pylist()]
        return np.array([n for n, _ in found], dtype=np.int64), np.array([s for _, s in found], dtype=float)
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    # A run of marks belongs together. Marks in the text itself are spaces to the model, and texts
    # with such or doubled spaces are cut one by one.
    odd = pc.match_substring_regex(texts, f"^ |  | $|{MARK}")
    lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    solved = [vocab.word(MARK + word) for word in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy()
    totals = []
    for k, kind in enumerate((np.int64, float)):
        values = np.array([s[k] for s in solved], dtype=kind)
        upto = np.concatenate([[0], np.cumsum(values[codes])]) if len(solved) else np.zeros(1, kind)
        totals.append(np.diff(upto[offsets]))
    n, score = totals
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    n[empty], score[empty] = 0, 0.0
    for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        n[i], score[i] = vocab.count(texts[i].as_py())
    return n, score


def _counting(path: str):
    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, 1):
                n, score = counts(vocab, part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(score)], ["doc_id", "n_tokens", "score"]
                )

    return run


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and score of the best segmentation of each whole text."""
    rows = docs.select(named(docs, "doc_id").cast("bigint").alias("doc_id"), named(docs, "text").alias("text"))
    return rows.mapInArrow(_counting(model_path), "doc_id bigint, n_tokens bigint, score double")

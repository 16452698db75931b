"""Token-id files against the tokenizer on whole texts, and the perfect hash by itself."""

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatloom.llm import queries, token_files
from threatloom.llm.perfect_hash import PerfectHash, digest_words, fingerprints

PATH = queries.tokenizer_file("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, shard string, first int, number string, ids string"
HOSTILE = [
    (None, "no id"), (None, "no id"), (7, None), (-3, ""), (4, "  \n\t "), (4, "Twice"), (4, "twice  again"), (2**62, "é" * 900),
    (11, "It's <|endoftext|>DON'T é ́x Ⅷ½ 日本語 İSTANBUL ΣΑΣ \x1c\x85"), (12, "<|startoftext|>"), (5, "word " * 40_000),
]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOCS)


def whole(rows):
    """The rows that reading all ids back should give, as (doc_id, n, ids), and the ids of each."""
    found = [(i, tokenizer().encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    return sorted((i is not None, i or 0, len(ids), tuple(ids)) for i, ids in found)


def check_all(got, rows):
    own = sorted(
        (r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got
    )
    assert own == whole(rows)
    at = 0
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == at and len(row["ids"]) == 4 * row["n_tokens"]
        at += row["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys)


def test_files_hold_every_document_in_order(spark):
    docs = frame(spark, HOSTILE)
    files = token_files.write(docs, PATH)
    check_all(token_files.read(files, docs).collect(), HOSTILE)


def test_a_frequent_id_spans_shards(spark):
    rows = [(3, "alpha beta")] * 500 + [(i, f"number {i}") for i in range(300)]
    docs = frame(spark, rows).repartition(6)
    files = token_files.write(docs, PATH, shard_ids=40)
    runs = token_files.find(files, docs.where("doc_id = 3")).collect()
    assert len(runs) > 10 and sum(r["docs"] for r in runs) == 501
    check_all(token_files.read(files, docs).collect(), rows)


def test_look_ups_find_what_is_there_and_nothing_else(spark):
    rows = [(i, f"text {i}") for i in range(0, 3000, 3)]
    files = token_files.write(frame(spark, rows), PATH)
    asked = spark.range(3100).select(F.col("id").alias("doc_id"))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read(files, asked.union(asked)).collect()}
    assert sorted(got) == [i for i, _ in rows]
    assert all(got[i] == tokenizer().encode(t, add_special_tokens=False).ids + [1] for i, t in rows[::50])
    assert token_files.read(files, asked.where("doc_id < 0")).count() == 0


def test_an_empty_table(spark):
    docs = frame(spark, [])
    assert token_files.read(token_files.write(docs, PATH), docs).collect() == []


def test_the_query_over_the_documents(spark):
    import zlib

    folder = "/root/testdata/sf0.001"
    got = queries.op12_token_files(spark, folder).orderBy("doc_id").collect()
    at = 0
    for row, (i, text) in zip(got, sorted(queries.table(spark, folder, "documents").select("doc_id", "text").collect())):
        ids = np.array(tokenizer().encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert tuple(row) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ'stS  \t\n<|>́é  \x0b\x1c9½日İΣendoftx", max_size=30), max_size=4))
def test_ids_by_word_equal_the_ids_of_whole_texts(texts):
    ids, counts = token_files.token_ids(PATH, pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts):
        assert ids[end - n : end].tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_a_tokenizer_that_looks_across_spaces_gets_whole_texts():
    path = queries.tokenizer_file("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    texts = ["a  b <|endoftext|> c", None, "", " x"]
    ids, counts = token_files.token_ids(path, pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids]
    assert counts.sum() == len(ids)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_the_hash_is_minimal_and_perfect(n):
    words = digest_words([hashlib.md5(str(i).encode()).digest() for i in range(2 * n)])
    a, b = (w[:n] for w in words)
    built, end = PerfectHash.from_bytes(PerfectHash.build(a, b).to_bytes() + b"more")
    assert sorted(built.slots(a, b).tolist()) == list(range(n)) and built.keys == n
    if n:
        slots = built.slots(*words)
        stored = np.empty(n, "<u4")
        stored[slots[:n]] = fingerprints(a, b)
        strange = slots[n:]
        hit = strange >= 0
        assert not (stored[strange[hit]] == fingerprints(*(w[n:][hit] for w in words))).any()
        assert len(built.to_bytes()) < 100 + n  # bits, not keys


def test_equal_digests_are_refused():
    one = np.array([5, 5], dtype=np.uint64)
    with pytest.raises(ValueError):
        PerfectHash.build(one, one)

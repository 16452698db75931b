"""Fill-in-the-middle against slicing in Python."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatloom.llm import infill

DOCS = "doc_id bigint, text string, n string, form int, output string, first string"
TEXTS = [None, "", "a", "é", "ab<P>c", "x <S> y", "<M>", "<", "<P", "a<S" * 5, "plain words " * 9, "日本語" * 50 + "abc" * 300, "é" * 3000 + "z" * 3000,
         "😀a" * 700, "same", "same"]


def expected(i, text, cut=90, suffix_first=20, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    x, y = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= cut:
        return len(text), "plain", None, None, text
    if d % 100 < suffix_first:
        return len(text), "spm", x, y - x, f"<S>{text[y:]}<P>{text[:x]}<M>{text[x:y]}"
    return len(text), "psm", x, y - x, f"<P>{text[:x]}<S>{text[y:]}<M>{text[x:y]}"


def cut(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOCS)
    got = infill.infilled(docs, **options)
    return got.withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()


def test_outputs_and_restored_texts(spark):
    rows = [(17 * k + j, t) for j in range(17) for k, t in enumerate(TEXTS)] + [(None, "without an id"), (None, None)]
    for options in ({}, {"cut_percent": 100, "suffix_first_percent": 50, "seed": 9, "error": 3}):
        got = cut(spark, rows, **options)
        names = {"cut": options.get("cut_percent", 90), "suffix_first": options.get("suffix_first_percent", 20), "seed": options.get("seed", 1)}
        wanted = sorted(((str(i), *expected(i, t, **names), t or "") for i, t in rows), key=str)
        assert sorted(((str(r[0]), *r[1:6], r["restored"]) for r in got), key=str) == wanted
        assert all((r["segments"] is None) == (r["form"] == "plain") for r in got)
    assert cut(spark, []) == []


def test_a_very_long_text(spark):
    text = ("ä" * 50 + " words and more words " * 40) * 5000
    (row,) = cut(spark, [(0, text)], cut_percent=100)
    assert tuple(row[1:6]) == expected(0, text, cut=100) and row["restored"] == text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=3000), st.sampled_from([0, 1, 5, 127]))
def test_every_boundary_is_exact(text, error):
    offsets = infill.boundaries(text.encode())
    index = infill.RankIndex.fit(offsets, error)
    assert [index.offset(r) for r in range(len(offsets))] == offsets.tolist()
    assert all(r is None or np.abs(r).max() <= error for r in index.residuals)


@pytest.mark.parametrize("text, most", [("a" * 100_000, 1), ("é" * 100_000, 1), ("aé" * 50_000, 1), ("a" * 5000 + "日" * 5000, 4)])
def test_regular_texts_need_few_segments(text, most):
    assert len(infill.RankIndex.fit(infill.boundaries(text.encode())).first) <= most

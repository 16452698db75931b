"""The corpus operators against brute force on small, hostile fixtures."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threatloom.llm import chat, language, merkle, mixing, near, packing, quality, queries, sharding, viterbi, warc
from threatloom.llm.hilbert import hilbert_index

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size int, kept string"


def docs(spark, texts, ids=None):
    """Documents with clashing extra columns; texts may be null or repeated."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", f"s{k % 2}" if k % 3 else None, len(t or ""), "x", 7, "y") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def documents(folder=SF):
    return duckdb.sql(f"select doc_id, text, lang, source from '{folder}/documents.parquet' order by doc_id").fetchall()


HOSTILE = [None, "", "  \n ", "one", "A  b\tc", "x <|endoftext|> </s>\\[INST]", "é" * 300, "word " * 3000, "same text here", "same text here"]


def test_packing_places_every_id_once(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs(spark, HOSTILE), path, 64).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(HOSTILE)}
    got = {i: {} for i in ids}
    sequences = {}
    for p in pieces:
        part = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(part) == p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert part == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        got[p["doc_id"]][p["start"]] = p["length"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, spans in got.items():
        at = 0
        for start in sorted(spans):
            assert start == at
            at += spans[start]
        assert at == len(ids[i])
    for number, spans in sequences.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 64 or number == max(sequences)


def test_packing_of_no_rows(spark):
    assert packing.pack(docs(spark, HOSTILE).limit(0), queries.tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_token_ids_equal_the_tokenizers(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    texts = [text for _, text, _, _ in documents()] + HOSTILE + ["a  b\t c\n d  ", "it's 😀 　x"]
    ids, counts = packing.token_ids(path, pa.array(texts))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts):
        assert ids[end - n : end].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_hilbert_curve_visits_neighbours():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(hilbert_index(points, 3))
    assert sorted(hilbert_index(points, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_language_of_held_out_rows(spark):
    found = queries.op2_language(spark, "/root/testdata/sf0.01").collect()
    truth = {i: (lang, text) for i, text, lang, _ in documents("/root/testdata/sf0.01")}
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(found) == len(truth) and all(r["held_out"] for r in held)
    assert sum(r["held_out"] for r in found) == len(held)
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(spark):
    rows = docs(spark, [*HOSTILE, "123 456 !!"])
    found = {r["doc_id"]: r for r in language.identify(rows).collect()}
    assert {i for i, r in found.items() if r["lang_pred"] == "und"} == {0, 1, 2, 10}
    kept = language.keep_identified(rows)
    assert kept.columns == rows.columns
    assert language.identify(rows.limit(0)).count() == 0


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


CONVERSATIONS = [
    (1, 0, "system", "Be <|end|>\nkind\\"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "a\\<|turn|>b"),
    *[(2, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 37)) for i in range(300)],
    (3, 0, "assistant", None), (3, 1, None, "no role"), (3, None, "odd\nrole\\", ""), (4, 0, "assistant", "long " * 5000),
    (4, 1, "assistant", "x"), (4, 1, "assistant", "x"), (None, 0, "user", "nobody"),
]


def test_chat_reads_back(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    made = chat.windows(turns_of(spark, CONVERSATIONS), path, 256, 64, 64).cache()
    found = {r["conv_id"]: r for r in chat.digests(made).collect()}
    expected = {}
    for conv, turn, role, text in sorted(CONVERSATIONS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        expected.setdefault(conv, []).append((role or "", text or ""))
    assert found.keys() == expected.keys()
    for conv, said in expected.items():
        loss = "".join(text for role, text in said if role == "assistant")
        row = found[conv]
        assert row["n_turns"] == len(said)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert row["loss_chars"] == len(loss)
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    rows = made.collect()
    assert sum(len(r["text"]) for r in rows if r["conv_id"] == 2) == found[2]["formatted_chars"]
    for r in rows:
        turns = chat.read_turns(r["text"])
        assert r["tokens"] <= 256 or len(turns) == 1 + r["repeated"] == 1
    later = [r for r in rows if r["conv_id"] == 2 and r["cell"] > 0]
    assert any(r["repeated"] for r in later)


def test_chat_of_no_rows(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    assert chat.digests(chat.windows(turns_of(spark, []), path)).count() == 0


def water_levels(sizes, weights):
    """Targets by repeated resharing of the excess."""
    caps, target, left, open_ = {s: 3 * n for s, n in sizes.items()}, dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        share = {s: target[s] + left * weights[s] / total for s in open_}
        over = {s for s in open_ if share[s] > caps[s]}
        left = sum(share[s] - caps[s] for s in over)
        for s in open_:
            target[s] = min(share[s], caps[s])
        open_ -= over
    return target


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 9), source) for i, source in enumerate(["a"] * 300 + ["b"] * 4 + [None] * 3 + ["é"] * 40)]
    rows += [(900, None, "b"), (900, None, "b"), (None, "x y", "empty"), (901, "", "void")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    found = mixing.mixed_sizes(frame).collect()
    again = mixing.mixed_sizes(frame.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    targets = water_levels(sizes, {s: 1 + k % 3 for k, s in enumerate(names)})
    source_of = {(i, len(WORD.findall(t or ""))): s for i, t, s in rows}
    taken = Counter()
    for r in found:
        source = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], targets[source], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    mix = mixing.mix(frame)
    assert mix.columns == frame.columns
    assert sum(len(WORD.findall(r["text"])) for r in mix.collect()) == sum(taken.values())
    assert mixing.mixed_sizes(frame.limit(0)).count() == 0


def brute_components(texts, size, percent=80):
    def shingles(text):
        words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        return grams or ({tuple(words)} if words else set())

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and common:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("star_rounds", [0, 2])
def test_near_duplicates_equal_brute_force(spark, star_rounds):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = list(HOSTILE)
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(2, 120))))
        for _ in range(9):
            copy = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 1 + len(base) // 8))):
                copy[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    frame = docs(spark, texts)
    sizes, roots = brute_components(texts, 2)
    found = {r["doc_id"]: r for r in near.near_duplicates(frame, 2, star_rounds=star_rounds).collect()}
    assert [found[i]["component_id"] for i in range(len(texts))] == roots
    assert [found[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(found[i]["kept"] == (roots[i] == i) for i in range(len(texts)))


def test_near_duplicates_keep_one(spark):
    frame = docs(spark, ["a b c d e f", "a b c d e f", None, "z", "z", "q"], [4, 2, 3, None, None, 9])
    frame = frame.union(frame.where("doc_id = 9"))
    kept = near.keep_one_each(frame, near.near_duplicates(frame))
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 2, 3, 9]
    assert near.near_duplicates(frame.limit(0)).count() == 0


def test_sketch_agreement_is_the_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = a.copy()
    b[:500] = rng.integers(0, 2**63, 500)
    table = near.sketches(np.concatenate([a, b]), np.repeat([0, 1], 2000), 2, 1000)
    assert abs((table[0] == table[1]).mean() - 1500 / 2500) < 0.08
    small = near.sketches(np.array([7], np.uint64), np.array([0]), 2, 100)
    assert (small[0] < np.iinfo(np.uint64).max).all() and (small[1] == np.iinfo(np.uint64).max).all()


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked),
    )


def test_quality_equals_brute_force(spark):
    texts = HOSTILE + [t for _, t, _, _ in documents()] + ["a b c d e f a b c d e f g a b c d e", "l\nl \nl\n\n\nl", "#*$%&|<> é"]
    frame = docs(spark, texts)
    found = {r["doc_id"]: r for r in quality.judge(frame, [frame["doc_id"]]).collect()}
    for i, text in enumerate(texts):
        row, expected = found[i], brute_quality(text)
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert row["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (row["kept"] and row["base_failed"])
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in found if found[i]["kept"]}


def test_fingerprints_equal_brute_force(spark):
    texts = [*HOSTILE, *[t for _, t, _, _ in documents()][:60], "a\n\nb\n", "last"]
    found = {r["doc_id"]: r for r in merkle.fingerprints(docs(spark, texts)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        own, following = text or "", texts[(i + 1) % len(texts)] or ""
        k = len(own) // 4
        changed = own[: len(own) - k] + following[:k]
        row = found[i]
        assert row["n_chars"] == len(own)
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (row["fingerprint"] == row["edited_fingerprint"]) == (own == changed)
        assert 0 <= row["near_next"] <= 1 and (row["near_edited"] == 1.0) >= (own == changed)
        assert row["fingerprint"] == merkle.Tree(own).fingerprint()
    assert found[8]["fingerprint"] == found[9]["fingerprint"]
    single = merkle.fingerprints(docs(spark, ["abcd efgh"])).collect()
    assert single[0]["near_next"] == 1.0 and merkle.fingerprints(docs(spark, HOSTILE).limit(0)).count() == 0


def test_merkle_leaves_and_edits():
    for text in ["", "\n", "a", "a\n", "\n\na", "x" * 1000 + "\ny", *[t for _, t, _, _ in documents()][:50]]:
        assert "".join(merkle.leaves(text)) == text
    old = "\n".join(f"line {i}" for i in range(200))
    new = old.replace("line 77\n", "line seventy-seven\n")
    at = new.index("line seventy-seven")
    assert merkle.edits(old, old) == []
    (start, end), = merkle.edits(old, new)
    assert start <= at and end >= at + len("line seventy-seven") and end - start < 40


def test_sharding_levels_bytes(spark):
    found = queries.op8_sharding(spark, "/root/testdata/sf0.01").collect()
    truth = {i: text for i, text, _, _ in documents("/root/testdata/sf0.01")}
    loads, places = Counter(), {}
    for r in found:
        assert r["size"] == len(truth[r["doc_id"]].encode()) + 1
        assert r["text_crc32"] == zlib.crc32(truth[r["doc_id"]].encode())
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert set(loads) == set(range(16)) and len(found) == len(truth)
    assert max(loads.values()) - min(loads.values()) < 0.01 * max(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_sharding_edges_and_rebalance(spark):
    frame = spark.createDataFrame([(1, 5), (1, 5), (None, 1), (2, 0)], "doc_id bigint, size bigint")
    assert sharding.sharded(frame, 4).count() == 4 and sharding.sharded(frame.limit(0), 4).count() == 0
    rng = np.random.default_rng(2)
    loads = {s: (int(n), 1) for s, n in enumerate(rng.integers(1, 1000, 4096))}
    first = sharding.first_map(loads, 16)
    grown = sharding.rebalanced(first, loads, 17)
    totals = Counter()
    for slot, shard in grown.items():
        totals[shard] += loads[slot][0]
    assert max(totals.values()) - min(totals.values()) <= 1000
    assert sum(first[s] != grown[s] for s in first) < 2 * 4096 / 17 + 64
    assert set(sharding.rebalanced(grown, loads, 16).values()) == set(range(16))


def test_warc_round_trip(spark):
    body = "<p>" + "é" * 80 + "</p>"
    rows = [(5, "http://a\r\nX: y", body), (3, None, body), (9, "http://c", body), (1, "u", None), (2, "u", "short"), (4, "u", "short"), (None, "v", body), (7, "w", "x\r\n\r\ny" * 50), (7, "w", "x\r\n\r\ny" * 50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    folder = warc.archive_folder(spark)
    index = warc.write_archives(pages, folder)
    found = warc.read_records(index, folder).collect()
    assert sorted((r["page_id"] or -1, r["url"] or "") for r in found) == sorted((p or -1, u or "") for p, u, _ in rows)
    for r in found:
        html = next(h or "" for p, u, h in rows if p == r["page_id"] and u == r["url"])
        payload = html.encode()
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
        assert r["digest_matches"]
        revisit = html == body and r["page_id"] != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        assert revisit or bytes(r["payload"]) == payload
    few = warc.read_records(index.where("page_id in (1, 9)"), folder).collect()
    assert {r["page_id"] for r in few} == {1, 9}
    assert warc.write_archives(pages.limit(0), warc.archive_folder(spark)).count() == 0


def test_joined_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100_000, 5), ("b", 0, 3)]
    assert list(warc.joined_ranges(rows)) == [("a", 0, 15, [0, 1]), ("a", 100_000, 100_005, [2]), ("b", 0, 3, [3])]
    assert gzip.decompress(gzip.compress(warc.record(1, "u", b"p", "d", None))).startswith(b"WARC/1.1\r\n")


def test_viterbi_counts_equal_the_tokenizer(spark):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import models

    path = queries.tokenizer_file("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]
    least = min(s for i, (_, s) in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    pieces = [
        (p, max(s, least) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) else s) for i, (p, s) in enumerate(pieces)
    ]
    reference = models.Unigram(pieces, unk_id=0, byte_fallback=True)
    texts = HOSTILE[:5] + HOSTILE[6:] + [t for _, t, _, _ in documents()] + ["tab\there", "日本 😀  two", " lead", "a▁b"]
    found = viterbi.token_counts(docs(spark, texts), path).collect()
    got = {r["doc_id"]: r["n_tokens"] for r in found}
    for i, text in enumerate(texts):
        expected = len(reference.tokenize("▁" + text.replace(" ", "▁"))) if text else 0
        assert got[i] == expected, text
    assert viterbi.token_counts(docs(spark, texts).limit(0), path).count() == 0


def test_viterbi_ties_and_unknown_runs():
    from tokenizers import models

    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bb", -1.5)]
    reference = models.Unigram(pieces, unk_id=0, byte_fallback=False)
    ours = viterbi.Vocabulary(pieces[1:], byte_pieces=False, dummy_prefix=False)
    ours.unknown = min(s for _, s in pieces) - viterbi.UNKNOWN_PENALTY
    for text in ["abab", "abba", "aaaa", "xxab", "abxxyba", "bbbb", "x", "babab"]:
        assert ours.count(text)[0] == len(reference.tokenize(text)), text


def test_pipeline(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = frame.columns, frame.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == columns, name
        frame = frame.cache()
        if name != "mixing":
            assert 0 < frame.count() <= before
            before = frame.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    tokens = sum(r["length"] for r in pieces.collect())
    assert tokens > 0 and pieces.select("sequence_id").distinct().count() == -(-tokens // 1024)

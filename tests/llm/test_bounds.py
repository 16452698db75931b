"""Budgets, contracts and memory of the corpus operators on texts made to break them."""

import resource

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatloom.llm import chat, common, language, mixing, near, packing, quality, queries, sharding, viterbi
from threatloom.llm.components import components

BYTE = queries.tokenizer_file("byte_bpe_50k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def grown_mb(work):
    """Peak memory that some work adds, in MB."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    work()
    return (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024


# --- packing

TOKENIZER = tokenizer()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB'st  \t\n\x0b\x1c\x85　é9,.<|endoftext|>😀", max_size=40))
def test_ids_of_any_white_space_and_control_strings(text):
    ids, counts = packing.token_ids(BYTE, pa.array([text, "x <|endoftext|> y", text + "  "]))
    expected = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in (text, "x <|endoftext|> y", text + "  ")]
    assert ids.tolist() == [i for own in expected for i in own] and counts.tolist() == [len(own) for own in expected]
    assert expected[1] == [87, 220, 50256, 331]


def test_a_long_text_with_doubled_spaces_is_encoded_in_bounded_memory():
    text = "  ".join(f"word{i % 5000} and" for i in range(1_200_000))
    packing.token_ids(BYTE, pa.array([text[:1000]]))
    assert len(text) > 15_000_000
    assert grown_mb(lambda: packing.token_ids(BYTE, pa.array([text]))) < 400


# --- language

def test_a_letter_is_a_letter_for_fitting_and_predicting(spark):
    rows = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "½ ² Ⅷ", "en"), (4, "½ ² Ⅷ", None), (5, "हिन्दी", None), (6, "ॐ", None), (7, "́", None)],
        "doc_id bigint, text string, lang string",
    )
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(rows).collect()}
    assert {i for i, lang in found.items() if lang == "und"} == {3, 4, 7}


def test_predictions_equal_sizes_computed_one_by_one(spark):
    rng = np.random.default_rng(8)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(60)] for lang, letters in (("aa", "abcdefg"), ("bb", "defghij"), ("cc", "klmnop"))}
    rows = [(i, " ".join(rng.choice(words[lang], 80)), lang) for i in range(90) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(900, "zzz " * 2000, None), (901, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    dictionaries = language.fit(language.training_rows(docs), sample_rows=7, dictionary_bytes=1500)
    assert list(dictionaries) == ["aa", "bb", "cc"] and all(1400 < len(d) <= 1500 for d in dictionaries.values())
    settings_ = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=3, min_match=4, target_length=16,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    got = {r["doc_id"]: r for r in language.predict(docs.select("doc_id", "text"), dictionaries).collect()}
    for i, text, _ in rows:
        content, totals = text.lower().strip().encode(), {}
        for lang, raw in dictionaries.items():
            raw = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            totals[lang] = sum(
                len(zstandard.ZstdCompressor(dict_data=raw, compression_params=settings_).compress(content[k : k + 2048]))
                for k in range(0, len(content), 2048)
            )
        best, second = sorted(totals, key=lambda lang: (totals[lang], lang))[:2]
        assert got[i]["lang_pred"] == best
        assert got[i]["rejected"] == ((totals[second] - totals[best]) / totals[second] < language.MIN_MARGIN)
    assert language.decide(["x", "y", "z"], [9, 7, 7], 0.001) == ("y", 0.5, True)


def test_every_language_is_learned_and_dictionaries_share_their_bound(spark):
    rows = [(i, f"text of language {i} " + "abc " * 50, f"l{i:04d}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language.fit(docs, all_bytes=40_000)
    assert len(learned) == 400 and sum(map(len, learned.values())) <= 40_000


def test_a_dictionary_takes_whole_texts_until_it_is_full(spark):
    rows = [(1, "a " * 5_000 + "tail", "x")] * 3 + [(2, "b " * 200_000, "y")]
    learned = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert learned["x"].endswith(b"tail") and learned["x"].count(b"tail") == 1 and len(learned["y"]) == language.DICTIONARY_BYTES


# --- chat

def test_windows_keep_their_budget_as_the_tokenizer_counts_it(spark):
    rng = np.random.default_rng(9)
    rows = [(1, i, "user" if i % 2 else "assistant", "ok " * int(rng.integers(0, 4))) for i in range(400)]
    rows += [(2, 0, "system", "rule " * 300), *[(2, i, "user", "word " * int(rng.integers(0, 700))) for i in range(1, 40)]]
    rows += [(3, i, "a very long role " * 20, "text") for i in range(30)]
    rows += [(4, 0, "system", "s " * 900), (4, 1, "user", "u " * 500), (4, 2, "assistant", "a " * 5000), (4, 3, "user", "<|end|>\n<|turn|>" * 40)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.windows(turns, BYTE).collect()
    plain = tokenizer()
    plain.encode_special_tokens = True
    for r in made:
        tokens = len(plain.encode(r["text"], add_special_tokens=False).ids)
        assert r["tokens"] == tokens
        said = chat.read_turns(r["text"])
        assert tokens <= chat.BUDGET or (len(said) == 1 and r["repeated"] == 0)
        if r["conv_id"] == 2 and r["cell"] > 0 and tokens < 700:
            assert said[0][0] == "system"
    short = [r for r in made if r["conv_id"] == 1 and r["cell"] > 0]
    assert all(r["repeated"] for r in short) and min(r["tokens"] for r in short[:-1] if not r["crossing"]) > 512


# --- mixing

def test_positions_invert_the_integral_of_the_schedules(spark):
    shares = np.linspace(0, 1, 101)
    frame = spark.createDataFrame([(float(x), p) for x in shares for p in range(4)], "share double, place bigint")
    found = frame.select("share", "place", mixing.training_time(F.col("share"), F.col("place")).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    for place in range(4):
        rates = np.interp(grid, [0, 0.5, 1], mixing.SCHEDULES[place % 3])
        total = np.concatenate([[0], np.cumsum((rates[1:] + rates[:-1]) / 2 * np.diff(grid))])
        for r in found:
            if r["place"] == place:
                assert abs(np.interp(r["t"], grid, total) / total[-1] - r["share"]) < 1e-6


def test_documents_come_in_the_order_of_their_positions(spark):
    rows = [(i if i % 3 else None, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = [r["first_position"] for r in mixing.mixed_sizes(docs).collect()]
    taken = [p for p in found if p is not None]
    assert taken == sorted(taken) and all(p is None for p in found[len(taken) :]) and len(found) == 400
    planned = mixing.plan(docs, []).collect()
    words, wanted = {"a": 0, "b": 0}, {r["source"]: round(r["target"]) for r in planned}
    for r in sorted(planned, key=lambda r: (r["source"], r["upto"])):
        place = "ab".index(r["source"])
        share = (words[r["source"]] + r["size"] / 2) / wanted[r["source"]]
        words[r["source"]] += r["size"]
        if r["copies"]:
            own = spark.range(1).select(mixing.training_time(F.lit(share), F.lit(place))).first()[0] if r["upto"] < 40 else None
            assert own is None or abs(own - r["copies"][0]["position"]) < 1e-9
    assert words == {s: sum(len(t.split()) for _, t, o in rows if o == s) for s in "ab"}


# --- quality

def test_the_stop_word_ratio_is_taken_per_language(spark):
    plain = " ".join(f"noun{i}" for i in range(60))
    rows = [
        (1, plain + " the a of in is", "en"), (2, plain + " the", "en"), (3, plain, "ru"), (4, plain, None),
        (5, plain + " der die das und von", "de"), (6, plain + " der die das und von", "fr"), (7, "the " * 3 + plain[:20], "en"),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, letters string, stop_words int")
    found = {r["doc_id"]: r for r in quality.judge(docs, [docs["doc_id"]]).collect()}
    assert {i: r["failed_rules"] for i, r in found.items() if not r["kept"]} == {2: ["stop_words"], 6: ["stop_words"], 7: ["long_enough"]}
    assert found[1]["stop_word_ratio"] == 5 / 65 and found[3]["stop_word_ratio"] is None
    assert quality.judge(docs.drop("lang"), [docs["doc_id"]]).where("kept").count() == 6
    assert quality.judge(docs.limit(0), [docs["doc_id"]]).count() == quality.keep_good(docs.limit(0)).count() == 0


# --- sharding

def test_records_may_have_any_columns(spark):
    records = spark.createDataFrame(
        [(1, 5, "a", 9, "x", 1), (1, 5, "a", 9, "x", 1), (None, 1, "b", 9, None, 2), (None, None, "c", 8, None, 3)],
        "doc_id bigint, size bigint, begin string, shard int, `row` string, `a.b` int",
    )
    found = sharding.sharded(records, 4)
    assert found.columns == ["doc_id", "size", "begin", "row", "a.b", "shard", "slot", "vslot", "map_version"]
    assert sorted(str(tuple(r)[:3]) for r in found.collect()) == sorted(str(tuple(r)[:3]) for r in records.collect())


def test_rows_without_an_id_are_spread(spark):
    records = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), (F.col("id") % 100 + 1).alias("size"), F.col("id").alias("n"))
    loads = sharding.sharded(records).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(loads) == 16 and max(r["s"] for r in loads) < 1.05 * min(r["s"] for r in loads)


def test_records_follow_the_versions_of_the_map(spark, tmp_path):
    records = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") * 7 % 1000).alias("size"))
    folder = str(tmp_path / "map")
    first = sharding.sharded(records, folder=folder, grown=17).collect()
    assert {r["map_version"] for r in first} == {1} and {r["next_version"] for r in first} == {2}
    moved = [r for r in first if r["shard"] != r["next_shard"]]
    assert 0 < len(moved) < 2 * 3000 / 17 + 300 and 16 in {r["next_shard"] for r in moved}
    after = {r["doc_id"]: r for r in sharding.sharded(records, folder=folder).collect()}
    assert {r["map_version"] for r in after.values()} == {2}
    assert all(after[r["doc_id"]]["shard"] == r["next_shard"] and after[r["doc_id"]]["vslot"] == r["vslot"] for r in first)
    sizes = {}
    for r in after.values():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(sizes) == 17 and max(sizes.values()) - min(sizes.values()) < 0.05 * max(sizes.values())


# --- token counts

def test_a_long_text_is_counted_in_bounded_memory():
    vocabulary = viterbi.vocabulary(queries.tokenizer_file("piece_bpe_32k.model"))
    text = "ab cd  " * 300_000
    vocabulary.count(text[:100])
    found = {}
    assert grown_mb(lambda: found.update(n=vocabulary.count(text)[0])) < 150
    assert found["n"] == 300_000 * vocabulary.count("ab cd  ")[0] or found["n"] > 600_000
    unbroken = "abcdefgh" * 100_000
    assert grown_mb(lambda: found.update(u=vocabulary.count(unbroken)[0])) < 50


def test_bounded_states_give_what_all_states_give():
    from tokenizers import models

    pieces = [("<unk>", 0.0), ("▁", -3.0), ("▁▁", -4.0), ("a", -1.0), ("aab", -2.0), ("▁ab", -2.5), ("b", -1.5)]
    reference = models.Unigram(pieces, unk_id=0, byte_fallback=False)
    ours = viterbi.Vocabulary(pieces[1:], byte_pieces=False, dummy_prefix=False)
    ours.unknown = min(s for _, s in pieces) - viterbi.UNKNOWN_PENALTY
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = "".join(rng.choice(list("ab x"), int(rng.integers(0, 30))))
        assert ours.count(text)[0] == len(reference.tokenize(text.replace(" ", "▁")) if text else []), text


# --- near duplicates

def test_short_texts_half_alike_stay_linear(spark):
    """30,000 texts that share a band with most others and are linked with none but a few."""
    base = spark.range(30_000)
    text = F.concat(F.lit("dear "), F.md5(F.col("id").cast("string")), F.lit(" your order number "), F.col("id").cast("string"),
                    F.lit(" has been sent today and will arrive soon thank you"))
    docs = base.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 1, F.lit(None)).otherwise(text).alias("text"))
    found = near.near_duplicates(docs, shingle_words=2)
    assert found.where("kept").count() == 30_000



@pytest.mark.parametrize("group_sets", [0, 3, 64])
def test_remaining_links_equal_all_pairs(spark, monkeypatch, group_sets):
    monkeypatch.setattr(near, "GROUP_SETS", group_sets)
    monkeypatch.setattr(near, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(12)
    sets = {}
    for i in range(160):
        core = rng.choice(60, int(rng.integers(1, 25)), replace=False) + 100 * (i % 4)
        sets[i] = sorted(set(core.tolist()))
        if i % 5 == 0 and i:
            sets[i] = sorted({*sets[i - 1], *rng.choice(1000, 1).tolist()})
    frame = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in sets.items()], "set_id bigint, elements array<bigint>")
    buckets = frame.select(F.lit(1).cast("bigint").alias("key"), "set_id", F.col("set_id").alias("component"))
    for percent in (50, 80, 100):
        got = {tuple(r) for r in near._remaining_links(buckets, frame, percent).collect()}
        wanted = {
            (a, b) for a in sets for b in sets
            if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})
        }
        assert got == wanted


# --- heavy keys

@pytest.mark.parametrize("heavy", [1, 4, 10_000])
def test_heavy_values_meet_their_row_whatever_is_heavy(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    keys = [1] * 300 + [2] * 40 + [None] * 5 + list(range(3, 60))
    for kind, made in (("bigint", lambda k: k), ("string", lambda k: None if k is None else f"k{k}")):
        rows = spark.createDataFrame([(made(k), i) for i, k in enumerate(keys)], f"key {kind}, id bigint")
        values = rows.where("key is not null and id % 7 < 6").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"))
        plain = rows.join(values, "key", "left").select("key", "id", "n", "low")
        got = common.beside(rows, values, "key", "n", len(keys), "id").select("key", "id", "n", "low")
        assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(plain.collect(), key=lambda r: r["id"])
        assert common.beside(rows.limit(0), values.limit(0), "key", "n", 0, "id").count() == 0


@pytest.mark.parametrize("heavy", [2, 10_000])
def test_components_of_hubs_and_chains(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    links = [(500, i) for i in range(501, 700)] + [(i, i + 1) for i in range(1, 30)] + [(29, 500), (900, 901), (5, 5)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(frame, "a", "b").collect()}
    assert got == {**{i: 1 for i in [*range(1, 31), *range(500, 700)]}, 900: 900, 901: 900}
    assert components(frame.limit(0), "a", "b").count() == 0

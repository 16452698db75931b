"""The operators of this subpackage over the whole test tables, with SQL where it can state them.

SQL cannot state tokenizers, zstandard, Merkle trees over pieces, or the order of Spark's 64-bit
hashes by which mixes and slots are dealt. Those queries are held against brute force, round
trips and held-out accuracy in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import (
    chat, infill, language, merkle, mixing, near, negatives, packing, quality, sharding, token_files, viterbi, warc,
)
from threatloom.llm.common import table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.windows(turns, tokenizer_file("byte_bpe_50k.json")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


#: Words of a text: not parted by the six characters of ``common.SPACES`` but by those alone.
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

NEAR_DUPLICATES = f"""with recursive parted as materialized (
  select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w
  from documents
), sets as materialized (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then w
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
  from parted
), sizes as materialized (
  select doc_id, count(*) as n from sets group by doc_id
), common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id
  group by all
), links as materialized (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * c >= 80 * (p.n + q.n - c)
), reached as (
  select x, y from links union select r.x, l.y from reached r join links l on r.y = l.x
), least as (
  select x, min(y) as y from reached group by x
)
select p.doc_id, coalesce(n, 0) as n_shingles, least(p.doc_id, coalesce(l.y, p.doc_id)) as component_id,
  p.doc_id <= coalesce(l.y, p.doc_id) as kept
from parted p left join sizes s on s.doc_id = p.doc_id left join least l on l.x = p.doc_id"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, [docs["doc_id"]]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOP_WORDS = " ".join(
    f"when '{lang}' then len(list_filter(letters, lambda x: x in ({', '.join(f"'{w}'" for w in own)})))"
    for lang, own in quality.STOP_WORDS.items()
)

QUALITY = f"""with bodies as (
  select doc_id, lang, coalesce(text, '') as body from documents
), parted as materialized (
  select doc_id, lang, body, regexp_split_to_array(lower(body), '[^\\p{{L}}]+') as letters, {_WORDS.format("body")} as w,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from bodies
), places as (
  select doc_id, unnest(range(1, len(w) - 3)) as i, w from parted where len(w) >= 5
), windows as (
  select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i : i + 4], ' ')) as n from places
), covered as (
  select doc_id, count(distinct i + k) as n_repeat_words
  from windows, range(5) as t(k) where n > 1 group by doc_id
), measures as (
  select p.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    case lang {_STOP_WORDS} end as stop_words
  from parted p left join covered c on c.doc_id = p.doc_id
), judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from measures
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words <= 1000000 and word_chars / n_words between 2.0 and 15.0
    and n_symbols / n_words <= 0.3 and (n_words < 50 or coalesce(stop_words / n_words >= 0.05, true))
    and coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.3 as kept
from judged"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(docs["text"], F.lit(""))
    records = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    # Beside the columns asked for: where the map's next version puts each record with one more shard.
    return sharding.sharded(records, grown=sharding.SHARDS + 1).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "map_version", "next_version", "next_shard",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


WARC = """with payloads as (
  select page_id, coalesce(html, '') as payload from pages
), digests as (
  select page_id, octet_length(encode(payload)) as payload_bytes, sha256(payload) as payload_digest from payloads
), firsts as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id
  from digests
)
select page_id, payload_bytes, payload_digest,
  case when first_id = page_id then 'response' else 'revisit' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from firsts"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


HARD_NEGATIVES = """with vectors as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as materialized (
  select a.vec_id as anchor_id, a.label = r.label as same, r.vec_id as id, list_dot_product(a.v, r.v)::bigint as score
  from vectors a join vectors r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, row_number() over w as rank, s.id as negative_id, positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
window w as (partition by p.anchor_id, positive_id order by s.score desc, s.id)
qualify row_number() over w <= 5"""


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = token_files.write(docs, tokenizer_file("word_bpe_49k.json"))
    return token_files.read(files, docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infilled(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


INFILL = """with bodies as (
  select doc_id, coalesce(text, '') as body, length(coalesce(text, '')) as n,
    sha256('1:' || coalesce(doc_id::varchar, '')) as h
  from documents
), draws as (
  select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as b,
    ('0x' || substr(h, 17, 8))::bigint % 100 as c, ('0x' || substr(h, 25, 8))::bigint % 100 as d
  from bodies
), formed as (
  select *, least(a, b) as x, greatest(a, b) as y,
    case when n = 0 or c >= 90 or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') then 'plain'
      when d < 20 then 'spm' else 'psm' end as form
  from draws
), cut as (
  select *, substr(body, 1, x) as prefix, substr(body, x + 1, y - x) as middle, substr(body, y + 1) as suffix
  from formed
)
select doc_id, n, form, case when form <> 'plain' then x end as prefix_chars,
  case when form <> 'plain' then y - x end as middle_chars,
  sha256(case form when 'plain' then body when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(body) as restored_sha256
from cut"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": (op1_packing, None),
    "op2_language": (op2_language, None),
    "op3_chat": (op3_chat, None),
    "op4_mixing": (op4_mixing, None),
    "op5_near_duplicates": (op5_near_duplicates, NEAR_DUPLICATES),
    "op6_quality": (op6_quality, QUALITY),
    "op7_fingerprints": (op7_fingerprints, None),
    "op8_sharding": (op8_sharding, None),
    "op9_warc": (op9_warc, WARC),
    "op10_token_counts": (op10_token_counts, None),
    "op11_hard_negatives": (op11_hard_negatives, HARD_NEGATIVES),
    "op12_token_files": (op12_token_files, None),
    "op13_infill": (op13_infill, INFILL),
    "pipeline": (pipeline, None),
}

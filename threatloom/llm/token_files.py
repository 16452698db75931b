"""Token ids in files, with constant-time access by document key.

Payload: the ids of all documents in ascending ``doc_id`` order, raw little-endian words, in shard
files of about ``SHARD_IDS`` ids. A shard is a header, the end of each document in ids, and the
ids, 16 bits each if all fit, else 32.

Index: keys are dealt by hash to index files. Each holds a minimal perfect hash function of its
keys (see ``perfect_hash``) and, by slot, the key's fingerprint and its runs: shard, first document
there, number of documents. A look-up hashes the key to a file, a slot and a fingerprint, and reads
one place of a shard. Only a ``doc_id`` that occurs in several shards has more than one run.

A task writes files under names of its own; the stored table of runs names those that count, so
files of a lost attempt are never read. Each task writes a range of ids; where one ``doc_id`` holds
several cuts of the ranges, its documents are dealt to all of them by a hash of the row's place, so
an id with a third of all rows is many shards.

Null and empty texts are the end id alone. Rows without a ``doc_id`` come first and share the
key of a missing id. Repeated rows are documents each; an id that is asked for repeatedly is
answered once for each of its documents, and one that is not in the files by nothing. An empty
table gives files for no key. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string
import uuid
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import named, stored
from threatloom.llm.packing import byte_letters, narrow, widened
from threatloom.llm.perfect_hash import PerfectHash, digest_words, fingerprints
from threatloom.llm.shingles import parted, slices
from threatloom.session import new_folder

END_ID = 1
#: Ids of a shard before the next one begins.
SHARD_IDS = 16_777_216
#: Keys of an index file, and the least number of such files.
INDEX_KEYS = 500_000
INDEX_FILES = 64
#: Bytes of words whose ids a worker keeps; beyond it starts anew.
CACHE_BYTES = 64_000_000
#: Most tasks that write.
MAX_TASKS = 10_000
#: The place of a missing id: before all others.
_MISSING = -1e300
#: Documents that are read at once.
READ_DOCS = 1_024

_SHARD = np.dtype([("magic", "S8"), ("width", "<i8"), ("docs", "<i8"), ("ids", "<i8")])
_SHARD_MAGIC, _INDEX_MAGIC = b"ids-1", b"mph-1"
_INDEX = np.dtype([("magic", "S8"), ("keys", "<i8"), ("runs", "<i8")])
_RUN = np.dtype([("shard", "<i8"), ("first", "<i8"), ("docs", "<i8")])


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer of a file, and whether it can be fed word by word.

    It can if white space only ever parts words: the normalizers do not look across it, every
    pre-token is free of it, and control strings neither hold it nor take it in.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    normalizers = (content.get("normalizer") or {}).get("normalizers", [])
    parts = (content.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = parts[0] if parts else {}
    by_word = (
        [n["type"] for n in normalizers] == ["NFC", "Replace", "Lowercase"]
        and normalizers[1]["pattern"] == {"Regex": r"\s+"}
        and first.get("type") == "Split"
        and first["behavior"] == "Removed" and first["invert"]
        # Fixed value: the pattern of word tokenizers of this kind; nothing in it matches white space.
        and first["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and not any(p.get("add_prefix_space") for p in parts)
        and not any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in content["added_tokens"])
    )
    return Tokenizer.from_file(path), by_word


#: Letters that every normalizer here leaves whole, and marks that belong to no control string or
#: short form: the tokenizer parts a word of such letters from such marks after it.
_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
_MARKS = "".join(c for c in string.punctuation if c not in "'<|>")
_PLAIN = f"^[{_LETTERS}]+[{re.escape(_MARKS)}]*$"


class _Known:
    """Ids, as bytes, of the texts that were encoded before, bounded by bytes."""

    def __init__(self, encode):
        self.encode, self.known, self.held = encode, {}, 0

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        known, new = self.known, [text for text in texts if text not in self.known]
        for start in range(0, len(new), 10_000):
            part = new[start : start + 10_000]
            for text, ids in zip(part, self.encode(part)):
                known[text] = ids
                self.held += 200 + len(text) + len(ids)
        return [known[text] for text in texts]


@functools.lru_cache(maxsize=2)
def _known(path: str) -> tuple[_Known, _Known]:
    """For whole words, and for lower-case words of plain letters, which are one piece to the model."""
    tokenizer, _ = _tokenizer(path)
    letters = {byte: letter for letter, byte in byte_letters().items()}
    spelled = {ord(c): "".join(letters[b] for b in c.encode()) for c in _LETTERS}

    def words(texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def stems(texts: list[str]) -> list[bytes]:
        return [_bytes([token.id for token in tokenizer.model.tokenize(text.translate(spelled))]) for text in texts]

    return _Known(words), _Known(stems)


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _gathered(pool: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a pool that codes name, one after another, and the length of each."""
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    starts = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(total)], lengths


def _word_ids(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after another, and the number of ids of each.

    A plain word and the marks after it are separate pieces, so each distinct word is encoded once
    in whatever case and before whatever mark it stands.
    """
    by_word, by_stem = _known(path)
    plain = pc.match_substring_regex(words, _PLAIN)
    stems = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, _MARKS)), "").dictionary_encode()
    rest = pc.if_else(plain, pc.utf8_ltrim(words, _LETTERS), words).dictionary_encode()
    pools = []
    for known, coded in ((by_stem, stems), (by_word, rest)):
        ids = known.ids(coded.dictionary.to_pylist())
        sizes = np.array([len(own) // 4 for own in ids], dtype=np.int64)
        pools.append((np.frombuffer(b"".join(ids), dtype=np.uint32), sizes, coded.indices.to_numpy()))
    (one, one_sizes, one_codes), (two, two_sizes, two_codes) = pools
    codes = np.stack([one_codes, two_codes + len(one_sizes)], axis=1).ravel()
    ids, lengths = _gathered(np.concatenate([one, two]), np.concatenate([one_sizes, two_sizes]), codes)
    return ids, lengths.reshape(-1, 2).sum(axis=1)


def token_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids of each text."""
    tokenizer, by_word = _tokenizer(path)
    if not by_word:
        found = [e.ids for e in tokenizer.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)]
        counts = np.array([len(ids) for ids in found], dtype=np.int64)
        return np.array([i for ids in found for i in ids], dtype=np.uint32), counts
    coded, words = parted(texts)
    ids, lengths = _gathered(*_word_ids(path, coded.dictionary), coded.indices.to_numpy())
    upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(words)])]
    return ids, np.diff(upto)


def _encoding(path: str, end_id: int):
    """Arrow function: (doc_id, text, task) to doc_id, task, number of ids, ids."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids, counts = token_ids(path, part.column(1))
                own, at = [], 0
                for n in counts.tolist():
                    own.append(narrow(np.append(ids[at : at + n], np.uint32(end_id))))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(counts + 1), pa.array(own, pa.binary())],
                    ["doc_id", "task", "n", "ids"],
                )

    return run


def _writing(folder: str, shard_ids: int):
    """Arrow function: ordered documents to shard files; returns the runs of each ``doc_id``."""

    def flushed(store, root, shard, rows):
        name = f"{uuid.uuid4().hex}.ids"
        own = [widened(data, n) for _, n, data in rows]
        ids = np.concatenate(own)
        width = 2 if ids.max() < 65_536 else 4
        ends = np.cumsum([n for _, n, _ in rows], dtype="<i8")
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            sink.write(np.array([(_SHARD_MAGIC, width, len(rows), len(ids))], dtype=_SHARD).tobytes())
            sink.write(ends.tobytes())
            sink.write(ids.astype(f"<u{width}").tobytes())
        keys = [key for key, _, _ in rows]
        firsts = [i for i, key in enumerate(keys) if not i or key != keys[i - 1]]
        counts = np.diff([*firsts, len(rows)])
        upto = np.concatenate([[0], ends])
        n_ids = upto[np.array(firsts) + counts] - upto[firsts]
        columns = [[keys[i] for i in firsts], [shard] * len(firsts), [name] * len(firsts), firsts, counts, n_ids]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUNS)], schema=_RUNS)

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId() << 32
        rows, held = [], 0
        for batch in batches:
            for key, n, data in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")]):
                rows.append((key, n, data))
                held += n
                if held >= shard_ids:
                    yield flushed(store, root, shard, rows)
                    rows, held, shard = [], 0, shard + 1
        if rows:
            yield flushed(store, root, shard, rows)

    return run


_RUNS = pa.schema(
    [("doc_id", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("first", pa.int64()),
     ("docs", pa.int64()), ("n_ids", pa.int64())]
)


def _key(doc_id: Column) -> Column:
    """A document's key: its decimal id; a missing id is the empty key."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _indexing(folder: str):
    """Arrow function: all runs of the keys of one index file to that file."""

    def build(group: pa.Table) -> pa.Table:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.mph"
        a, b = digest_words(group.column("digest").to_pylist())
        shard = group.column("shard").to_numpy()
        order = np.lexsort((shard, b, a))
        a, b = a[order], b[order]
        firsts = np.flatnonzero((np.diff(a, prepend=~a[:1]) != 0) | (np.diff(b, prepend=~b[:1]) != 0))
        counts = np.diff(np.append(firsts, len(a)))
        hashing = PerfectHash.build(a[firsts], b[firsts])
        slots = hashing.slots(a[firsts], b[firsts])
        by_slot = np.argsort(slots)
        prints = fingerprints(a[firsts], b[firsts])[by_slot]
        ends = np.cumsum(counts[by_slot], dtype="<i8")
        within = np.arange(len(a)) - np.repeat(ends - counts[by_slot], counts[by_slot])
        chosen = order[np.repeat(firsts[by_slot], counts[by_slot]) + within]
        runs = np.empty(len(a), dtype=_RUN)
        for name_ in _RUN.names:
            runs[name_] = group.column(name_).to_numpy()[chosen]
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            sink.write(np.array([(_INDEX_MAGIC, len(firsts), len(a))], dtype=_INDEX).tobytes())
            sink.write(prints.tobytes() + ends.tobytes() + runs.tobytes() + hashing.to_bytes())
        return pa.table({"number": pa.array([group.column("number")[0].as_py()], pa.int32()), "index": [name]})

    return build


class Index:
    """An index file: from digests to runs."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, _INDEX, 1)[0]
        keys, runs = int(head["keys"]), int(head["runs"])
        at = _INDEX.itemsize
        self.prints = np.frombuffer(data, "<u4", keys, at)
        self.ends = np.frombuffer(data, "<i8", keys, at := at + 4 * keys)
        self.runs = np.frombuffer(data, _RUN, runs, at := at + 8 * keys)
        self.hashing, _ = PerfectHash.from_bytes(data[at + _RUN.itemsize * runs :])

    def found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked digests are there, once for each run, and those runs."""
        slots = self.hashing.slots(a, b)
        asked = np.flatnonzero(slots >= 0)
        asked = asked[self.prints[slots[asked]] == fingerprints(a[asked], b[asked])]
        ends = self.ends[slots[asked]]
        starts = np.where(slots[asked] > 0, self.ends[slots[asked] - 1], 0)
        counts = ends - starts
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(asked, counts), self.runs[np.repeat(starts, counts) + within]


def _looking_up(folder: str):
    """Arrow function: the keys asked of one index file to their runs."""

    def find(group: pa.Table) -> pa.Table:
        store, root = pafs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{root}/{group.column('index')[0].as_py()}") as source:
            index = Index(source.read())
        asked, runs = index.found(*digest_words(group.column("digest").to_pylist()))
        return pa.table(
            {"doc_id": group.column("doc_id").take(pa.array(asked)), **{c: pa.array(runs[c]) for c in _RUN.names}}
        )

    return find


def _reading(folder: str):
    """Arrow function: runs, sorted by shard, to the ids of their documents."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("doc_id", "file", "start", "first", "docs")]
            opened, source = None, None
            for key, file, start, first, docs in zip(*rows):
                if file != opened:
                    source, opened = store.open_input_file(f"{root}/{file}"), file
                    head = np.frombuffer(source.read_at(_SHARD.itemsize, 0), _SHARD)[0]
                    width, payload = int(head["width"]), _SHARD.itemsize + 8 * int(head["docs"])
                for at in range(first, first + docs, READ_DOCS):
                    n = min(READ_DOCS, first + docs - at)
                    before = min(at, 1)
                    ends = np.frombuffer(source.read_at(8 * (n + before), _SHARD.itemsize + 8 * (at - before)), "<i8")
                    ends = ends if before else np.append(0, ends)
                    begin, lengths = int(ends[0]), np.diff(ends)
                    data = source.read_at(width * int(ends[-1] - begin), payload + width * begin)
                    ids = np.frombuffer(data, f"<u{width}").astype("<u4")
                    own = [ids[s - begin : e - begin].tobytes() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * n, pa.int64()), pa.array(start + ends[:-1]), pa.array(lengths),
                         pa.array(own, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return run


@dataclass
class TokenFiles:
    """Written files: their folder, ``shards`` (shard, file, start, docs, n_ids), ``indexes`` (number, index)
    and how many index files keys are dealt to."""

    folder: str
    shards: DataFrame
    indexes: DataFrame
    dealt: int
    tasks: int


def write(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> TokenFiles:
    """Write the ids of whole texts, each document ended by ``end_id``, and the index over them."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    rows = docs.select(named(docs, "doc_id").cast("bigint").alias("doc_id"), named(docs, "text").alias("text"))
    tasks = min(MAX_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()))
    task = _range_of(F.col("doc_id"), _cuts(rows.select("doc_id"), tasks), F.monotonically_increasing_id())
    runs = stored(
        rows.withColumn("task", task)
        .mapInArrow(_encoding(tokenizer_path, end_id), "doc_id bigint, task int, n bigint, ids binary")
        .repartitionById(tasks, "task")
        .sortWithinPartitions("doc_id", "n")
        .mapInArrow(
            _writing(folder, shard_ids),
            "doc_id bigint, shard bigint, file string, first bigint, docs bigint, n_ids bigint",
        ),
        "runs",
    )
    keys = runs.count()
    dealt = max(INDEX_FILES, -(-keys // INDEX_KEYS))
    indexes = stored(
        _keyed(runs, dealt)
        .groupBy("number")
        .applyInArrow(_indexing(folder), "number int, index string"),
        "indexes",
    )
    return TokenFiles(folder, _shards(runs), indexes, dealt, tasks)


def _cuts(ids: DataFrame, tasks: int) -> list[float]:
    """Where the ranges of ids end: ascending, a value as often as it takes the place of a cut."""
    if tasks < 2:
        return []
    value = F.coalesce(F.col("doc_id").cast("double"), F.lit(_MISSING)).alias("value")
    return sorted(ids.select(value).approxQuantile("value", [i / tasks for i in range(1, tasks)], 0.1 / tasks))


def _range_of(doc_id: Column, cuts: list[float], row: Column) -> Column:
    """The range of an id. One that equals several cuts has the ranges between them to itself and is
    dealt to all of these; any other goes with what is above the last cut that it reaches."""
    value = F.coalesce(doc_id.cast("double"), F.lit(_MISSING))
    ends = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    below = F.size(F.filter(ends, lambda c: c < value))
    equal = F.size(F.filter(ends, lambda c: c == value))
    shared = (equal > 1) & ((F.abs(value) < 2.0**53) | (value == _MISSING))
    dealt = below + 1 + F.pmod(F.xxhash64(row), F.greatest(equal - 1, F.lit(1)))
    return F.when(shared, dealt).otherwise(below + equal).cast("int")


def _keyed(rows: DataFrame, dealt: int) -> DataFrame:
    key = _key(F.col("doc_id"))
    number = F.pmod(F.xxhash64(key), F.lit(dealt)).cast("int")
    return rows.withColumns({"digest": F.unhex(F.md5(key)), "number": number})


def _shards(runs: DataFrame) -> DataFrame:
    """Every shard with its file and the number of ids before it: summed within ranges, then over them."""
    shards = stored(
        runs.groupBy("shard", "file").agg(F.sum("docs").alias("docs"), F.sum("n_ids").alias("n_ids")), "shards"
    )
    part = F.shiftright("shard", 32)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        shards.groupBy(part.alias("part"))
        .agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        shards.withColumn("part", part)
        .withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(before, "part")
        .select("shard", "file", (F.col("before") + F.col("inside")).alias("start"), "docs", "n_ids")
    )


def find(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """The runs (doc_id, shard, first, docs) of the documents asked for, by the index alone."""
    asked = keys.select(named(keys, "doc_id").cast("bigint").alias("doc_id")).distinct()
    return (
        _keyed(asked, files.dealt)
        .join(files.indexes, "number")
        .groupBy("number")
        .applyInArrow(_looking_up(files.folder), "doc_id bigint, shard bigint, first bigint, docs bigint")
    )


def read(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (32-bit words) of the documents asked for."""
    return (
        find(files, keys)
        .join(files.shards.select("shard", "file", "start"), "shard")
        .repartition(files.tasks, "shard")
        .sortWithinPartitions("shard", "first")
        .select("doc_id", "file", "start", "first", "docs")
        .mapInArrow(_reading(files.folder), "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    )

"""WARC archives with an index of every record, and range reads that follow the index.

A task that writes appends gzip members, one per record, to an archive of its own and returns
an index row for each: archive, offset, length, URL, digest. The index is stored through
Spark, which keeps the rows of one attempt per task; the archive of a lost attempt has a
name of its own and is in no index. Reading starts from the index alone: the selected rows are
sorted by archive and offset, and neighbouring ranges become one read of up to ``READ_BYTES``.

Archives lie below the folder that all executors share and are opened by its URI.

Payloads of at least ``MIN_REVISIT`` bytes that occur again are stored once, with the least
``page_id``; the others are revisits with headers only. Null html is an empty payload.
Rows with equal ``page_id`` and payload are responses each, as each has the least id; a row
without ``page_id`` revisits if any page with its payload has an id. A null URL writes no
target header; control characters in a URL are percent-encoded in the header only.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.common import named, stored
from threatloom.llm.packing import batch_rows
from threatloom.session import new_folder

END = "\r\n\r\n"
MIN_REVISIT = 100
ARCHIVE_BYTES = 32_000_000
#: Ranges with gaps up to so many bytes are read at once, up to the second number.
GAP_BYTES = 65_536
READ_BYTES = 4_000_000
#: Copies of a digest's row, so that rows of a frequent payload meet it in several tasks.
SALTS = 8

# Names of the WARC format.
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_INDEX = "page_id bigint, archive string, offset bigint, length bigint, url string, digest string"
_RECORD = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, payload binary, digest_matches boolean"
)


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and first_id: the page whose payload a row repeats, or null."""
    rows = pages.select(
        named(pages, "page_id").cast("bigint").alias("page_id"),
        named(pages, "url").cast("string").alias("url"),
        F.coalesce(named(pages, "html"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    repeated = (
        rows.where(F.octet_length("html") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select(
            F.col("digest").alias("same"), "first_id",
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        )
    )
    salted = rows.withColumn("own_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(
        repeated, (F.col("digest") == F.col("same")) & (F.col("own_salt") == F.col("salt")), "left"
    )
    repeats = F.coalesce(F.col("first_id") != F.col("page_id"), F.col("first_id").isNotNull())
    first = F.when(repeats, F.col("first_id")).alias("first_id")
    return joined.select("page_id", "url", "html", "digest", first)


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None) -> bytes:
    """One record: a response with its payload, or a revisit of ``first_id`` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
    block = http if first_id is not None else http + payload
    fields = {
        "WARC-Type": RESPONSE if first_id is None else REVISIT,
        "WARC-Record-ID": _uri(page_id),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if first_id is not None:
        fields |= {"WARC-Refers-To": _uri(first_id), "WARC-Profile": PROFILE}
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "replace") + block + END.encode()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = data.partition(END.encode())
    lines = head.decode("utf-8").split("\r\n")[1:]
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(END.encode())[2]


def _page_id(uri: str | None) -> int | None:
    number = uri[len("<urn:page:") : -1] if uri else "none"
    return None if number == "none" else int(number)


def _writing(folder: str):
    """Arrow function: pages to archives below ``folder``; returns their index rows."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        sink, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, first_id in zip(*[c.to_pylist() for c in batch.columns]):
                    if sink is None or at >= ARCHIVE_BYTES:
                        if sink is not None:
                            sink.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(
                        record(page_id, url, html.encode("utf-8", "replace"), digest, first_id), 1, mtime=0
                    )
                    sink.write(member)
                    rows.append((page_id, name, at, len(member), url, digest))
                    at += len(member)
                yield _batch(rows, _INDEX)
        finally:
            if sink is not None:
                sink.close()

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields]
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page below ``folder`` and return the stored index."""
    return stored(marked(pages).mapInArrow(_writing(folder), _INDEX), "warc-index")


def joined_ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted (archive, offset, length) rows as reads: archive, start, end and the rows in them."""
    current = None
    for i, (archive, offset, length) in enumerate(rows):
        if (
            current
            and current[0] == archive
            and offset - current[2] <= GAP_BYTES
            and offset + length - current[1] <= READ_BYTES
        ):
            current = (archive, current[1], max(current[2], offset + length), [*current[3], i])
        else:
            if current:
                yield current
            current = (archive, offset, offset + length, [i])
    if current:
        yield current


def _reading(folder: str):
    """Arrow function: index rows, sorted, to the records they point to."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch_rows(batch, 1_024):
                ids, urls = part.column("page_id").to_pylist(), part.column("url").to_pylist()
                spans = list(zip(*[part.column(c).to_pylist() for c in ("archive", "offset", "length")]))
                for archive, start, end, members in joined_ranges(spans):
                    with store.open_input_file(f"{root}/{archive}") as source:
                        data = source.read_at(end - start, start)
                    rows = []
                    for i in members:
                        at = spans[i][1] - start
                        fields, payload = parsed(gzip.decompress(data[at : at + spans[i][2]]))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        revisit = fields["WARC-Type"] == REVISIT
                        rows.append((
                            _page_id(fields["WARC-Record-ID"]), urls[i], int(fields["X-Payload-Length"]), digest,
                            fields["WARC-Type"], _page_id(fields.get("WARC-Refers-To")), payload,
                            revisit or hashlib.sha256(payload).hexdigest() == digest,
                        ))
                    yield _batch(rows, _RECORD)

    return run


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records that index rows point to, by joined range reads in the order of the archives."""
    ordered = selected.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.select("page_id", "archive", "offset", "length", "url", "digest").mapInArrow(
        _reading(folder), _RECORD
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives as a URI, below the shared one."""
    path = new_folder(spark, "warc")
    return path if "://" in path else f"file://{path.removeprefix('file:')}"

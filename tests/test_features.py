"""The whole feature vector of a file against a plain reading of its bytes."""

import math
import struct
from collections import Counter

from pyspark.sql import functions as F
from tests_programs import program

from threatloom.fixed_values import API_TOKENS, PE_FEATURES
from threatloom.operators import features

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def entropy(data):
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0.0


def corpus(spark, files):
    return spark.createDataFrame([(p, None, len(c), c) for p, c in files.items()], SCHEMA)


def overlapping(count):
    """A program whose section table claims the same bytes many times, and bytes that are not there."""
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64)
    coff = b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, count + 3, 0, 0, 0, 224, 0x102)
    at = 64 + 24 + 224 + 40 * (count + 1)
    rows = b"".join(struct.pack("<8sIIII16x", b"same", 9000, 0, 9000, at) for _ in range(count))
    rows += struct.pack("<8sIIII16x", b"far", 2**31, 0, 2**31, at + 4000)
    return head + coff + struct.pack("<H", 0x10B) + b"\0" * 222 + rows + bytes(i * 7 % 256 for i in range(9000))


FILES = {
    "a.exe": program(False, b"see http://x WriteFile WriteFile 10.0.0.1 " * 300, resources=9),
    "b.dll": program(True, b""),
    "c.bin": b"no program: ReadFile https://a.b 1.2.3.4",
    "d.exe": b"",
    "e.exe": overlapping(200),
}


def test_every_extractor_is_in_the_map(spark):
    imports = spark.createDataFrame([("a.exe", "KERNEL32.dll", "x"), ("a.exe", "kernel32.dll", "y"), ("a.exe", "z.dll", None)], "file string, dll string, symbol string")
    found = features.with_features(corpus(spark, FILES), imports=imports)
    assert found.columns == ["path", "modificationTime", "length", "content", "features"]
    got = {r["path"]: r["features"] for r in found.collect()}
    a = got["a.exe"]
    body = b"see http://x WriteFile WriteFile 10.0.0.1 " * 300
    assert a["section_.text_size"] == len(body) and abs(a["section_.text_entropy"] - entropy(body)) < 1e-9
    assert a["section_longname_size"] == 256 and abs(a["section_longname_entropy"] - 8) < 1e-9
    assert (a["size"], a["file_size"], a["num_sections"], a["has_resources"]) == (len(FILES["a.exe"]), len(FILES["a.exe"]), 2, 1)
    assert (a["url_count"], a["ip_count"], a["WriteFile"], a["ReadFile"]) == (300, 300, 600, 0)
    assert (a["num_imports"], a["import_kernel32.dll"], a["import_user32.dll"]) == (2, 2, 0)
    assert a["printable_chars"] == sum(c.isprintable() for c in FILES["a.exe"].decode("latin-1"))
    assert set(PE_FEATURES) <= set(a) and a["Machine"] == 0x14C
    assert got["b.dll"]["section_.text_entropy"] == 0 and got["b.dll"]["has_resources"] == 0
    c = got["c.bin"]
    assert c["file_size"] == len(FILES["c.bin"]) and c["ReadFile"] == 1 and "size" not in c and "num_sections" not in c
    assert not any(n.startswith("section_") for n in c) and got["d.exe"]["file_size"] == 0
    e = got["e.exe"]
    assert e["num_sections"] == 203 and abs(e["section_same_entropy"] - entropy(FILES["e.exe"][-9000:])) < 1e-9
    assert e["section_far_size"] == 2**31 and abs(e["section_far_entropy"] - entropy(FILES["e.exe"][-5000:])) < 1e-9


def test_vectors_are_aligned_to_the_columns_of_a_model(spark):
    columns = ["never", "ImageBase", "section_.text_size", "WriteFile", "abc", "section_none_entropy", "url_count", "hash", "import_kernel32.dll"]
    found = features.file_features(corpus(spark, FILES), columns, "path", prefix_bytes=600)
    assert found.columns == ["path", *columns]
    got = {r["path"]: r.asDict() for r in found.collect()}
    assert all(v == 0 for k, v in got["c.bin"].items() if k not in ("path", "url_count")) and got["c.bin"]["url_count"] == 1
    a = got["a.exe"]
    assert a["section_.text_size"] == 12_600 and a["never"] == a["abc"] == a["hash"] == a["import_kernel32.dll"] == 0
    assert a["WriteFile"] == FILES["a.exe"][:600].count(b"WriteFile") and a["ImageBase"] == 0xFFEEDDCC


def test_only_what_is_asked_for_is_read(spark):
    plan = features.file_features(corpus(spark, FILES), ["Machine", "file_size"], "path")._jdf.queryExecution().toString()
    assert "section_map" not in plan and "regexp_count" not in plan
    assert features.token_names([*API_TOKENS[:2], "size", "abc", "section_x_size", "hash"]) == API_TOKENS[:2]


def test_no_files(spark):
    assert features.file_features(corpus(spark, FILES).limit(0), ["Machine", "section_a_entropy"], "path").collect() == []
    null = spark.createDataFrame([("x", None, None, None)], SCHEMA)
    row = features.file_features(null, ["Machine", "file_size", "section_a_entropy", "WriteFile"], "path").first()
    assert tuple(row) == ("x", 0, 0, 0, 0)


def test_section_entropies_hold_little_beside_a_content(spark):
    import tracemalloc

    import numpy as np

    data = np.random.default_rng(4).integers(0, 64, 8_000_001).astype(np.uint8)
    tracemalloc.start()
    entropies = features._entropies(data, np.array([5, 0, 7]), np.array([7_999_000, 0, 100]))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()

    def entropy(part):
        share = np.bincount(part)[np.bincount(part) > 0] / len(part)
        return float(-(share * np.log2(share)).sum())

    assert np.allclose(entropies, [entropy(data[5:7_999_005]), 0, entropy(data[7:107])])
    assert held < 3 * len(data)

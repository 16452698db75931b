"""Input that a hostile or careless sender can make costs its own row, not the job."""

import struct

from pyspark.sql import functions as F

from tests_programs import program
from threatloom.functions import pe
from threatloom.functions.connections import split_connection_key
from threatloom.operators.corpus import import_features
from threatloom.operators.quality import find_label_column, is_non_feature
from threatloom.sources.files import read_summaries


def test_section_that_claims_more_than_the_file(spark):
    good = program(False, b"body")
    at = 64 + 24 + 224 + 16  # raw size and offset of the first section
    bad = good[:at] + struct.pack("<II", 0xFFFFFFFF, 0xFFFFFFFF) + good[at + 8 :]
    corpus = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(bad))], "path string, content binary")
    rows = {(r["path"], r["section_index"]): r for r in pe.sections(corpus, "path").collect()}
    assert bytes(rows["good", 0]["bytes"]) == b"body"
    assert rows["bad", 0]["raw_size"] == 0xFFFFFFFF and bytes(rows["bad", 0]["bytes"]) == b""
    assert len(rows["bad", 1]["bytes"]) == 256


def test_malformed_connection_keys(spark):
    keys = spark.createDataFrame([("1.1.1.1_5_2.2.2.2_6",), ("junk",), ("a_b_c_d",), (None,)], "key string")
    parts = [r[0] for r in keys.select(split_connection_key(F.col("key"))).collect()]
    assert [tuple(p) for p in parts] == [
        ("1.1.1.1", 5, "2.2.2.2", 6), ("junk", None, None, None), ("a", None, "c", None), (None, None, None, None)
    ]


def test_imports_by_ordinal_count(spark):
    rows = spark.createDataFrame([("f", "KERNEL32.dll", None), ("f", "kernel32.dll", "x")], "file string, dll string, symbol string")
    assert import_features(rows).first()["import_kernel32.dll"] == 2


def test_absent_summary_is_left_out(spark, tmp_path):
    assert read_summaries(spark, {"gone": str(tmp_path / "gone.json")}).count() == 0


def test_names():
    assert find_label_column(["attack", "x", "Label"]) == "Label"
    names = ["id", "flow_id", "Flow ID", "id_orig", "the id here", "valid", "idle", "paid"]
    assert [is_non_feature(n) for n in names[:5]] == [True] * 5 and not any(is_non_feature(n) for n in names[5:])

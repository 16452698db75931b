import datetime
import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F
from tests_programs import program

from threatloom import fixed_values as V
from threatloom.functions import files, pe, scoring, text
from threatloom.operators import corpus, threats
from threatloom.plans import scanning
from threatloom.sources.files import read_corpus


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    contents = {
        "one.exe": program(False, b"\0" * 100, resources=40),
        "sub/two.dll": program(True, b"ab" * 50, machine=0x8664),
        "fake.exe": b"http://a https://b http://http:// 1.2 1.2.3.4 1.2.3.4:80 1.2.3.4.x 3. a.b \xb2.1 1.2.3.",
        "NOTES.TXT": b"x",
        "eicar.exe": b"harmless",
        "hello.exe": b"MZ",
        "cut.exe": b"MZ" + b"\0" * 58 + struct.pack("<I", 4000),
    }
    for name, content in contents.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    return root, contents


@pytest.fixture(scope="module")
def stored(spark, folder):
    return read_corpus(spark, str(folder[0])).withColumn("name", files.file_name(F.col("path")))


def values(frame, column, key="name"):
    return {r[key]: r[column] for r in frame.select(key, column).collect()}


def test_hashes(stored, folder):
    for algorithm in files.HASHES:
        got = values(stored.withColumn("h", files.file_hash(F.col("content"), algorithm)), "h")
        assert got["one.exe"] == hashlib.new(algorithm, folder[1]["one.exe"]).hexdigest()
    with pytest.raises(ValueError):
        files.file_hash(F.col("content"), "crc")


def test_info_reads_no_contents(stored, folder):
    info = corpus.file_info(stored)
    rows = {r["filename"]: r for r in info.collect()}
    assert rows["NOTES.TXT"]["extension"] == ".txt" and rows["one.exe"]["size"] == len(folder[1]["one.exe"])
    assert "content" not in info._jdf.queryExecution().executedPlan().toString()


def test_strings_as_python_counts_them(spark, stored, folder):
    blob = bytes(range(256)) + "é 10.0.0.1 7.7\x859.9.9.9.9\x1c1..2 ²".encode("latin-1")
    extra = spark.createDataFrame([("blob", bytearray(blob))], "name string, content binary")
    frame = stored.select("name", "content").unionByName(extra)
    got = {r["name"]: r for r in corpus.string_features(frame, ["http", "aba", "abc"]).collect()}
    for name, content in {**{os.path.basename(k): v for k, v in folder[1].items()}, "blob": blob}.items():
        body = content.decode("latin-1")
        row = got[name]
        assert row["printable_chars"] == sum(c.isprintable() for c in body), name
        assert row["url_count"] == body.count("http://") + body.count("https://")
        words = [w for w in body.split() if "." in w and all(p.isdigit() for p in w.split(".")[:4])]
        assert row["ip_count"] == len(words), (name, words)
        # Short names do not count.
        assert row["tokens"] == {"http": body.count("http")}


def test_prefix_is_an_option(spark):
    frame = spark.createDataFrame([(bytearray(b"httpXhttp"),)], "content binary")
    whole = frame.select(text.count_token(text.latin1_text(F.col("content")), "http")).first()[0]
    part = frame.select(text.count_token(text.latin1_text(F.col("content"), 5), "http")).first()[0]
    assert (whole, part) == (2, 1)


def test_overlapping_tokens(spark):
    frame = spark.createDataFrame([("aaaa",)], "s string")
    assert frame.select(text.count_token(F.col("s"), "aa")).first()[0] == "aaaa".count("aa")
    with pytest.raises(ValueError):
        text.count_token(F.col("s"), "")


def test_pe_gate(stored):
    assert {n for n, v in values(pe.is_pe(stored), "is_pe").items() if v} == {"one.exe", "two.dll"}


def test_pe_headers(stored):
    rows = {r["name"]: r for r in pe.header_fields(stored).collect()}
    one, two = rows["one.exe"], rows["two.dll"]
    assert (one["Machine"], two["Machine"], one["SectionsNb"]) == (0x14C, 0x8664, 2)
    assert (one["MajorLinkerVersion"], one["MinorLinkerVersion"]) == (9, 200)
    assert one["ImageBase"] == 0xFFEEDDCC and two["ImageBase"] == 0xF000000000000001
    # Bytes that form text characters must not be reversed as characters.
    assert one["SizeOfImage"] == 0xC3A9C3A9 and two["SizeOfHeaders"] == 24
    names = ["SizeOfStackReserve", "SizeOfStackCommit", "SizeOfHeapReserve", "SizeOfHeapCommit", "LoaderFlags"]
    assert [one[n] for n in names] == [25, 26, 27, 28, 29] == [two[n] for n in names]
    assert one["DllCharacteristics"] == 0x8160 and two["NumberOfRvaAndSizes"] == 16
    assert all(rows["fake.exe"][n] is None and rows["cut.exe"][n] is None for n in V.PE_FEATURES)
    assert values(pe.has_resources(stored), "has_resources") == {
        n: int(n == "one.exe") for n in rows
    }


def test_sections(stored):
    rows = corpus.section_features(stored, "name").collect()
    got = {(r["name"], r["section"]): (r["raw_size"], r["entropy"]) for r in rows}
    assert got[("one.exe", ".text")] == (100, 0.0)
    assert got[("two.dll", ".text")][1] == pytest.approx(1.0)
    assert got[("one.exe", "longname")] == (256, pytest.approx(8.0))
    assert len(got) == 4


def test_entropy_over_pieces_and_empty(spark):
    n = corpus.CHUNK_BYTES
    rows = [("big", bytearray(b"a" * (n + 7) + b"b" * (n + 7))), ("none", bytearray())]
    frame = spark.createDataFrame(rows, "name string, bytes binary")
    got = {r["name"]: (r["size"], r["entropy"]) for r in corpus.byte_entropy(frame, ["name"]).collect()}
    assert got["big"] == (2 * n + 14, pytest.approx(1.0)) and got["none"] == (0, 0.0)


def test_imports(spark):
    rows = [("f", "KERNEL32.dll", "a"), ("f", "kernel32.DLL", "b"), ("f", "x.dll", "c"), ("g", "ws2_32.dll", "d")]
    got = {r["file"]: r for r in corpus.import_features(spark.createDataFrame(rows, "file string, dll string, symbol string")).collect()}
    assert (got["f"]["num_imports"], got["f"]["import_kernel32.dll"], got["f"]["import_ws2_32.dll"]) == (2, 2, 0)
    assert got["g"]["import_ws2_32.dll"] == 1


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1536, 1152, 5 * 1024**2 + 77, 3 * 1024**4, 7 * 1024**5])
def test_sizes(spark, n):
    size = float(n)
    for unit in ["B", "KB", "MB", "GB", "TB", "PB"]:
        if size < 1024 or unit == "PB":
            break
        size /= 1024
    assert spark.range(1).select(files.format_bytes(F.lit(n))).first()[0] == f"{size:.2f} {unit}"


def test_admission(spark):
    rows = [("/u/a.EXE", 16 * 1024 * 1024), ("/u/b.dll", 16 * 1024 * 1024 + 1), ("/u/c.txt", 1), ("/u/noext", 1), ("/u/../x y.bin", None)]
    got = {r["filename"]: r for r in corpus.admit(spark.createDataFrame(rows, "path string, length bigint")).collect()}
    assert got["a.EXE"]["allowed"] and got["a.EXE"]["valid"] and got["a.EXE"]["reason"] == "File is valid"
    assert not got["b.dll"]["valid"] and got["b.dll"]["reason"] == "File size exceeds 16MB limit"
    assert not got["c.txt"]["allowed"] and not got["noext"]["allowed"]
    assert not got["x_y.bin"]["valid"] and got["x_y.bin"]["reason"] == "File does not exist"


def test_retention(stored):
    now = datetime.datetime.now(datetime.timezone.utc)
    later = F.lit(now + datetime.timedelta(hours=25))
    assert corpus.expired_files(stored, later).count() == stored.count()
    assert corpus.expired_files(stored, F.lit(now)).count() == 0


def test_detected_features(spark):
    frame = spark.createDataFrame([("f", {"a": 11, "b": 6, "c": 1, "d": 0, "hash": 9}), ("g", {})], "k string, m map<string,int>")
    got = {r["feature"]: r["importance"] for r in corpus.detected_features(frame, "k", "m").collect()}
    assert got == {"a": "High", "b": "Medium", "c": "Low"}


@pytest.mark.parametrize(
    "rf, net, verdict", [(0.99, 0.99, "Malware"), (0.99, 0.97, "Benign"), (0.97, 0.99, "Benign"), (1.0, 0.98, "Malware"), (0.5, 0.5, "Benign")]
)
def test_ensemble(spark, rf, net, verdict):
    row = spark.range(1).select(scoring.prediction_struct(F.lit(rf), F.lit(net)).alias("p")).first()["p"]
    assert row["ensemble"]["final_prediction"] == verdict == row["ensemble"]["prediction"]
    assert row["ensemble"]["probability"] == pytest.approx(0.7 * rf + 0.3 * net)
    assert row["random_forest"]["confidence"] == pytest.approx(abs(rf - 0.5) * 2)


class FixedModel:
    """Scores every row alike; stands for a fitted model."""

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector

        return df.withColumn("rf_probability", array_to_vector(F.array(F.lit(0.005), F.lit(0.995)))).withColumn(
            "net_probability", array_to_vector(F.array(F.lit(0.01), F.lit(0.99)))
        )


def test_scan(stored, folder):
    verdicts = scanning.scan(stored.drop("name"), FixedModel(), V.PE_FEATURES)
    got = {r["filename"]: r for r in verdicts.collect()}
    assert set(got) == {"one.exe", "two.dll", "fake.exe", "eicar.exe", "hello.exe", "cut.exe"}
    final = {n: r["prediction"]["ensemble"]["final_prediction"] for n, r in got.items()}
    assert final == {"one.exe": "Malware", "two.dll": "Malware", "fake.exe": "Benign", "eicar.exe": "Malware", "hello.exe": "Benign", "cut.exe": "Benign"}
    assert got["fake.exe"]["warning"] == V.UNSUPPORTED_WARNING and got["one.exe"]["warning"] is None
    assert got["eicar.exe"]["warning"] is None and got["eicar.exe"]["prediction"]["ensemble"]["probability"] == 0.0
    events = {r["file_name"]: r for r in scanning.events(verdicts).collect()}
    assert (events["eicar.exe"]["file_hash"], events["eicar.exe"]["confidence"], events["eicar.exe"]["severity"]) == ("EICAR_TEST_FILE", 0.98, "high")
    assert events["one.exe"]["file_hash"] == hashlib.sha256(folder[1]["one.exe"]).hexdigest()
    assert (events["fake.exe"]["file_hash"], events["fake.exe"]["severity"], events["fake.exe"]["confidence"]) == ("", "low", 0.0)
    shown = {r["filename"]: r["prediction"] for r in scanning.shown(verdicts).collect()}
    assert (shown["hello.exe"]["lstm"]["probability"], shown["hello.exe"]["lstm"]["confidence"]) == (0.6362, 0.8186)
    assert shown["hello.exe"]["ensemble"] == got["hello.exe"]["prediction"]["ensemble"]


def test_alert_lines(spark):
    frame = spark.createDataFrame([("normal",), ("neptune",)], "attack_type string")
    got = [(r["level"], r["message"]) for r in threats.alerts(frame).collect()]
    assert got == [("INFO", "Normal traffic detected."), ("ERROR", "Alert! Attack detected: neptune")]


def test_large_files_are_left_out_by_the_scan(spark, tmp_path):
    for name, size in (("small.exe", 10), ("large.exe", 2 * 1024 * 1024), ("other.zzz", 10)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = scanning.admitted(spark.read.format("binaryFile").load(str(tmp_path)), max_mb=1)
    assert [r["filename"] for r in found.collect()] == ["small.exe"]
    assert "LessThanOrEqual(length,1048576)" in found._jdf.queryExecution().toString()

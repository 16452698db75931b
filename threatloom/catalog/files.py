"""File corpora: names, hashes, strings, PE headers, sections, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.catalog import standins as S
from threatloom.fixed_values import API_TOKENS, COMMON_DLLS, PE_FEATURES
from threatloom.functions import files as names
from threatloom.functions import pe
from threatloom.functions.scoring import fixed_prediction
from threatloom.functions.text import count_token, latin1_text
from threatloom.operators import corpus, features, threats

# Words that occur in the test texts, next to the fixed API names.
TOKENS = [*API_TOKENS, "Error", "license", "tion", "there", "Copyright"]

# Text of a document, one character per byte.
LATIN1 = """latin as (
  select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'),
    lambda h: chr(cast('0x' || h as int))) as chars
  from documents
), bodies as (
  select doc_id, chars, array_to_string(chars, '') as body from latin
)"""


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("content")
    return S.files(spark, sf_dir).select(
        "doc_id",
        names.file_hash(body).alias("sha256"),
        names.file_hash(body, "md5").alias("md5"),
        names.file_hash(body, "sha1").alias("sha1"),
        F.length(names.file_hash(body, "sha512")).cast("bigint").alias("sha512_chars"),
    )


FILE_HASHES = """select doc_id, sha256(text) as sha256, md5(text) as md5, sha1(text) as sha1,
  128::bigint as sha512_chars from documents"""


def file_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable characters, URLs and addresses in whole texts."""
    found = corpus.string_features(S.files(spark, sf_dir), TOKENS)
    return found.select("doc_id", "printable_chars", "url_count", "ip_count")


FILE_STRINGS = f"""with {LATIN1}
select doc_id,
  len(list_filter(chars, lambda c: (c >= ' ' and c <= '~') or (c >= chr(161) and c <= chr(172))
    or (c >= chr(174) and c <= chr(255)))) as printable_chars,
  cast((length(body) - length(replace(body, 'http://', ''))) // 7
    + (length(body) - length(replace(body, 'https://', ''))) // 8 as bigint) as url_count,
  len(list_filter(regexp_split_to_array(body, '[ \\t-\\r\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+'), lambda w:
    regexp_full_match(w, '[0-9\\x{{b2}}\\x{{b3}}\\x{{b9}}]+(\\.[0-9\\x{{b2}}\\x{{b3}}\\x{{b9}}]+){{1,2}}')
    or regexp_full_match(w, '[0-9\\x{{b2}}\\x{{b3}}\\x{{b9}}]+(\\.[0-9\\x{{b2}}\\x{{b3}}\\x{{b9}}]+){{3}}(\\..*)?')
  )) as ip_count
from bodies"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL counts in whole pages, which have some."""
    body = latin1_text(F.encode("html", "UTF-8"))
    return S.table(spark, sf_dir, "pages").select(
        "page_id",
        (count_token(body, "http://") + count_token(body, "https://")).alias("url_count"),
        count_token(body, "href").alias("links"),
    )


PAGE_LINKS = """select page_id,
  cast((length(html) - length(replace(html, 'http://', ''))) // 7
    + (length(html) - length(replace(html, 'https://', ''))) // 8 as bigint) as url_count,
  cast((length(html) - length(replace(html, 'href', ''))) // 4 as bigint) as links
from pages"""


def detected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens found in each text, with their importance."""
    found = corpus.string_features(S.files(spark, sf_dir), TOKENS)
    return corpus.detected_features(found, "doc_id", "tokens")


DETECTED_FEATURES = f"""with counts as (
  select doc_id, t.feature,
    cast((length(text) - length(replace(text, t.feature, ''))) // length(t.feature) as bigint) as value
  from documents, (select unnest([{", ".join(f"'{t}'" for t in TOKENS)}]) as feature) t
)
select doc_id, feature, value,
  case when value > 10 then 'High' when value > 5 then 'Medium' else 'Low' end as importance
from counts where value > 0"""


def file_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, extension, size text and whether each file may be scanned."""
    found = corpus.admit(S.files(spark, sf_dir))
    return found.select(
        "doc_id", "filename", names.extension(F.col("filename")).alias("extension"),
        names.format_bytes(F.col("length")).alias("size_text"), "allowed", "valid", "reason",
    )


FILE_ADMISSION = f"""with {S.FILES}, named as (
  select doc_id, length, case doc_id % 8 when 6 then 'c.bin' else split_part(path, '/', 5) end as filename
  from files
)
select doc_id, filename,
  case when contains(filename, '.') then lower(split_part(filename, '.', -1)) else '' end as extension,
  case when length < 1024 then printf('%.2f B', cast(length as double))
    when length < 1048576 then printf('%.2f KB', length / 1024)
    else printf('%.2f MB', length / 1048576) end as size_text,
  contains(filename, '.') and lower(split_part(filename, '.', -1)) in ('exe', 'dll', 'sys', 'bin', 'dat')
    as allowed,
  length <= 16777216 as valid,
  case when length > 16777216 then 'File size exceeds 16MB limit' else 'File is valid' end as reason
from named"""


def file_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.file_info(S.files(spark, sf_dir))
    return found.select("filename", "size", F.unix_micros("modified").alias("modified_us"), "extension", "path")


FILE_DETAILS = f"""with {S.FILES}, named as (
  select *, string_split(path, '/')[-1] as filename from files
)
select filename, length as size, epoch_us(modified) as modified_us,
  case when contains(filename, '.') then '.' || lower(split_part(filename, '.', -1)) else '' end as extension,
  path
from named"""


def expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-01-04 00:00:00").cast("timestamp")
    return corpus.expired_files(S.files(spark, sf_dir), as_of, 24).select("path", "length")


EXPIRED_FILES = f"""with {S.FILES}
select path, length from files where modified < timestamp '2024-01-03 00:00:00'"""


def content_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of whole texts in bits per byte."""
    found = corpus.byte_entropy(S.files(spark, sf_dir), ["doc_id"], "content")
    return found.withColumn("entropy", F.round("entropy", 6))


CONTENT_ENTROPY = """with bytes as (
  select doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) as byte from documents
), counts as (
  select doc_id, byte, count(*) as n from bytes group by all
), shares as (
  select *, sum(n) over (partition by doc_id) as size from counts
)
select doc_id, cast(max(size) as bigint) as size, round(abs(-sum(n / size * log2(n / size))), 6) as entropy
from shares group by doc_id"""


def pe_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header features of executables, the magic test and the resource flag."""
    found = pe.has_resources(pe.is_pe(pe.header_fields(S.programs(spark, sf_dir))))
    return found.select(
        "doc_id", "is_pe", "has_resources", *[F.col(c).cast("double").alias(c) for c in PE_FEATURES]
    )


def _pe_headers_sql() -> str:
    plus = "doc_id % 2 = 1"
    size = "octet_length(encode(text))"

    def either(a, b):
        return f"case when {plus} then {a} else {b} end"

    values = {
        "Machine": either(0x8664, 0x14C),
        "SizeOfOptionalHeader": either(240, 224),
        "Characteristics": 0x102,
        "MajorLinkerVersion": 14,
        "MinorLinkerVersion": "doc_id % 100",
        "SizeOfCode": size,
        "SizeOfInitializedData": 64,
        "SizeOfUninitializedData": 0,
        "AddressOfEntryPoint": "doc_id + 4096",
        "BaseOfCode": 4096,
        "ImageBase": either(f"(doc_id + 1) * {1 << 40}", f"doc_id + {1 << 22}"),
        "SectionAlignment": 4096,
        "FileAlignment": 512,
        "MajorOperatingSystemVersion": 6,
        "MinorOperatingSystemVersion": 1,
        "MajorSubsystemVersion": 5,
        "MinorSubsystemVersion": 2,
        "SizeOfImage": f"{size} + 8192",
        "SizeOfHeaders": 1024,
        "Subsystem": 3,
        "DllCharacteristics": 0x8140,
        "SizeOfStackReserve": either(1 << 33, 1 << 20),
        "SizeOfStackCommit": either(2 << 33, 2 << 20),
        "SizeOfHeapReserve": either(3 << 33, 3 << 20),
        "SizeOfHeapCommit": either(4 << 33, 4 << 20),
        "LoaderFlags": 0,
        "NumberOfRvaAndSizes": 16,
        "SectionsNb": 2,
    }
    columns = ", ".join(f'cast({values[c]} as double) as "{c}"' for c in PE_FEATURES)
    return f"""select doc_id, true as is_pe, cast(doc_id % 3 > 0 as int) as has_resources, {columns}
from documents"""


def section_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw size and entropy of each section of executables."""
    found = corpus.section_features(S.programs(spark, sf_dir), "doc_id")
    return found.select("doc_id", "section", "raw_size", F.round("entropy", 6).alias("entropy"))


SECTION_FEATURES = f"""with entropies as ({CONTENT_ENTROPY})
select doc_id, '.text' as section, size as raw_size, entropy from entropies
union all
select doc_id, '.bss' as section, 64 as raw_size, 0.0::double as entropy from documents"""


_VECTOR = [
    "Machine", "SizeOfCode", "SectionsNb", "size", "file_size", "num_sections", "has_resources", "section_.text_size",
    "section_.text_entropy", "section_.bss_size", "section_.bss_entropy", "section_.rsrc_size", "url_count",
    "num_imports", "import_kernel32.dll", *TOKENS, "never seen there",
]


def file_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector a model of these columns would see of each executable: header, structure, sections,
    strings, imports and token counts from one read; columns that nothing measures are 0."""
    numbers = S.table(spark, sf_dir, "documents").select("doc_id").where("doc_id % 2 = 0")
    imports = numbers.select(
        F.concat(F.lit("/bin/"), "doc_id", F.lit(".exe")).alias("file"),
        F.explode(F.array(F.lit("KERNEL32.dll"), F.lit("kernel32.dll"), F.lit("ole32.dll"))).alias("dll"),
        F.lit("symbol").alias("symbol"),
    )
    found = features.file_features(S.programs(spark, sf_dir), _VECTOR, "doc_id", "path", imports=imports)
    return found.drop("path").withColumn("section_.text_entropy", F.round("`section_.text_entropy`", 6))


def _file_features_sql() -> str:
    plus, size = "doc_id % 2 = 1", "octet_length(encode(text))"
    whole = f"{size} + 64 + 64 + 24 + 2 * 40 + case when {plus} then 240 else 224 end"

    def count(token):
        return f"(length(text) - length(replace(text, '{token}', ''))) // {len(token)}"

    values = {
        "Machine": f"case when {plus} then {0x8664} else {0x14C} end", "SizeOfCode": size, "SectionsNb": 2, "size": whole,
        "file_size": whole, "num_sections": 2, "has_resources": "cast(doc_id % 3 > 0 as int)", "section_.text_size": size,
        "section_.text_entropy": "entropy", "section_.bss_size": 64, "url_count": f"{count('http://')} + {count('https://')}",
        "num_imports": "case when doc_id % 2 = 0 then 2 else 0 end",
        "import_kernel32.dll": "case when doc_id % 2 = 0 then 2 else 0 end", **{t: count(t) for t in TOKENS},
    }
    columns = ", ".join(f'cast({values.get(c, 0)} as double) as "{c}"' for c in _VECTOR)
    return f"""with entropies as ({CONTENT_ENTROPY})
select doc_id, {columns} from documents join entropies using (doc_id)"""


def import_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as an import table: orders are files, line numbers DLLs, parts symbols."""
    dlls = F.array(*[F.lit(d.upper()) for d in COMMON_DLLS], F.lit("ntdll.dll"), F.lit("gdi32.dll"), F.lit("ole32.dll"))
    imports = S.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("file"), "l_orderkey").alias("file"),
        F.element_at(dlls, F.col("l_linenumber")).alias("dll"),
        F.col("l_partkey").cast("string").alias("symbol"),
    )
    return corpus.import_features(imports).withColumnsRenamed(
        {f"import_{d}": f"import_{d.removesuffix('.dll')}" for d in COMMON_DLLS}
    )


IMPORT_FEATURES = f"""select 'file' || l_orderkey as file, count(distinct l_linenumber) as num_imports, {", ".join(
    f"count_if(l_linenumber = {i}) as import_{d.removesuffix('.dll')}" for i, d in enumerate(COMMON_DLLS, 1))}
from lineitem group by l_orderkey"""


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threat events and shown verdicts of files decided by name or as unsupported."""
    admitted = corpus.admit(S.files(spark, sf_dir)).where("allowed and valid")
    eicar = F.lower("filename") == "eicar.exe"
    verdicts = admitted.select(
        "doc_id", "filename", "length", F.lit("").alias("file_hash"),
        F.when(eicar, fixed_prediction("Malware")).otherwise(fixed_prediction("Benign")).alias("prediction"),
    )
    events = threats.scan_events(verdicts)
    shown = threats.shown_verdicts(verdicts).groupBy(F.col("filename").alias("file_name")).agg(
        F.min("prediction.lstm.probability").alias("shown_probability"),
        F.max("prediction.ensemble.final_prediction").alias("shown_verdict"),
    )
    return events.join(shown, "file_name").drop("tool", "event_type")


SCAN_EVENTS = f"""with {S.FILES}, named as (
  select length, case doc_id % 8 when 6 then 'c.bin' else split_part(path, '/', 5) end as file_name
  from files where doc_id % 8 in (0, 1, 2, 4, 5, 6) and length <= 16777216
)
select file_name, length as file_size,
  case when file_name = 'eicar.exe' then 'EICAR_TEST_FILE' else '' end as file_hash,
  case when file_name = 'eicar.exe' then 'Malware' else 'Benign' end as prediction,
  case when file_name = 'eicar.exe' then 0.98::double else 0.0::double end as confidence,
  case when file_name = 'eicar.exe' then 'high' else 'low' end as severity,
  case when file_name = 'hello.exe' then 0.6362::double else 0.0::double end as shown_probability,
  case when file_name = 'eicar.exe' then 'Malware' else 'Benign' end as shown_verdict
from named"""


def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection and file events in one log, counted."""
    connections = threats.connection_events(S.classified(spark, sf_dir), "sensor-1")
    admitted = corpus.admit(S.files(spark, sf_dir)).where("allowed and valid")
    verdicts = admitted.select(
        "filename", "length", F.lit("").alias("file_hash"),
        F.when(F.lower("filename") == "eicar.exe", fixed_prediction("Malware"))
        .otherwise(fixed_prediction("Benign"))
        .alias("prediction"),
    )
    log = threats.all_events(connections, threats.scan_events(verdicts))
    return log.groupBy("tool", "event_type", "severity").agg(
        F.count("*").alias("n"),
        F.count("attack_type").alias("with_attack"),
        F.count("file_name").alias("with_file"),
    )


MIXED_LOG = f"""with {S.CLASSIFIED}, events_ as (
  select 'NetworkTrafficClassifier' as tool, 'network_connection' as event_type, {S.SEVERITY} as severity,
    attack_type, null as file_name
  from classified
  union all
  select 'MalwareAnalysis', 'file_scan', case when doc_id % 8 = 4 then 'high' else 'low' end, null, 'f'
  from documents where doc_id % 8 in (0, 1, 2, 4, 5, 6)
)
select tool, event_type, severity, count(*) as n, count(attack_type) as with_attack, count(file_name) as with_file
from events_ group by all"""


QUERIES = {
    "file_hashes": (file_hashes, FILE_HASHES),
    "file_strings": (file_strings, FILE_STRINGS),
    "page_links": (page_links, PAGE_LINKS),
    "detected_features": (detected_features, DETECTED_FEATURES),
    "file_admission": (file_admission, FILE_ADMISSION),
    "file_details": (file_details, FILE_DETAILS),
    "expired_files": (expired_files, EXPIRED_FILES),
    "content_entropy": (content_entropy, CONTENT_ENTROPY),
    "pe_headers": (pe_headers, _pe_headers_sql()),
    "section_features": (section_features, SECTION_FEATURES),
    "file_features": (file_features, _file_features_sql()),
    "import_features": (import_features, IMPORT_FEATURES),
    "scan_events": (scan_events, SCAN_EVENTS),
    "mixed_log": (mixed_log, MIXED_LOG),
}

"""The test tables seen as packets, datasets, events, scores and files.

Each view is given twice: as a DataFrame, and as a common table expression with the
same columns for the SQL that checks the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.session import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as packets: users are sources, the number in ``props`` is the destination."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    has_ports = kind != "signup"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 16).alias("src_ip"),
        F.concat(F.lit("10.0.0."), k % 16).alias("dst_ip"),
        F.when(kind == "signup", "icmp").when(kind == "view", "udp").otherwise("tcp").alias("proto"),
        F.when(has_ports, F.col("user_id") % 4).cast("int").alias("src_port"),
        F.when(has_ports, k % 4).cast("int").alias("dst_port"),
        (F.floor("value") + 20).alias("ip_len"),
        F.when(~kind.isin("signup", "view"), F.col("event_id") % 7).cast("int").alias("urgptr"),
        ((kind == "signup") & (F.col("event_id") % 5 == 0)).alias("icmp_inner_ip"),
        kind.alias("service"),
        F.when(kind == "error", "S0").when(kind == "purchase", "REJ").otherwise("SF").alias("conn_state"),
    )


PACKETS = """packets as (
  select event_id as seq, epoch_us(ts) as us,
    '10.0.0.' || (user_id % 16) as src_ip, '10.0.0.' || (k % 16) as dst_ip,
    case event_type when 'signup' then 'icmp' when 'view' then 'udp' else 'tcp' end as proto,
    case when event_type = 'signup' then 0 else user_id % 4 end as src_port,
    case when event_type = 'signup' then 0 else k % 4 end as dst_port,
    cast(floor(value) as bigint) + 20 as ip_len,
    case when event_type in ('signup', 'view') then 0 else event_id % 7 end as urgptr,
    event_type = 'signup' and event_id % 5 = 0 as icmp_inner_ip,
    event_type as service,
    case event_type when 'error' then 'S0' when 'purchase' then 'REJ' else 'SF' end as conn_state
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)
)"""


def attack_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", "neptune")
        .when(event_type == "purchase", "portsweep")
        .when(event_type == "signup", "guess_passwd")
        .otherwise("normal")
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as classified connections."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 16).alias("src_ip"),
        F.concat_ws(
            "_",
            F.concat(F.lit("10.0.0."), (F.col("user_id") % 16).cast("string")),
            (F.col("user_id") % 4).cast("string"),
            F.lit("10.0.0.1"),
            k,
        ).alias("connection_key"),
        attack_of(F.col("event_type")).alias("attack_type"),
        "value",
    )


CLASSIFIED = """classified as (
  select event_id, ts as event_time, '10.0.0.' || (user_id % 16) as src_ip,
    '10.0.0.' || (user_id % 16) || '_' || (user_id % 4) || '_10.0.0.1_'
      || json_extract_string(props, '$.k') as connection_key,
    case event_type when 'error' then 'neptune' when 'purchase' then 'portsweep'
      when 'signup' then 'guess_passwd' else 'normal' end as attack_type,
    value
  from events
)"""

SEVERITY = """case
    when attack_type = 'normal' then 'low'
    when attack_type in ('neptune', 'smurf', 'back', 'teardrop', 'pod', 'land', 'apache2', 'udpstorm')
      then 'critical'
    when attack_type in ('ipsweep', 'portsweep', 'satan', 'probe') then 'medium'
    else 'high' end"""


def intrusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a raw intrusion dataset with its usual faults."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias(" Flow ID"),
        F.col("l_shipdate").cast("string").alias("Timestamp"),
        F.col("l_linenumber").alias("session_id"),
        F.col("l_quantity").alias("Flow Duration"),
        F.when(F.col("l_linenumber") == 7, "?").otherwise(F.col("l_linestatus")).alias("service "),
        F.col("l_extendedprice").alias("bytes"),
        F.when(F.col("l_suppkey") % 89 != 0, F.col("l_discount")).alias("rate"),
        F.when(F.col("l_partkey") % 97 == 0, float("inf")).otherwise(F.col("l_tax")).alias("ratio"),
        F.when(flag == "N", " Normal").when(flag == "R", "neptune").otherwise("satan").alias(" Label"),
    )


INTRUSIONS = """intrusions as (
  select l_quantity as "Flow Duration",
    case when l_linenumber = 7 then '?' else l_linestatus end as service,
    l_extendedprice as bytes,
    case when l_suppkey % 89 <> 0 then l_discount end as rate,
    case when l_partkey % 97 = 0 then cast('Infinity' as double) else l_tax end as ratio,
    case l_returnflag when 'N' then ' Normal' when 'R' then 'neptune' else 'satan' end as label
  from lineitem
), clean as (
  select * from intrusions
  where rate is not null and not isinf(ratio) and service <> '?'
)"""


def executables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a malware feature table: a name, numbers, a constant and a label."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("Name"),
        F.col("l_quantity").alias("SizeOfCode"),
        F.col("l_extendedprice").alias("ImageBase"),
        F.when(F.col("l_suppkey") % 89 != 0, F.col("l_discount")).alias("Entropy"),
        F.when(F.col("l_partkey") % 97 == 0, float("-inf")).otherwise(F.col("l_tax")).alias("Ratio"),
        (F.col("l_linenumber") * 2).alias("SectionsNb"),
        F.when(F.col("l_linenumber") == 7, "-").otherwise(F.col("l_linestatus")).alias("packer"),
        F.lit(0).alias("LoaderFlags"),
        (F.col("l_returnflag") == "R").cast("int").alias("Malware"),
    )


EXECUTABLES = """executables as (
  select l_orderkey || '-' || l_linenumber as "Name", l_quantity as SizeOfCode,
    l_extendedprice as ImageBase,
    case when l_suppkey % 89 <> 0 then l_discount end as Entropy,
    case when l_partkey % 97 = 0 then cast('-Infinity' as double) else l_tax end as Ratio,
    l_linenumber * 2 as SectionsNb,
    case when l_linenumber = 7 then '-' else l_linestatus end as packer,
    0 as LoaderFlags, cast(l_returnflag = 'R' as int) as Malware
  from lineitem
), clean as (
  select * from executables where Entropy is not null and not isinf(Ratio) and packer <> '-'
)"""


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as connection records with some of the traffic features."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("protocol_type"),
        F.when(F.col("l_suppkey") % 89 != 0, F.col("l_extendedprice")).alias("src_bytes"),
        F.when(F.col("l_partkey") % 97 == 0, float("inf")).otherwise(F.col("l_tax")).alias("serror_rate"),
        F.col("l_quantity").alias("duration"),
        F.col("l_discount").alias("same_srv_rate"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("attack_type"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` with ``documents``: toxicity as truth, low quality as prediction, length as score."""
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id").select(
        "doc_id",
        F.col("toxic").cast("int").alias("truth"),
        (1 - F.col("quality")).cast("int").alias("predicted"),
        F.col("n_chars").cast("double").alias("score"),
    )


SCORED = """scored as (
  select l.doc_id, l.toxic as truth, 1 - l.quality as predicted, cast(d.n_chars as double) as score
  from labels l join documents d on l.doc_id = d.doc_id
)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a many-class prediction: line number against quantity."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("class"), F.col("l_linenumber")).alias("truth"),
        F.concat(F.lit("class"), (F.col("l_quantity") % 9).cast("int")).alias("predicted"),
    )


ACTIONS = """actions as (
  select 'class' || l_linenumber as truth, 'class' || cast(l_quantity % 9 as int) as predicted
  from lineitem
)"""

# Names the file view cycles through.
FILE_NAMES = ["setup.exe", "lib.DLL", "driver.sys", "notes.TXT", "eicar.exe", "hello.exe", "a b/c?.bin", "README"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: the text is the content, the number picks a name."""
    names = F.array(*[F.lit(n) for n in FILE_NAMES])
    body = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select(
        F.concat(
            F.lit("/data/"), "source", F.lit("/"), "doc_id", F.lit("/"),
            F.element_at(names, (F.col("doc_id") % len(FILE_NAMES)).cast("int") + 1),
        ).alias("path"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(n_chars % 100 as int), 0, 0)").alias(
            "modificationTime"
        ),
        F.length(body).cast("bigint").alias("length"),
        body.alias("content"),
        "doc_id",
    )


FILES = """files as (
  select '/data/' || source || '/' || doc_id || '/' || (['setup.exe', 'lib.DLL', 'driver.sys',
      'notes.TXT', 'eicar.exe', 'hello.exe', 'a b/c?.bin', 'README'])[doc_id % 8 + 1] as path,
    timestamp '2024-01-01 00:00:00' + to_hours(cast(n_chars % 100 as int)) as modified,
    octet_length(encode(text)) as length, text, doc_id
  from documents
)"""


def little_endian(value: Column, size: int) -> Column:
    """Hex text of an integer, lowest byte first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as PE files: header fields from the columns, the text as two sections.

    Even ids become PE32, odd ids PE32+. The first section holds the text, the second
    64 zero bytes. The files are written to a table once, as a corpus would be stored.
    """
    plus = F.col("doc_id") % 2 == 1
    body = F.hex(F.encode("text", "UTF-8"))
    size = F.length(F.encode("text", "UTF-8"))
    optional = F.when(plus, 240).otherwise(224)
    data_at = F.lit(64 + 24) + optional + 2 * 40

    def le(value, width):
        return little_endian(F.lit(value) if isinstance(value, int) else value, width)

    def zeros(n):
        return F.lit("00" * n)

    dos = F.concat(F.lit("4D5A"), zeros(58), le(64, 4))
    coff = F.concat(
        F.lit("50450000"),
        F.when(plus, le(0x8664, 2)).otherwise(le(0x14C, 2)),
        le(2, 2),
        zeros(12),
        le(optional, 2),
        le(0x102, 2),
    )
    common = F.concat(
        F.when(plus, le(0x20B, 2)).otherwise(le(0x10B, 2)),
        le(14, 1),
        le(F.col("doc_id") % 100, 1),
        le(size, 4),
        le(64, 4),
        le(0, 4),
        le(F.col("doc_id") + 4096, 4),
        le(4096, 4),
    )
    base = F.when(plus, le((F.col("doc_id") + 1) * (1 << 40), 8)).otherwise(
        F.concat(le(8192, 4), le(F.col("doc_id") + (1 << 22), 4))
    )
    middle = F.concat(
        le(4096, 4), le(512, 4), le(6, 2), le(1, 2), zeros(4), le(5, 2), le(2, 2), zeros(4),
        le(size + 8192, 4), le(1024, 4), zeros(4), le(3, 2), le(0x8140, 2),
    )
    wide = F.concat(*[le(F.lit(n) * (1 << 33), 8) for n in (1, 2, 3, 4)])
    narrow = F.concat(*[le(n << 20, 4) for n in (1, 2, 3, 4)])
    directories = F.concat(
        le(0, 4), le(16, 4), zeros(16), le(12288, 4), le(F.col("doc_id") % 3, 4), zeros(13 * 8)
    )
    table_rows = F.concat(
        F.lit("2E74657874000000"), le(size, 4), le(4096, 4), le(size, 4), le(data_at, 4), zeros(16),
        F.lit("2E62737300000000"), le(64, 4), le(8192, 4), le(64, 4), le(data_at + size, 4), zeros(16),
    )
    image = F.concat(
        dos, coff, common, base, middle, F.when(plus, wide).otherwise(narrow), directories,
        table_rows, body, zeros(64),
    )
    built = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/bin/"), "doc_id", F.lit(".exe")).alias("path"),
        F.unhex(image).alias("content"),
        (data_at + size + 64).cast("bigint").alias("length"),
        F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
    )
    stored = new_folder(spark, "programs")
    built.write.parquet(stored)
    return spark.read.parquet(stored)


VECTOR_SIZE = 64
VECTOR_COLUMNS = [f"f{i}" for i in range(VECTOR_SIZE)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as feature rows: class names, and label 0 as the malware minority."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("attack"), "label").alias("attack_type"),
        (F.col("label") == 0).cast("int").alias("malware"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(VECTOR_COLUMNS)],
    )

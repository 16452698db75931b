"""Dataset reading, cleaning, encoding, scaling and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.catalog import standins as S
from threatloom.fixed_values import NSL_KDD_COLUMNS, TRAFFIC_FEATURES
from threatloom.functions.labels import clamp_label, distinct_values
from threatloom.operators import profile, quality
from threatloom.operators.encode import class_mapping, decode_classes, standardise
from threatloom.operators.split import random_sample, stratified_split
from threatloom.plans.preprocess import (
    clean_malware,
    clean_network,
    encode_network,
    prepare_training,
    preprocess_network,
)
from threatloom.session import new_folder
from threatloom.sources.datasets import read_cic_ids, read_csv, read_nsl_kdd, read_unsw_nb15
from threatloom.sources.files import read_summaries, summary_overview
from threatloom.sources.sinks import write_csv, write_summary


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), 6) for c in columns})


def _kdd_columns() -> tuple[list, str]:
    """Values for the 43 columns from ``lineitem``, as Spark columns and as SQL."""
    measured = {
        "duration": (F.col("l_quantity").cast("bigint"), "cast(l_quantity as bigint)"),
        "protocol_type": (F.col("l_linestatus"), "l_linestatus"),
        "service": (F.col("l_returnflag"), "l_returnflag"),
        "flag": (F.lit("SF"), "'SF'"),
        "src_bytes": (F.col("l_partkey"), "l_partkey"),
        "dst_bytes": (F.col("l_suppkey"), "l_suppkey"),
        "serror_rate": (F.col("l_discount"), "l_discount"),
        "same_srv_rate": (F.col("l_tax"), "l_tax"),
        "attack_type": (
            F.when(F.col("l_returnflag") == "N", "normal").otherwise("neptune"),
            "case when l_returnflag = 'N' then 'normal' else 'neptune' end",
        ),
        "difficulty": (F.lit(21), "21"),
    }
    columns, sql = [], []
    for i, (name, _) in enumerate(NSL_KDD_COLUMNS):
        column, text = measured.get(name, ((F.col("l_linenumber") * i), f"l_linenumber * {i}"))
        columns.append(column.alias(name))
        if name != "difficulty":
            sql.append(f'{text} as "{name}"')
    return columns, ", ".join(sql)


def nsl_kdd_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headerless 43-column file, written and read by its fixed schema."""
    columns, _ = _kdd_columns()
    path = new_folder(spark, "nsl-kdd")
    S.table(spark, sf_dir, "lineitem").select(*columns).write.csv(path)
    read = read_nsl_kdd(spark, path)
    return read.groupBy("attack_type", "protocol_type", "service", "flag").agg(
        F.count("*").alias("n"),
        *[
            F.round(F.sum(F.col(c).cast("decimal(18,4)")).cast("double"), 2).alias(f"sum_{c}")
            for c in TRAFFIC_FEATURES
        ],
    )


NSL_KDD_SCAN_COLUMNS = ", ".join(
    f'round(cast(sum(cast("{c}" as decimal(18,4))) as double), 2) as sum_{c}' for c in TRAFFIC_FEATURES
)


def _nsl_kdd_sql() -> str:
    measured = {
        "duration": "cast(l_quantity as bigint)", "protocol_type": "l_linestatus",
        "service": "l_returnflag", "flag": "'SF'", "src_bytes": "l_partkey", "dst_bytes": "l_suppkey",
        "serror_rate": "l_discount", "same_srv_rate": "l_tax",
        "attack_type": "case when l_returnflag = 'N' then 'normal' else 'neptune' end",
    }
    columns = ", ".join(
        f'{measured.get(name, f"l_linenumber * {i}")} as "{name}"'
        for i, (name, _) in enumerate(NSL_KDD_COLUMNS)
        if name != "difficulty"
    )
    return f"""with kdd as (select {columns} from lineitem)
select attack_type, protocol_type, service, flag, count(*) as n, {NSL_KDD_SCAN_COLUMNS}
from kdd group by all"""


def cic_ids_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with a header of odd names, its types found from the values."""
    path = new_folder(spark, "cic-ids")
    write_csv(S.intrusions(spark, sf_dir), path)
    read = read_cic_ids(spark, path)
    return read.select(
        F.col("` Flow ID`").alias("flow_id"),
        F.col("Flow Duration").alias("flow_duration"),
        F.col("`service `").alias("service"),
        "bytes",
        "rate",
        F.when(F.abs("ratio") == float("inf"), None).otherwise(F.col("ratio")).alias("finite_ratio"),
        F.trim("attack_type").alias("attack_type"),
    )


CIC_IDS_SCAN = """select l_orderkey as flow_id, l_quantity as flow_duration,
  case when l_linenumber = 7 then '?' else l_linestatus end as service, l_extendedprice as bytes,
  case when l_suppkey % 89 <> 0 then l_discount end as rate,
  case when l_partkey % 97 <> 0 then l_tax end as finite_ratio,
  case l_returnflag when 'N' then 'Normal' when 'R' then 'neptune' else 'satan' end as attack_type
from lineitem"""


def unsw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attack category is the label even where a 0/1 ``label`` follows it."""
    path = new_folder(spark, "unsw")
    flag = F.col("l_returnflag")
    raw = S.table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("int").alias("sload"),
        F.when(flag == "N", "Normal").when(flag == "R", "Fuzzers").otherwise("Exploits").alias("attack_cat"),
        (flag != "N").cast("int").alias("label"),
    )
    write_csv(raw, path)
    return profile.class_distribution(read_unsw_nb15(spark, path), "attack_type").withColumn(
        "percent", F.round("percent", 6)
    )


UNSW_SCAN = """select case l_returnflag when 'N' then 'Normal' when 'R' then 'Fuzzers' else 'Exploits' end
  as attack_type, count(*) as n, round(count(*) / sum(count(*)) over () * 100, 6) as percent
from lineitem group by 1"""


def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose header names a column twice."""
    path = new_folder(spark, "repeated")
    item = S.table(spark, sf_dir, "lineitem")
    rows = F.concat_ws(",", "l_quantity", "l_tax", "l_returnflag")
    texts = item.select(rows.alias("value"))
    header = spark.createDataFrame([("rate,rate,kind",)], "value string")
    # Every file of a folder has the header; here each task writes its rows below one.
    texts.write.text(f"{path}/body")
    header.coalesce(1).write.text(f"{path}/head")
    names = read_csv(spark, f"{path}/head").columns
    body = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(f"{path}/body")
    return body.groupBy("kind").agg(
        F.sum(F.col("`rate`").cast("decimal(18,2)")).cast("double").alias("first_rate"),
        F.sum(F.col("`rate.1`").cast("decimal(18,2)")).cast("double").alias("second_rate"),
    )


REPEATED_HEADERS = """select l_returnflag as kind,
  cast(sum(cast(l_quantity as decimal(18,2))) as double) as first_rate,
  cast(sum(cast(l_tax as decimal(18,2))) as double) as second_rate
from lineitem group by 1"""

CLEAN_NAMES = {"Flow Duration": "flow_duration", "service": "service", "bytes": "bytes", "rate": "rate", "ratio": "ratio", "Label": "label"}


def intrusion_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers trimmed, identifier and time columns out, invalid rows out."""
    clean, _, _ = clean_network(S.intrusions(spark, sf_dir))
    return clean.withColumnsRenamed(CLEAN_NAMES)


INTRUSION_CLEAN = f"""with {S.INTRUSIONS}
select "Flow Duration" as flow_duration, service, bytes, rate, ratio, label from clean"""


def intrusion_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary label and alphabetical codes of the service."""
    clean, label, _ = clean_network(S.intrusions(spark, sf_dir))
    return encode_network(clean, label).withColumnsRenamed(CLEAN_NAMES)


INTRUSION_ENCODED = f"""with {S.INTRUSIONS}
select "Flow Duration" as flow_duration,
  cast(dense_rank() over (order by service) - 1 as bigint) as service, bytes, rate, ratio,
  cast(not (lower(label) like '%normal%' or lower(label) like '%benign%') as int) as y
from clean"""


def intrusion_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation: scaled features and the binary label."""
    prepared = preprocess_network(S.intrusions(spark, sf_dir), "CICIDS2017")
    return _rounded(prepared.data, prepared.features).withColumnsRenamed(CLEAN_NAMES)


INTRUSION_SCALED = f"""with {S.INTRUSIONS}, coded as (
  select "Flow Duration" as flow_duration,
    dense_rank() over (order by service) - 1 as service, bytes, rate, ratio,
    cast(not (lower(label) like '%normal%' or lower(label) like '%benign%') as int) as y
  from clean
)
select y, {", ".join(f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}"
    for c in ("flow_duration", "service", "bytes", "rate", "ratio"))}
from coded"""


def intrusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary, written as JSON and read back into the overview of expected ones."""
    prepared = preprocess_network(S.intrusions(spark, sf_dir), "CICIDS2017")
    path = new_folder(spark, "summary")
    write_summary(prepared.summary_frame(), path)
    return summary_overview(read_summaries(spark, {"cicids_summary": path}))


INTRUSION_SUMMARY = f"""with {S.INTRUSIONS}, done as (
  select (select count(*) from intrusions) as rows_before, (select count(*) from clean) as rows_after
), expected as (
  select * from (values (0, 'malware_summary', 'MALWARE'), (1, 'dataset_test_summary', 'DATASET_TEST'),
    (2, 'cicids_summary', 'CICIDS2017'), (3, 'nslkdd_summary', 'NSLKDD'), (4, 'unsw_summary', 'UNSW'))
    as t(position, stem, dataset_name)
)
select position, stem, dataset_name, case when position = 2 then 'Completed' else 'Missing' end as status,
  case when position = 2 then rows_before end as rows_before,
  case when position = 2 then rows_after end as rows_after,
  case when position = 2 then rows_before - rows_after end as invalid_records_removed,
  case when position = 2 then 5 end as features_used
from expected, done"""


def invalid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid cells per column of the raw malware table."""
    return profile.invalid_cells_by_column(S.executables(spark, sf_dir))


INVALID_CELLS = f"""with {S.EXECUTABLES}, counts as (
  select 0 as "Name", 0 as SizeOfCode, 0 as ImageBase, count_if(Entropy is null) as Entropy,
    count_if(isinf(Ratio)) as Ratio, 0 as SectionsNb, count_if(packer = '-') as packer,
    0 as LoaderFlags, 0 as Malware
  from executables
)
select column_name, cast(invalid_cells as bigint) as invalid_cells
from (unpivot counts on columns(*) into name column_name value invalid_cells)"""


def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_cells(S.executables(spark, sf_dir))


MISSING_CELLS = f"""with {S.EXECUTABLES}
select count_if(Entropy is null) as missing_cells from executables"""


def malware_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows; identifier, text and constant columns out."""
    clean, _, _ = clean_malware(S.executables(spark, sf_dir))
    return clean


MALWARE_CLEAN = f"""with {S.EXECUTABLES}
select SizeOfCode, ImageBase, Entropy, Ratio, cast(SectionsNb as double) as SectionsNb, Malware as malware
from clean"""


def malware_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cleaning dropped: rows and columns."""
    raw = S.executables(spark, sf_dir)
    _, dropped, label_added = clean_malware(raw)
    return profile.cleaning_counts(raw).withColumns(
        {"dropped_columns": F.lit(",".join(dropped)), "label_added": F.lit(label_added)}
    )


MALWARE_CLEANING = f"""with {S.EXECUTABLES}
select (select count(*) from executables) as rows_before, (select count(*) from clean) as rows_after,
  (select count(*) from executables) - (select count(*) from clean) as invalid_records_removed,
  'Name,packer' || (select case when min(LoaderFlags) = max(LoaderFlags) then ',LoaderFlags' else '' end
    from clean) as dropped_columns,
  false as label_added"""

MALWARE_FEATURES = ["SizeOfCode", "ImageBase", "Entropy", "Ratio", "SectionsNb"]


def malware_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, _, _ = clean_malware(S.executables(spark, sf_dir))
    return _rounded(standardise(clean, MALWARE_FEATURES), MALWARE_FEATURES)


MALWARE_SCALED = f"""with {S.EXECUTABLES}
select Malware as malware, {", ".join(
    f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}" for c in MALWARE_FEATURES)}
from clean"""


def malware_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, _ = quality.with_malware_label(S.executables(spark, sf_dir))
    found = profile.dataset_profile(raw, "malware", "Name")
    return found.withColumn("imbalance_ratio", F.round("imbalance_ratio", 6))


MALWARE_PROFILE = f"""with {S.EXECUTABLES}
select 7::bigint as total_features, 7::bigint as api_calls, count(*) as samples,
  cast(sum(Malware) as bigint) as malware_count, cast(count(*) - sum(Malware) as bigint) as benign_count,
  round(sum(Malware) / count(*), 6) as imbalance_ratio
from executables"""


def malware_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test table without a label, aligned to training columns it lacks in part."""
    raw = S.executables(spark, sf_dir).drop("Malware", "ImageBase")
    clean, _, added = clean_malware(raw, "test")
    training = ["Entropy", "ImageBase", "SizeOfCode", "Checksum"]
    aligned, missing, extra = quality.align(clean, training, "malware")
    return aligned.groupBy("malware").agg(
        F.count("*").alias("n"),
        *[F.round(F.sum(F.col(c).cast("decimal(18,4)")).cast("double"), 2).alias(c) for c in training],
    ).withColumns(
        {
            "missing": F.lit(",".join(missing)),
            "extra": F.lit(",".join(extra)),
            "label_added": F.lit(added),
        }
    )


MALWARE_ALIGNMENT = f"""with {S.EXECUTABLES}
select 0 as malware, count(*) as n, round(cast(sum(cast(Entropy as decimal(18,4))) as double), 2) as Entropy,
  0.0::double as ImageBase, round(cast(sum(cast(SizeOfCode as decimal(18,4))) as double), 2) as SizeOfCode,
  0.0::double as Checksum, 'ImageBase,Checksum' as missing, 'Ratio,SectionsNb,LoaderFlags' as extra,
  true as label_added
from clean"""


def feature_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature sets that differ: parts by supplier among returned and among open items."""
    item = S.table(spark, sf_dir, "lineitem")
    feature = F.concat_ws("-", "l_partkey", "l_suppkey").alias("feature")
    training = item.where("l_returnflag = 'R'").select(feature)
    present = item.where("l_linestatus = 'O'").select(feature)
    return quality.feature_set_difference(training, present)


FEATURE_DIFFERENCES = """with training as (
  select distinct l_partkey || '-' || l_suppkey as feature from lineitem where l_returnflag = 'R'
), present as (
  select distinct l_partkey || '-' || l_suppkey as feature from lineitem where l_linestatus = 'O'
)
select feature, 'missing' as status from (select * from training except select * from present)
union all
select feature, 'extra' as status from (select * from present except select * from training)"""


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic features zero-filled, classes of one row out."""
    return prepare_training(S.connections(spark, sf_dir))


TRAINING_ROWS = """with connections as (
  select l_quantity as duration, case when l_suppkey % 89 <> 0 then l_extendedprice else 0 end as src_bytes,
    case when l_partkey % 97 = 0 then 0 else l_tax end as serror_rate, l_discount as same_srv_rate,
    l_partkey || '-' || l_suppkey as attack_type
  from lineitem
)
select * from connections
where attack_type in (select attack_type from connections group by 1 having count(*) >= 2)"""


def clamped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers above three as a 0/1 label."""
    item = S.table(spark, sf_dir, "lineitem")
    return item.groupBy(clamp_label(F.col("l_linenumber") - 3).alias("label")).agg(F.count("*").alias("n"))


CLAMPED_LABELS = """select cast(l_linenumber - 3 > 0 as int) as label, count(*) as n
from lineitem group by 1"""


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(S.classified(spark, sf_dir), "attack_type")


LABEL_VALUES = f"with {S.CLASSIFIED} select distinct attack_type from classified"


def class_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and name of each class, of which there are many."""
    return class_mapping(S.connections(spark, sf_dir), "attack_type")


CLASS_CODES = """select row_number() over (order by attack_type) - 1 as encoded_value,
  attack_type as original_label
from (select distinct l_partkey || '-' || l_suppkey as attack_type from lineitem)"""


def decoded_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names for codes."""
    events = S.classified(spark, sf_dir)
    mapping = class_mapping(events, "attack_type")
    coded = events.select("event_id", (F.col("event_id") % 4).alias("code"))
    return decode_classes(coded, mapping, "code", "attack_type")


DECODED_CLASSES = f"""with {S.CLASSIFIED}, mapping as (
  select row_number() over (order by attack_type) - 1 as code, attack_type
  from (select distinct attack_type from classified)
)
select event_id, event_id % 4 as code, m.attack_type
from events join mapping m on event_id % 4 = m.code"""


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly a fifth of each class for testing."""
    return stratified_split(S.classified(spark, sf_dir), "attack_type", "event_id").select(
        "event_id", "attack_type", "is_test"
    )


TRAIN_TEST_SPLIT = f"""with {S.CLASSIFIED}
select event_id, attack_type,
  row_number() over (partition by attack_type order by md5('42|' || event_id), event_id)
    <= floor(count(*) over (partition by attack_type) * 0.2 + 0.5) as is_test
from classified"""


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows at random, the same on every run."""
    return random_sample(S.classified(spark, sf_dir), "event_id").select(
        "event_id", "attack_type", "connection_key"
    )


SAMPLE_ROWS = f"""with {S.CLASSIFIED}
select event_id, attack_type, connection_key from classified
order by md5('42|' || event_id), event_id limit 20"""


QUERIES = {
    "nsl_kdd_scan": (nsl_kdd_scan, _nsl_kdd_sql()),
    "cic_ids_scan": (cic_ids_scan, CIC_IDS_SCAN),
    "unsw_scan": (unsw_scan, UNSW_SCAN),
    "repeated_headers": (repeated_headers, REPEATED_HEADERS),
    "intrusion_clean": (intrusion_clean, INTRUSION_CLEAN),
    "intrusion_encoded": (intrusion_encoded, INTRUSION_ENCODED),
    "intrusion_scaled": (intrusion_scaled, INTRUSION_SCALED),
    "intrusion_summary": (intrusion_summary, INTRUSION_SUMMARY),
    "invalid_cells": (invalid_cells, INVALID_CELLS),
    "missing_cells": (missing_cells, MISSING_CELLS),
    "malware_clean": (malware_clean, MALWARE_CLEAN),
    "malware_cleaning": (malware_cleaning, MALWARE_CLEANING),
    "malware_scaled": (malware_scaled, MALWARE_SCALED),
    "malware_profile": (malware_profile, MALWARE_PROFILE),
    "malware_alignment": (malware_alignment, MALWARE_ALIGNMENT),
    "feature_differences": (feature_differences, FEATURE_DIFFERENCES),
    "training_rows": (training_rows, TRAINING_ROWS),
    "clamped_labels": (clamped_labels, CLAMPED_LABELS),
    "label_values": (label_values, LABEL_VALUES),
    "class_codes": (class_codes, CLASS_CODES),
    "decoded_classes": (decoded_classes, DECODED_CLASSES),
    "train_test_split": (train_test_split, TRAIN_TEST_SPLIT),
    "sample_rows": (sample_rows, SAMPLE_ROWS),
}

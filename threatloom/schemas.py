"""Schemas pinned per source, so that no scan infers types."""

from __future__ import annotations

from threatloom.fixed_values import FLOW_EXPORT_COLUMNS, NSL_KDD_COLUMNS, TRAFFIC_FEATURES

NSL_KDD = ", ".join(f"`{name}` {dtype}" for name, dtype in NSL_KDD_COLUMNS)

PACKETS = (
    "seq bigint, ts timestamp, src_ip string, dst_ip string, proto string, src_port int, "
    "dst_port int, ip_len bigint, urgptr int, icmp_inner_ip boolean, service string, "
    "conn_state string"
)

_FLOW_TYPES = {"duration": "double", "bytes_sent_src_to_dst": "bigint", "bytes_sent_dst_to_src": "bigint"}


def _flow_type(name: str) -> str:
    return _FLOW_TYPES.get(name, "double" if name.endswith("_rate") else "int")


FLOW_EXPORT = ", ".join(f"`{c}` {_flow_type(c)}" for c in FLOW_EXPORT_COLUMNS) + ", connection_key string"
FLOW_POSITIONAL_NAMES = [*TRAFFIC_FEATURES, "connection_key"]

THREAT_EVENT = (
    "`@timestamp` string, `timestamp` string, tool string, event_type string, severity string, "
    "confidence double, host_name string, attack_type string, connection_key string, model string, "
    "model_version string, file_name string, file_size bigint, file_hash string, prediction string"
)

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
IMPORT_TABLE = "file string, dll string, symbol string"

DATASET_SUMMARY = (
    "dataset_name string, rows_before bigint, rows_after bigint, invalid_records_removed bigint, "
    "features_used int, features_discarded int, dropped_columns array<string>, pca_components int, "
    "pca_variance_target double, pca_variance_retained double, pca_model_path string, "
    "pca_scaler_path string, raw_feature_columns_path string, preprocessing_status string, "
    "source_path string, output_path string, mode string, label_added boolean, "
    "missing_features_filled array<string>, extra_features_dropped array<string>, rejected_records bigint"
)

MODEL_VERDICT = "struct<prediction:string,probability:double,confidence:double>"
ENSEMBLE_VERDICT = (
    "struct<prediction:string,probability:double,confidence:double,final_prediction:string>"
)
PREDICTION = f"random_forest {MODEL_VERDICT}, lstm {MODEL_VERDICT}, ensemble {ENSEMBLE_VERDICT}"

"""Packets to classified connections to threat events."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.fixed_values import FLOW_EXPORT_COLUMNS, TRAFFIC_FEATURES
from threatloom.operators import flows, threats
from threatloom.operators.models import score_traffic
from threatloom.operators.profile import class_distribution
from threatloom.session import shared_folder


def model_features(flow_export: DataFrame, *keep: str) -> DataFrame:
    """Exported flows under the model's feature names."""
    return flow_export.select(
        *[F.col(a).alias(b) for a, b in zip(FLOW_EXPORT_COLUMNS, TRAFFIC_FEATURES)],
        "connection_key",
        *keep,
    )


def packets_to_features(
    packets: DataFrame, traffic_features: str = "reference", batch: list[str] | None = None
) -> DataFrame:
    """One row of model features per connection.

    ``traffic_features="reference"`` writes the constants of the flow export for
    unmeasured features; ``"kdd"`` measures the traffic counts over recent
    connections instead, and needs ``service`` and ``conn_state`` per packet.
    """
    connections = flows.connection_flows(packets, batch)
    extra = batch or []
    if traffic_features == "reference":
        return model_features(flows.flow_export(connections, *extra), *extra)
    if traffic_features != "kdd":
        raise ValueError("traffic_features is 'reference' or 'kdd'")
    keys = [*extra, *flows.CONNECTION]
    first = (
        flows.ip_packets(packets)
        .groupBy(*keys)
        .agg(
            F.min("seq").alias("seq"),
            F.min_by("ts", "seq").alias("ts"),
            F.min_by("service", "seq").alias("service"),
            F.max_by("conn_state", "seq").alias("conn_state"),
        )
    )
    # Both windows read the connections several times.
    shared_folder(packets.sparkSession)
    first = first.checkpoint()
    measured = flows.time_window_features(flows.host_window_features(first))
    joined = connections.join(measured, keys)
    return model_features(flows.flow_export(joined, *extra), *extra)


def classify(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Features with ``attack_type`` (class names, not codes) and ``confidence``."""
    return score_traffic(features, model).withColumnRenamed("predicted_attack", "attack_type")


def threat_events(
    classified: DataFrame, host_name: str, model_confidence: bool = True, version: str = "v1.0", keep: tuple[str, ...] = ()
) -> DataFrame:
    """An event per classified connection, with the columns ``keep`` beside it."""
    confidence: Column | None = F.col("confidence") if model_confidence else None
    return threats.connection_events(classified, host_name, confidence=confidence, version=version, keep=keep)


def summary(classified: DataFrame) -> DataFrame:
    """Connections and share per class."""
    return class_distribution(classified, "attack_type")

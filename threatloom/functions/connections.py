"""Ports, keys and flags of connections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def port_or_zero(proto: Column, port: Column) -> Column:
    """TCP and UDP ports; other protocols have none and read as 0."""
    return F.coalesce(F.when(proto.isin("tcp", "udp"), port), F.lit(0))


def connection_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    return F.concat_ws(
        "_", src_ip, src_port.cast("string"), dst_ip, dst_port.cast("string")
    )


def split_connection_key(key: Column) -> Column:
    """The key's four parts; a part that is missing or no number is null."""
    parts = F.split(key, "_")
    return F.struct(
        F.get(parts, F.lit(0)).alias("src_ip"),
        F.get(parts, F.lit(1)).try_cast("int").alias("src_port"),
        F.get(parts, F.lit(2)).alias("dst_ip"),
        F.get(parts, F.lit(3)).try_cast("int").alias("dst_port"),
    )


def land(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """1 where both ends are the same address and port."""
    return ((src_ip == dst_ip) & (src_port == dst_port)).cast("int")

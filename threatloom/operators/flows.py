"""Packets to connections, and traffic counts over recent connections."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.fixed_values import (
    FLOW_CONSTANT_ONES,
    FLOW_EXPORT_COLUMNS,
    FLOW_EXPORT_HEAD,
    PACKET_BATCH,
)
from threatloom.functions.connections import connection_key, land, port_or_zero
from threatloom.operators.ranking import row_numbers, running_sums
from threatloom.session import shared_folder

CONNECTION = ["src_ip", "src_port", "dst_ip", "dst_port"]


def ip_packets(packets: DataFrame) -> DataFrame:
    """Packets with an IP layer, ports resolved."""
    return packets.where(F.col("src_ip").isNotNull()).withColumns(
        {
            "src_port": port_or_zero(F.col("proto"), F.col("src_port")),
            "dst_port": port_or_zero(F.col("proto"), F.col("dst_port")),
        }
    )


def _after_first(hit: Column) -> Column:
    """Hits among all packets of a connection but its first."""
    return F.count_if(hit) - F.coalesce(F.min_by(hit, "seq").cast("bigint"), F.lit(0))


def connection_flows(packets: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """One row per directional connection, in order of arrival ``seq``.

    Every aggregate has a partial form, so each task first reduces its packets to one
    row per connection; a connection that holds a third of all packets costs no more
    to shuffle than any other.

    Bytes to the source count the first packet always and later ones only for
    connections of a host with itself; fragment and urgent counters skip the first
    packet; TCP and UDP packets with the same ends are one connection.
    """
    keys = [*(batch or []), *CONNECTION]
    hit_fragment = F.coalesce(F.col("icmp_inner_ip"), F.lit(False))
    hit_urgent = (F.col("proto") == "tcp") & (F.coalesce(F.col("urgptr"), F.lit(0)) != 0)
    # Arrival times as whole microseconds: fixed-width buffers keep the aggregation hashed.
    micros = F.unix_micros(F.col("ts"))
    grouped = (
        ip_packets(packets)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("packet_count"),
            ((F.max_by(micros, "seq") - F.min_by(micros, "seq")) / 1000000).alias("duration"),
            F.sum("ip_len").cast("bigint").alias("bytes_sent_src_to_dst"),
            F.min_by("ip_len", "seq").cast("bigint").alias("__first_bytes"),
            _after_first(hit_fragment).alias("wrong_fragments"),
            _after_first(hit_urgent).alias("urgent_packets"),
        )
    )
    back = F.when(F.col("src_ip") == F.col("dst_ip"), F.col("bytes_sent_src_to_dst"))
    return grouped.select(
        *keys,
        "packet_count",
        "duration",
        "bytes_sent_src_to_dst",
        F.coalesce(back, F.col("__first_bytes")).alias("bytes_sent_dst_to_src"),
        land(*[F.col(c) for c in CONNECTION]).alias("land"),
        "wrong_fragments",
        "urgent_packets",
        connection_key(*[F.col(c) for c in CONNECTION]).alias("connection_key"),
    )


def flow_export(flows: DataFrame, *extra: str) -> DataFrame:
    """Flows in the column order of the feature file; unmeasured features are constants."""
    constants = [
        F.lit(1 if c in FLOW_CONSTANT_ONES else 0).alias(c)
        for c in FLOW_EXPORT_COLUMNS[len(FLOW_EXPORT_HEAD) :]
        if c not in flows.columns
    ]
    measured = [c for c in FLOW_EXPORT_COLUMNS[len(FLOW_EXPORT_HEAD) :] if c in flows.columns]
    wide = flows.select(*FLOW_EXPORT_HEAD, *measured, *constants, "connection_key", *extra)
    return wide.select(*FLOW_EXPORT_COLUMNS, "connection_key", *extra)


def packet_batches(packets: DataFrame, size: int = PACKET_BATCH) -> DataFrame:
    """Add ``batch_id``: units of ``size`` packets in order of arrival; an unfilled last unit goes."""
    numbered = row_numbers(packets, [], F.col("seq"), "__row")
    full = packets.count() // size
    return (
        numbered.withColumn("batch_id", F.floor((F.col("__row") - 1) / size))
        .where(F.col("batch_id") < full)
        .drop("__row")
    )


def _floor_div(value: Column, step: int) -> Column:
    """Whole quotient, exact for large values."""
    return ((value - F.pmod(value, F.lit(step))) / step).cast("bigint")


def _recent_sums(
    counts: DataFrame, keys: list[str], names: dict[str, str], width: int, blocks: int | None
) -> DataFrame:
    """Per key and time the sums over the last ``width`` microseconds, the ends of the span included.

    A sum over a span is the difference of two running totals: the one at the row's time and the
    one just before the span. Rows ask for the latter with a mark at the span's beginning, so one
    pass over the times of a key answers both. Running totals are cut into blocks of about equal
    numbers of rows, whatever their key; a key with most of all rows is as many tasks as its blocks.
    """
    per_time = counts.groupBy(*keys, "__t").agg(*[F.sum(v).alias(v) for v in names])
    # Times as even numbers and marks just before them: a mark comes before the rows of its own time.
    now = F.struct((F.col("__t") * 2).alias("__at"), F.lit(1).alias("__sign"))
    before = F.struct(((F.col("__t") - width) * 2 - 1).alias("__at"), F.lit(-1).alias("__sign"))
    steps = per_time.withColumn("__step", F.explode(F.array(now, before))).select("*", "__step.*").drop("__step")
    entering = {v: F.when(F.col("__sign") == 1, F.col(v)).otherwise(0) for v in names}
    totals = running_sums(steps, keys, F.col("__at"), {f"__upto{v}": entering[v] for v in names}, blocks=blocks)
    return totals.groupBy(*keys, "__t").agg(
        *[F.sum(F.col(f"__upto{v}") * F.col("__sign")).alias(name) for v, name in names.items()]
    )


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null."""
    other = right.withColumnsRenamed({c: f"__key{c}" for c in keys})
    condition = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__key{c}")) for c in keys])
    return left.join(other, condition).drop(*[f"__key{c}" for c in keys])


def time_window_features(connections: DataFrame, seconds: float = 2.0, blocks: int | None = None) -> DataFrame:
    """Add the nine features over the connections of the last ``seconds``.

    ``connections`` has ``ts``, ``dst_ip``, ``service`` and ``conn_state`` (S0: SYN
    error, REJ: rejected). Connections alike in time, host and service are counted
    together first, and all three kinds of sums read those counts.
    """
    width = int(seconds * 1_000_000)
    rows = connections.withColumn("__t", F.unix_micros(F.col("ts")))
    group = ["__t", "dst_ip", "service"]
    shared_folder(connections.sparkSession)
    counts = (
        rows.groupBy(*group)
        .agg(
            F.count("*").alias("__n"),
            F.count_if(F.col("conn_state") == "S0").alias("__syn"),
            F.count_if(F.col("conn_state") == "REJ").alias("__rej"),
        )
        .checkpoint()
    )
    host = {"__n": "count", "__syn": "__host_syn", "__rej": "__host_rej"}
    service = {"__n": "srv_count", "__syn": "__srv_syn", "__rej": "__srv_rej"}
    found = counts.drop("__n", "__syn", "__rej")
    for keys, names in (
        (["dst_ip"], host), (["service"], service), (["dst_ip", "service"], {"__n": "__same"}),
    ):
        found = _joined(found, _recent_sums(counts, keys, names, width, blocks), [*keys, "__t"])
    same_host, same_service = F.col("__same") / F.col("count"), F.col("__same") / F.col("srv_count")
    measured = found.withColumns(
        {
            "serror_rate": F.col("__host_syn") / F.col("count"),
            "rerror_rate": F.col("__host_rej") / F.col("count"),
            "same_srv_rate": same_host,
            "diff_srv_rate": 1 - same_host,
            "srv_serror_rate": F.col("__srv_syn") / F.col("srv_count"),
            "srv_rerror_rate": F.col("__srv_rej") / F.col("srv_count"),
            "srv_diff_host_rate": 1 - same_service,
        }
    )
    hidden = ["__same", *[n for n in [*host.values(), *service.values()] if n.startswith("__")]]
    return _joined(rows, measured.drop(*hidden), group).drop("__t")


def host_window_features(connections: DataFrame, last: int = 100, block: int = 10_000) -> DataFrame:
    """Add the ten ``dst_host_*`` features over the last ``last`` connections to the same host.

    ``connections`` has ``seq`` (arrival order), ``src_ip``, ``src_port``, ``dst_ip``,
    ``service`` and ``conn_state``. Connections are numbered per host, and each host's
    numbers are cut into blocks that start with the ``last - 1`` connections before
    them, so a busy host is many tasks and every window is whole.
    """
    numbered = row_numbers(connections, ["dst_ip"], F.col("seq"), "__pos")
    zero_based = F.col("__pos") - 1
    own = _floor_div(zero_based, block)
    ahead = _floor_div(zero_based + last - 1, block)
    copies = F.when(own == ahead, F.array(own)).otherwise(F.sequence(own, ahead))
    rows = numbered.withColumn("__own", own).withColumn("__b", F.explode(copies))

    def over(*inner: str):
        return (
            Window.partitionBy("dst_ip", "__b", *inner)
            .orderBy("__pos")
            .rangeBetween(-(last - 1), Window.currentRow)
        )

    one = F.lit(1)
    syn = F.when(F.col("conn_state") == "S0", 1)
    rej = F.when(F.col("conn_state") == "REJ", 1)
    counted = rows.withColumns(
        {
            "dst_host_count": F.count(one).over(over()),
            "__syn": F.count(syn).over(over()),
            "__rej": F.count(rej).over(over()),
            "dst_host_srv_count": F.count(one).over(over("service")),
            "__srv_syn": F.count(syn).over(over("service")),
            "__srv_rej": F.count(rej).over(over("service")),
            "__same_port": F.count(one).over(over("service", "src_port")),
            "__same_src": F.count(one).over(over("service", "src_ip")),
        }
    ).where(F.col("__b") == F.col("__own"))
    host, srv = F.col("dst_host_count"), F.col("dst_host_srv_count")
    return counted.withColumns(
        {
            "dst_host_same_srv_rate": srv / host,
            "dst_host_diff_srv_rate": 1 - srv / host,
            "dst_host_same_src_port_rate": F.col("__same_port") / srv,
            "dst_host_srv_diff_host_rate": 1 - F.col("__same_src") / srv,
            "dst_host_serror_rate": F.col("__syn") / host,
            "dst_host_srv_serror_rate": F.col("__srv_syn") / srv,
            "dst_host_rerror_rate": F.col("__rej") / host,
            "dst_host_srv_rerror_rate": F.col("__srv_rej") / srv,
        }
    ).drop("__pos", "__own", "__b", "__syn", "__rej", "__srv_syn", "__srv_rej", "__same_port", "__same_src")

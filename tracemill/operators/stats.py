"""Capture-wide statistics of a packet index.

Every function groups by ``capture`` and counts with partial aggregation, so a capture that holds
a large share of all packets is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.tables import CONVERSATIONS_KEPT, DNS_NAME_SAMPLE
from tracemill.session import cut_lineage

CAPTURE = "capture_id"
PACKETS = "cell_packets"


def cells(df: DataFrame, capture: str = CAPTURE, order: str = "frame_no", epoch: str = "time_epoch") -> DataFrame:
    """One aggregate of the index that counts, spans, protocol sets and name samples all follow from.

    A cell is a (capture, stack, top protocol, transport, lower-cased name) with its packets, first and last frame, and first
    and last time.  Write it once (``cut_lineage``) and hand it to the functions below in place of the index, which
    is then scanned once for all of them.
    """
    timed = F.when(F.col(epoch).isNotNull(), F.col(order))
    return df.groupBy(capture, "protocols", "top_protocol", "transport", F.lower("dns_qry_name").alias("dns_qry_name")).agg(
        F.count(F.lit(1)).alias(PACKETS),
        F.min(order).alias("first_frame"),
        F.max(order).alias("last_frame"),
        F.min(timed).alias("first_timed"),
        F.min_by(epoch, timed).alias("first_epoch"),
        F.max(timed).alias("last_timed"),
        F.max_by(epoch, timed).alias("last_epoch"),
    )


def packets_in(df: DataFrame) -> Column:
    """The number of packets that rows of an index, or cells, stand for."""
    return F.sum(PACKETS) if PACKETS in df.columns else F.count(F.lit(1))


def _first(df: DataFrame, order: str) -> Column:
    return F.min("first_frame" if PACKETS in df.columns else order)


def protocol_counts(df: DataFrame, capture: str = CAPTURE, top: str = "top_protocol", order: str = "frame_no") -> DataFrame:
    """Packets per top protocol, with the first frame that showed it."""
    return df.groupBy(capture, F.col(top).alias("protocol")).agg(
        packets_in(df).alias("packets"), _first(df, order).alias("first_frame")
    )


def transport_counts(df: DataFrame, capture: str = CAPTURE, transport: str = "transport", order: str = "frame_no") -> DataFrame:
    """Packets per transport; packets without one count as ``ip``."""
    return df.groupBy(capture, F.coalesce(F.col(transport), F.lit("ip")).alias("transport")).agg(
        packets_in(df).alias("packets"), _first(df, order).alias("first_frame")
    )


def conversations(
    df: DataFrame,
    capture: str = CAPTURE,
    transport: str = "transport",
    src: str = "src_ip",
    dst: str = "dst_ip",
    top: str = "top_protocol",
    order: str = "frame_no",
    missing: str = "unknown",
    no_transport: str = "ip",
) -> DataFrame:
    """Packets per (transport, source, destination, top protocol)."""
    return df.groupBy(
        capture,
        F.coalesce(F.col(transport), F.lit(no_transport)).alias("transport"),
        F.coalesce(F.col(src), F.lit(missing)).alias("src"),
        F.coalesce(F.col(dst), F.lit(missing)).alias("dst"),
        F.col(top).alias("top_protocol"),
    ).agg(F.count(F.lit(1)).alias("packet_count"), F.min(order).alias("first_frame"))


def top_per_capture(
    df: DataFrame, limit: int, *ordering: Column, capture: str = CAPTURE, rank: str = "rank"
) -> DataFrame:
    """First ``limit`` rows per capture in the given order.

    Spark cuts each task's rows to ``limit`` before the shuffle, so a hot capture stays small.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(capture).orderBy(*ordering)))
    return ranked.where(F.col(rank) <= limit)


def top_conversations(conv: DataFrame, limit: int = CONVERSATIONS_KEPT, capture: str = CAPTURE) -> DataFrame:
    """Largest conversations, equal counts in order of first appearance."""
    return top_per_capture(conv, limit, F.col("packet_count").desc(), F.col("first_frame"), capture=capture)


def top_protocols(counts: DataFrame, limit: int = 10, capture: str = CAPTURE) -> DataFrame:
    """Largest protocols, equal counts by name."""
    return top_per_capture(counts, limit, F.col("packets").desc(), F.col("protocol"), capture=capture)


def observed_protocols(counts: DataFrame, limit: int = 10, capture: str = CAPTURE) -> DataFrame:
    """Largest protocols, equal counts in order of first appearance."""
    return top_per_capture(counts, limit, F.col("packets").desc(), F.col("first_frame"), capture=capture)


def attach_names(conv: DataFrame, peers: DataFrame, capture: str = CAPTURE) -> DataFrame:
    """Add ``src_name`` and ``dst_name`` from the resolved peers of the same capture."""
    named = peers.select(capture, "ip", "name")
    src = named.select(capture, F.col("ip").alias("src"), F.col("name").alias("src_name"))
    dst = named.select(capture, F.col("ip").alias("dst"), F.col("name").alias("dst_name"))
    return conv.join(src, [capture, "src"], "left").join(dst, [capture, "dst"], "left")


def raw_protocols(df: DataFrame, capture: str = CAPTURE, stack: str = "protocols") -> DataFrame:
    """Distinct members of all protocol stacks, one row each."""
    return df.select(capture, F.explode(F.array_distinct(stack)).alias("protocol")).distinct()


def relevant_protocols(counts: DataFrame, relevant: list[str]) -> DataFrame:
    """Top protocols that the profile lists."""
    return counts.where(F.col("protocol").isin(relevant)).select(CAPTURE, "protocol")


def span(df: DataFrame, capture: str = CAPTURE, order: str = "frame_no", epoch: str = "time_epoch") -> DataFrame:
    """Packet count, and first and last packet and time in export order (not the smallest or largest time)."""
    if PACKETS in df.columns:
        return df.groupBy(capture).agg(
            packets_in(df).alias("packet_count"),
            F.min("first_frame").alias("first_packet_number"),
            F.max("last_frame").alias("last_packet_number"),
            F.min_by("first_epoch", "first_timed").alias("first_seen_epoch"),
            F.max_by("last_epoch", "last_timed").alias("last_seen_epoch"),
        )
    timed = F.when(F.col(epoch).isNotNull(), F.col(order))
    return df.groupBy(capture).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.min(order).alias("first_packet_number"),
        F.max(order).alias("last_packet_number"),
        F.min_by(epoch, timed).alias("first_seen_epoch"),
        F.max_by(epoch, timed).alias("last_seen_epoch"),
    )


def dns_names(
    df: DataFrame,
    capture: str = CAPTURE,
    name: str = "dns_qry_name",
    order: str = "frame_no",
    limit: int = DNS_NAME_SAMPLE,
) -> DataFrame:
    """The first distinct lower-cased names of each capture."""
    first = (
        df.where(F.col(name) != "")
        .groupBy(capture, F.lower(name).alias("name"))
        .agg(_first(df, order).alias("first_frame"))
    )
    return top_per_capture(first, limit, F.col("first_frame"), F.col("name"), capture=capture).drop("rank")


def sorted_lists(df: DataFrame, value: str, out: str, capture: str = CAPTURE) -> DataFrame:
    """One sorted array per capture; ``value`` must come from a small vocabulary or a capped list."""
    return df.groupBy(capture).agg(F.sort_array(F.collect_set(value)).alias(out))


def capture_meta(
    df: DataFrame, relevant: list[str], capture: str = CAPTURE
) -> DataFrame:
    """One row per capture: span, protocol sets and the sampled names; one scan of the index."""
    df = df if PACKETS in df.columns else cut_lineage(cells(df, capture))
    counts = protocol_counts(df, capture)
    empty = F.array().cast("array<string>")
    meta = (
        span(df, capture)
        .join(sorted_lists(relevant_protocols(counts, relevant), "protocol", "relevant_protocols"), capture, "left")
        .join(sorted_lists(raw_protocols(df, capture), "protocol", "raw_protocols"), capture, "left")
        .join(sorted_lists(dns_names(df, capture), "name", "dns_qry_names"), capture, "left")
    )
    lists = ["relevant_protocols", "raw_protocols", "dns_qry_names"]
    return meta.select(
        *[c for c in meta.columns if c not in lists], *[F.coalesce(F.col(c), empty).alias(c) for c in lists]
    )

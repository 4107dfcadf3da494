"""Message-flow tables of captures: events, references, nodes, phases, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import labels, tables
from tracemill.functions.sqltext import select_once, sql_map
from tracemill.functions.ordering import first_rows, islands, sorted_place
from tracemill.operators.pairing import pair_events, write_back
from tracemill.session import cut_lineage

ORDER = "packet_no"


def capped(packets: DataFrame, max_events: int = tables.FLOW_EVENT_CAP, block_rows: int | None = None) -> DataFrame:
    """The packets a flow shows: the first ``max_events`` of each capture, before repeats are joined."""
    return first_rows(packets, ["capture_id"], ORDER, max_events, block_rows)


def flow_packets(packets: DataFrame) -> DataFrame:
    """Packets with node ids, labels and message columns, without their field trees."""
    rows = labels.with_labels(labels.with_message_fields(packets))
    return select_once(
        rows,
        "capture_id",
        "packet_no",
        "time_rel_ms",
        "time_epoch",
        "top_protocol",
        "anomalies",
        "src",
        "dst",
        f"{labels.endpoint_id('src')} as src_node",
        f"{labels.endpoint_id('dst')} as dst_node",
        "message_name",
        "status",
        "correlation_id",
    )


def numbered(flow: DataFrame, collapse: bool = True, block_rows: int | None = None) -> DataFrame:
    """Add ``event_no``: runs of equal (source, destination, name, protocol) are one event."""
    signature = ["src_node", "dst_node", "message_name", "top_protocol"]

    def same(previous, current):
        equal = F.lit(collapse)
        for name in signature:
            equal = equal & previous[name].eqNullSafe(current[name])
        return equal

    return islands(flow, ["capture_id"], ORDER, signature, same, "event_no", block_rows)


def event_rows(packets: DataFrame) -> DataFrame:
    """One row per event from numbered packets."""
    first = ["time_epoch", "time_rel_ms", "src_node", "dst_node", "top_protocol", "message_name", "status", "correlation_id", "anomalies"]
    events = packets.groupBy("capture_id", "event_no").agg(
        F.min_by(F.struct(*first), ORDER).alias("_first"),
        F.min(ORDER).alias("first_packet_no"),
        F.max(ORDER).alias("last_packet_no"),
        F.max_by("time_rel_ms", ORDER).alias("last_relative_ms"),
        F.count(F.lit(1)).alias("repeat_count"),
    )
    return events.selectExpr(
        "capture_id",
        "event_no",
        "concat('event-', event_no) as id",
        "first_packet_no as packet_no",
        "first_packet_no",
        "last_packet_no",
        "_first.time_epoch as timestamp",
        "_first.time_rel_ms as relative_ms",
        "_first.time_rel_ms as first_relative_ms",
        "last_relative_ms",
        "_first.src_node as src_node",
        "_first.dst_node as dst_node",
        "_first.top_protocol as protocol_family",
        "_first.top_protocol as protocol",
        "_first.message_name as message_name",
        "_first.status as message_type",
        "_first.status as status",
        "'outbound' as direction",
        "_first.status = 'request' as is_request",
        "_first.status = 'response' as is_response",
        "_first.status = 'error' as is_error",
        "_first.correlation_id as correlation_id",
        "_first.message_name as short_label",
        "if(repeat_count = 1, concat('pkt ', first_packet_no), concat('pkt ', first_packet_no, '..', last_packet_no)) as detail_label",
        "_first.anomalies as notes",
        "if(_first.status = 'error', 'high', 'normal') as emphasis",
        "repeat_count",
    )


def event_refs(packets: DataFrame) -> DataFrame:
    """Packets of each event, in long form: a run may be arbitrarily long."""
    return packets.select("capture_id", "event_no", "packet_no")


def flow_events(packets: DataFrame, max_events: int = tables.FLOW_EVENT_CAP, collapse: bool = True, block_rows: int | None = None) -> DataFrame:
    """Events of normalised packets, before pairing.

    The labelled packets are written once: numbering reads them twice, and decoding is the costly part.  Packets that have been labelled
    and written already, by ``cut_lineage`` of ``flow_packets``, are taken as they are.
    """
    shown = capped(packets, max_events, block_rows)
    if "src_node" not in packets.columns:
        shown = cut_lineage(flow_packets(shown).drop("src", "dst"))
    return event_rows(numbered(shown, collapse, block_rows))


def paired_events(events: DataFrame, block_rows: int | None = None, order: str = "matches") -> DataFrame:
    return write_back(events, pair_events(events, block_rows, order))


def phases(events: DataFrame, profile: str = "", block_rows: int | None = None) -> DataFrame:
    """Runs of events of one phase kind, numbered per capture.

    The kinds are written once: numbering reads them twice, and events are numbered and grouped themselves.
    """
    rows = events.select("capture_id", "event_no", F.expr(labels.phase(labels.profile_family(profile))).alias("phase"))
    rows = cut_lineage(rows.select("capture_id", "event_no", "phase.*"))
    same = lambda previous, current: previous["kind"] == current["kind"]
    runs = islands(rows, ["capture_id"], "event_no", ["kind"], same, "phase_no", block_rows)
    out = runs.groupBy("capture_id", "phase_no").agg(
        F.min_by("kind", "event_no").alias("kind"),
        F.min_by("label", "event_no").alias("label"),
        F.min("event_no").alias("_start"),
        F.max("event_no").alias("_end"),
    )
    return out.selectExpr(
        "capture_id",
        "phase_no",
        "concat('phase-', phase_no) as id",
        "label",
        "kind",
        "concat('event-', _start) as start_event",
        "concat('event-', _end) as end_event",
    )


def nodes(packets: DataFrame, profile: str = "", few: bool = False) -> DataFrame:
    """Distinct endpoints with the attributes they had first, in lane order.

    ``few`` says that the packets are those of a capped flow, whose nodes one window can number.
    """
    seen = packets.selectExpr(
        "capture_id",
        "packet_no",
        "inline(array(struct(0 as side, src_node as id, src as endpoint), struct(1 as side, dst_node as id, dst as endpoint)))",
    )
    first = seen.groupBy("capture_id", "id").agg(
        F.min_by(
            F.expr(
                f"struct({labels.endpoint_label('endpoint')} as label, endpoint.role as role,"
                " coalesce(nullif(endpoint.alias, '') <> coalesce(endpoint.ip, ''), false) as pseudonymized)"
            ),
            F.col("packet_no") * 2 + F.col("side"),
        ).alias("_f")
    )
    family = labels.profile_family(profile)
    priority = sql_map(tables.LANE_PRIORITY.get(family, tables.LANE_PRIORITY["generic"]))
    rows = first.selectExpr(
        "capture_id", "id", "_f.label as label", "_f.role as role", "'endpoint' as family", "_f.pseudonymized as pseudonymized",
        f"coalesce({priority}[lower(_f.role)], {tables.OTHER_LANE}) as lane_priority",
    )
    order = ["lane_priority", "label", "id"]
    if few:
        return rows.withColumn("lane_index", F.row_number().over(Window.partitionBy("capture_id").orderBy(*order)) - 1)
    # written first, because range partitioning reads its input twice
    return sorted_place(cut_lineage(rows), ["capture_id"], order, "lane_index")


def totals(packets: DataFrame, shown: DataFrame, events: DataFrame, max_events: int = tables.FLOW_EVENT_CAP) -> DataFrame:
    """One row per capture: counts, time span, first date, truncation warning."""
    everything = packets.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packet_count_total"), F.min_by("time_epoch", ORDER).alias("_epoch")
    )
    rendered = shown.groupBy("capture_id").agg(F.count(F.lit(1)).alias("event_count_uncollapsed"))
    spans = events.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("event_count_rendered"),
        F.round(F.coalesce(F.max("relative_ms") - F.min("relative_ms"), F.lit(0.0)), 3).alias("time_span_ms"),
    )
    out = everything.join(rendered, "capture_id").join(spans, "capture_id")
    truncated = f"{max_events} > 0 and packet_count_total > {max_events}"
    return out.selectExpr(
        "capture_id",
        "packet_count_total",
        "event_count_uncollapsed",
        "event_count_rendered",
        "time_span_ms",
        f"date_format({labels.epoch_time('_epoch')}, 'dd.MM.yyyy') as first_packet_date",
        f"if({truncated}, concat('Flow visualization truncated to {max_events} events out of ', packet_count_total, '.'), null) as warning",
    )


def overview(events: DataFrame, node_rows: DataFrame, phase_rows: DataFrame) -> DataFrame:
    """Flow figures per capture for a batch report."""
    counted = events.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("repeat_count").alias("packets"),
        F.count_if(F.expr("status = 'error' or is_error")).alias("errors"),
        F.count("paired_event_id").alias("paired"),
    )
    per = lambda df, name: df.groupBy("capture_id").agg(F.count(F.lit(1)).alias(name))
    return counted.join(per(node_rows, "nodes"), "capture_id").join(per(phase_rows, "phases"), "capture_id")

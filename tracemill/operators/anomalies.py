"""Anomalies of transport, Diameter and GTPv2 in a packet index.

Each detector gives rows ``(capture_id, section, position, frame_no, layer, severity, kind, text)``;
``section`` and ``position`` are the reading order of the combined list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.convert import decimal_or_hex, strict_int
from tracemill.functions.ordering import neighbour
from tracemill.session import cut_lineage

COLUMNS = ["capture_id", "section", "position", "frame_no", "layer", "severity", "kind", "text"]
CREATE_SESSION_REQUEST, CREATE_SESSION_RESPONSE, ERROR_INDICATION = "32", "33", "26"
CAUSE_ACCEPTED = 16
GTP_PROFILES = ("lte-core", "")
SIGNALS = """
tcp_retransmission tcp_out_of_order diameter_flags diameter_cmd_code diameter_hop_by_hop_id diameter_result_code
gtpv2_message_type gtpv2_seq_no gtpv2_cause
""".split()


def _shape(df: DataFrame, section: int, layer: str, severity, kind: str, text: Column, position="frame_no") -> DataFrame:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select(
        "capture_id",
        F.lit(section).alias("section"),
        F.col(position).alias("position"),
        "frame_no",
        F.lit(layer).alias("layer"),
        severity.alias("severity"),
        F.lit(kind).alias("kind"),
        text.alias("text"),
    )


def transport_anomalies(df: DataFrame) -> DataFrame:
    """Packets flagged as retransmission or out of order."""
    notes = F.concat_ws(
        ", ",
        F.when(F.col("tcp_retransmission"), F.lit("retransmission")),
        F.when(F.col("tcp_out_of_order"), F.lit("out_of_order")),
    )
    hit = df.where(F.col("tcp_retransmission") | F.col("tcp_out_of_order"))
    return _shape(hit, 0, "transport", F.lit(None).cast("string"), "transport", F.format_string("Packet %d: %s", "frame_no", notes))


def note_anomalies(packets: DataFrame) -> DataFrame:
    """The same from normalised packets, where SCTP analysis flags count too."""
    hit = packets.where("transport.anomaly").withColumn("frame_no", F.col("packet_no"))
    notes = F.coalesce(F.nullif(F.concat_ws(", ", "transport.notes"), F.lit("")), F.lit("transport anomaly"))
    return _shape(hit, 0, "transport", F.lit(None).cast("string"), "transport", F.format_string("Packet %d: %s", "frame_no", notes))


def is_diameter_request(flags: Column) -> Column:
    """Request bit of the command flags; missing or unreadable flags mean an answer."""
    return F.coalesce(decimal_or_hex(flags).bitwiseAND(F.lit(0x80)) != 0, F.lit(False))


def diameter_messages(df: DataFrame) -> DataFrame:
    """Index rows that carry Diameter, with request test, command text and id."""
    return df.where(F.col("diameter_flags").isNotNull() | F.col("diameter_cmd_code").isNotNull()).select(
        "capture_id",
        "frame_no",
        is_diameter_request(F.col("diameter_flags")).alias("is_request"),
        F.coalesce("diameter_cmd_code", F.lit("?")).alias("cmd"),
        F.col("diameter_hop_by_hop_id").alias("hop_by_hop"),
        strict_int(F.col("diameter_result_code")).alias("result_code"),
    )


def result_code_anomalies(messages: DataFrame) -> DataFrame:
    """Answers with a result code outside the success range."""
    code = F.col("result_code")
    hit = messages.where(~F.col("is_request") & ~code.between(2000, 2999))
    severity = F.when(code >= 5000, "error").otherwise("warn")
    text = F.format_string("[diameter][%s] Result-Code %d (cmd=%s) at packet %d", severity, code, F.col("cmd"), F.col("frame_no"))
    return _shape(hit, 1, "diameter", severity, "result_code", text)


def linked_diameter(messages: DataFrame, block_rows: int | None = None) -> DataFrame:
    keyed = messages.where(F.col("hop_by_hop").isNotNull())
    return linked_messages(keyed, ["capture_id", "hop_by_hop"], ["cmd"], block_rows)


def duplicate_id_anomalies(linked: DataFrame) -> DataFrame:
    """Requests whose hop-by-hop id is still waiting for its answer."""
    hit = linked.where(F.col("is_request") & F.col("before.is_request"))
    text = F.format_string("[diameter][warn] Duplicate hop-by-hop ID %s (cmd=%s) at packet %d", "hop_by_hop", "cmd", "frame_no")
    return _shape(hit, 1, "diameter", "warn", "duplicate_id", text)


def linked_messages(df: DataFrame, keys: list[str], keep: list[str], block_rows: int | None = None) -> DataFrame:
    """Records of a request key, each with ``before``: whether the previous record was a request."""
    keyed = df.select(*keys, "frame_no", "is_request", *keep)
    return neighbour(keyed, keys, "frame_no", ["is_request"], "before", block_rows=block_rows)


def open_requests(linked: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Keys whose last record is a request: that request, and the frame where its open run began."""
    run_start = F.col("is_request") & ~F.coalesce("before.is_request", F.lit(False))
    return (
        linked.groupBy(*keys)
        .agg(
            F.max_by("is_request", "frame_no").alias("_open"),
            F.max(F.when(run_start, F.col("frame_no"))).alias("opened_at"),
            *[F.max_by(c, "frame_no").alias(c) for c in keep],
            F.max("frame_no").alias("frame_no"),
        )
        .where("_open")
        .drop("_open")
    )


def unanswered_anomalies(linked: DataFrame) -> DataFrame:
    """Diameter requests without an answer at the end of the capture."""
    left = open_requests(linked, ["capture_id", "hop_by_hop"], ["cmd"])
    text = F.format_string("[diameter][warn] Unanswered request cmd=%s hop-by-hop=%s from packet %d", "cmd", "hop_by_hop", "frame_no")
    return _shape(left, 2, "diameter", "warn", "unanswered", text, "opened_at")


def diameter_anomalies(df: DataFrame, block_rows: int | None = None) -> DataFrame:
    messages = diameter_messages(df)
    linked = linked_diameter(messages, block_rows)
    return (
        result_code_anomalies(messages)
        .unionByName(duplicate_id_anomalies(linked))
        .unionByName(unanswered_anomalies(linked))
    )


def gtp_messages(df: DataFrame) -> DataFrame:
    return df.where(F.col("gtpv2_message_type").isNotNull()).select(
        "capture_id",
        "frame_no",
        F.col("gtpv2_message_type").alias("type"),
        F.col("gtpv2_seq_no").alias("seq"),
        decimal_or_hex(F.col("gtpv2_cause")).alias("cause"),
    )


def rejected_sessions(messages: DataFrame) -> DataFrame:
    hit = messages.where((F.col("type") == CREATE_SESSION_RESPONSE) & (F.col("cause") != CAUSE_ACCEPTED))
    text = F.format_string("[gtpv2][warn] Create Session rejected cause=%d at packet %d", "cause", "frame_no")
    return _shape(hit, 3, "gtpv2", "warn", "rejected", text)


def error_indications(messages: DataFrame) -> DataFrame:
    hit = messages.where(F.col("type") == ERROR_INDICATION)
    return _shape(hit, 3, "gtpv2", "error", "error_indication", F.format_string("[gtpv2][error] Error Indication at packet %d", "frame_no"))


def unanswered_sessions(messages: DataFrame, block_rows: int | None = None) -> DataFrame:
    kinds = [CREATE_SESSION_REQUEST, CREATE_SESSION_RESPONSE]
    keyed = messages.where(F.col("seq").isNotNull() & F.col("type").isin(kinds))
    keyed = keyed.withColumn("is_request", F.col("type") == CREATE_SESSION_REQUEST)
    left = open_requests(linked_messages(keyed, ["capture_id", "seq"], [], block_rows), ["capture_id", "seq"], [])
    text = F.format_string("[gtpv2][warn] Unanswered Create Session Request seq=%s from packet %d", "seq", "frame_no")
    return _shape(left, 4, "gtpv2", "warn", "unanswered", text, "opened_at")


def gtp_anomalies(df: DataFrame, block_rows: int | None = None) -> DataFrame:
    messages = gtp_messages(df)
    return (
        rejected_sessions(messages)
        .unionByName(error_indications(messages))
        .unionByName(unanswered_sessions(messages, block_rows))
    )


def all_anomalies(df: DataFrame, profile_name: str = "", block_rows: int | None = None) -> DataFrame:
    """Transport, then Diameter, then GTPv2; the last only for the profiles that ask for it.

    The rows that any detector reads are picked in one scan and written once, since the detectors read them several times.
    """
    read = F.col("tcp_retransmission") | F.col("tcp_out_of_order") | F.col("diameter_flags").isNotNull() | F.col("diameter_cmd_code").isNotNull()
    if profile_name in GTP_PROFILES:
        read = read | F.col("gtpv2_message_type").isNotNull()
    df = cut_lineage(df.where(read).select("capture_id", "frame_no", *SIGNALS))
    found = transport_anomalies(df).unionByName(diameter_anomalies(df, block_rows))
    if profile_name in GTP_PROFILES:
        found = found.unionByName(gtp_anomalies(df, block_rows))
    return found


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    """Anomalies per capture and layer."""
    return anomalies.groupBy("capture_id", "layer").agg(F.count(F.lit(1)).alias("anomalies"))


def with_network_anomalies(anomalies: DataFrame, enriched: DataFrame) -> DataFrame:
    """The stream of packet anomalies followed by the notes on the capture as a whole; these have no frame."""
    notes = enriched.select("capture_id", F.posexplode("network_anomalies").alias("place", "text"))
    rows = notes.select(
        "capture_id", F.lit(5).alias("section"), F.col("place").cast("bigint").alias("position"), F.lit(None).cast("bigint").alias("frame_no"),
        F.lit("network").alias("layer"), F.lit(None).cast("string").alias("severity"), F.lit("network").alias("kind"), "text",
    )
    return anomalies.unionByName(rows)

"""Packet-index exports: one text line per packet, columns separated by ``|``.

One file is one capture; its path below the folder that was read, without extension, is the ``capture_id``.
"""

from __future__ import annotations

import pathlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.convert import BLANKS, clean, strict_int
from tracemill.functions.tables import INDEX_FIELDS, INDEX_SEPARATOR

INDEX_COLUMNS = """
capture_id frame_no time_epoch protocols src_ip dst_ip transport src_port dst_port stream tcp_retransmission
tcp_out_of_order diameter_flags diameter_cmd_code diameter_hop_by_hop_id diameter_result_code gtpv2_message_type
gtpv2_seq_no gtpv2_cause dns_qry_name
""".split()


def capture_key(path: Column, root: str | Sequence[str]) -> Column:
    """Path of a file below the folder it was read from, without its last extension.

    Files of one name in two folders are two captures.  Of several roots the longest that fits counts, and a file
    that was named itself, or by a pattern, keeps the part of its path behind the last folder without a wildcard.
    """
    plain = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    below = F.lit(None).cast("string")
    for folder in sorted({fixed_folder(r) for r in ([root] if isinstance(root, str) else root)}, key=len):
        below = F.when(F.startswith(plain, F.lit(folder)), F.substring(plain, len(folder) + 1, 1 << 20)).otherwise(below)
    below = F.coalesce(below, F.ltrim(plain, F.lit("/")))
    return F.regexp_replace(below, r"\.[^./]*$", "")


def fixed_folder(root: str) -> str:
    """The folder that a path or pattern lies in, with a slash at its end and without scheme and host."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)
    if not plain.startswith("/") and "://" not in root:
        plain = str(pathlib.PurePosixPath(pathlib.Path.cwd().as_posix()) / plain)
    parts = plain.split("/")
    for place, part in enumerate(parts):
        if re.search(r"[*?\[{]", part):
            return "/".join(parts[:place]).rstrip("/") + "/"
    # a last part with an extension is a file
    if "." in parts[-1]:
        parts = parts[:-1]
    return "/".join(parts).rstrip("/") + "/"


def parse_index(lines: DataFrame, fields: Sequence[str] = INDEX_FIELDS, line: str = "value") -> DataFrame:
    """Typed index rows from ``(capture_id, value)`` lines, with ``is_valid`` for the malformed-row rule.

    ``fields`` is the column list of this export: an older export that lacks some columns is read
    with its own shorter list, absent columns become null.  Extra columns in a line are ignored.
    """
    # validity reads the plain line, so a pushed-down filter does not repeat the split
    separators = F.length(line) - F.length(F.replace(F.col(line), F.lit(INDEX_SEPARATOR), F.lit("")))
    number = strict_int(F.split_part(F.col(line), F.lit(INDEX_SEPARATOR), F.lit(list(fields).index("frame.number") + 1)))
    trimmed = F.transform(F.split(F.col(line), "\\" + INDEX_SEPARATOR, -1), lambda x: F.when(x != "", F.trim(x, F.lit(BLANKS))))
    cut = lines.withColumn("_cols", F.transform(trimmed, lambda x: F.nullif(x, F.lit(""))))
    place = {name: i for i, name in enumerate(fields)}

    def field(name: str) -> Column:
        if name not in place:
            return F.lit(None).cast("string")
        return F.get("_cols", F.lit(place[name]))

    def first_of(*names: str) -> Column:
        return F.coalesce(*[field(n) for n in names])

    def by_transport(sctp: str, tcp: str, udp: str) -> Column:
        return (
            F.when(field("sctp.srcport").isNotNull(), field(sctp))
            .when(field("tcp.srcport").isNotNull(), field(tcp))
            .when(field("udp.srcport").isNotNull(), field(udp))
        )

    frame_no = strict_int(field("frame.number"))
    src_port = strict_int(by_transport("sctp.srcport", "tcp.srcport", "udp.srcport")).try_cast("int")
    dst_port = strict_int(by_transport("sctp.dstport", "tcp.dstport", "udp.dstport")).try_cast("int")
    return cut.select(
        "capture_id",
        F.col(line).alias("line"),
        ((separators >= len(fields) - 1) & number.isNotNull()).alias("is_valid"),
        frame_no.alias("frame_no"),
        field("frame.time_epoch").alias("time_epoch"),
        F.coalesce(protocol_stack(field("frame.protocols")), F.array().cast("array<string>")).alias("protocols"),
        first_of("ip.src", "ipv6.src").alias("src_ip"),
        first_of("ip.dst", "ipv6.dst").alias("dst_ip"),
        transport_name(field).alias("transport"),
        src_port.alias("src_port"),
        # the destination port is read only after the source port proved to be a number
        F.when(src_port.isNotNull(), dst_port).alias("dst_port"),
        by_transport("sctp.assoc_index", "tcp.stream", "udp.stream").alias("stream"),
        field("tcp.analysis.retransmission").isNotNull().alias("tcp_retransmission"),
        field("tcp.analysis.out_of_order").isNotNull().alias("tcp_out_of_order"),
        field("diameter.flags").alias("diameter_flags"),
        field("diameter.cmd.code").alias("diameter_cmd_code"),
        first_of("diameter.hop_by_hop_id", "diameter.hopbyhopid").alias("diameter_hop_by_hop_id"),
        first_of("diameter.Result-Code", "diameter.result_code", "diameter.resultcode").alias("diameter_result_code"),
        field("gtpv2.message_type").alias("gtpv2_message_type"),
        first_of("gtpv2.seq", "gtpv2.seq_no", "gtpv2.sequence_number").alias("gtpv2_seq_no"),
        field("gtpv2.cause").alias("gtpv2_cause"),
        field("dns.qry.name").alias("dns_qry_name"),
    )


def transport_name(field) -> Column:
    return (
        F.when(field("sctp.srcport").isNotNull(), "sctp")
        .when(field("tcp.srcport").isNotNull(), "tcp")
        .when(field("udp.srcport").isNotNull(), "udp")
    )


def protocol_stack(text: Column) -> Column:
    """``a:b:c`` to an array without blanks."""
    return F.filter(F.split(text, ":"), lambda p: p != "")


def read_index(
    spark: SparkSession, path: str | Sequence[str], fields: Sequence[str] = INDEX_FIELDS, root: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Index rows and rejected lines ``(capture_id, line)`` of all files under ``path``.

    Blank lines are neither.  Both results come from the same scan expression; land the index
    with ``sinks.write_index`` when it is read more than once.  ``root`` is the folder that capture ids are relative to.
    """
    lines = spark.read.text(path).where(clean(F.col("value")).isNotNull())
    parsed = parse_index(lines.select(capture_key(F.col("_metadata.file_path"), path if root is None else root).alias("capture_id"), "value"), fields)
    return keep_valid(parsed), parsed.where(~F.col("is_valid")).select("capture_id", "line")


def keep_valid(parsed: DataFrame) -> DataFrame:
    return parsed.where("is_valid").select(INDEX_COLUMNS)


def malformed_counts(parsed: DataFrame) -> DataFrame:
    """Kept and dropped lines per capture."""
    return parsed.groupBy("capture_id").agg(
        F.count_if("is_valid").alias("kept"), F.count_if(~F.col("is_valid")).alias("dropped")
    )

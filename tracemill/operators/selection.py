"""Choosing the detail window, and the guards around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.ordering import first_rows
from tracemill.functions.tables import DETAIL_LIMIT, OVERSIZE_FACTOR
from tracemill.operators.stats import packets_in


def first_packets(
    df: DataFrame, limit: int = DETAIL_LIMIT, capture: str = "capture_id", order: str = "frame_no", block_rows: int | None = None
) -> DataFrame:
    """The first ``limit`` packets of each capture; zero or less keeps all."""
    return first_rows(df, [capture], order, limit, block_rows)


def selection_info(df: DataFrame, limit: int = DETAIL_LIMIT, capture: str = "capture_id", order: str = "frame_no") -> DataFrame:
    """Per capture: total, selected, truncated, note."""
    total, selected = F.col("total_exported"), F.col("selected")
    counted = df.groupBy(capture).agg(F.count(F.lit(1)).alias("total_exported"))
    counted = counted.withColumn("selected", F.least(total, F.lit(limit)) if limit > 0 else total)
    note = F.format_string(
        "detail.json contains only the first %s of %s packets. Use --all-packets to include all.",
        grouped(F.lit(limit)),
        grouped(total),
    )
    return counted.withColumn("truncated", selected < total).withColumn(
        "truncation_note", F.when(F.col("truncated"), note)
    )


def selected_frames(full: DataFrame, selected: DataFrame, capture: str = "capture_id", order: str = "frame_no") -> DataFrame:
    """Full rows of the chosen frames only; no chosen frame, no row."""
    return full.join(selected.select(capture, order).distinct(), [capture, order], "left_semi")


def grouped(number: Column) -> Column:
    """Integer with thousands separators."""
    return F.format_number(number, 0)


def coverage(available: DataFrame, included: DataFrame, capture: str = "capture_id") -> DataFrame:
    """How much of the capture the detail holds."""
    have = included.groupBy(capture).agg(F.count(F.lit(1)).alias("_included"))
    both = available.groupBy(capture).agg(packets_in(available).alias("detail_packets_available")).join(have, capture, "left")
    both = both.select(
        capture,
        F.coalesce("_included", F.lit(0)).alias("detail_packets_included"),
        "detail_packets_available",
        F.col("detail_packets_available").alias("summary_packet_count"),
    )
    truncated = F.col("detail_packets_included") < F.col("detail_packets_available")
    note = F.format_string(
        "detail artifact contains %s of %s exported packets.",
        grouped(F.col("detail_packets_included")),
        grouped(F.col("detail_packets_available")),
    )
    return both.withColumn("detail_truncated", truncated).withColumn("truncation_note", F.when(truncated, note))


def oversize(
    df: DataFrame, limit: int = DETAIL_LIMIT, factor: float = OVERSIZE_FACTOR, capture: str = "capture_id"
) -> DataFrame:
    """Captures with more than ``limit * factor`` packets, and by how much they exceed the limit."""
    counted = df.groupBy(capture).agg(packets_in(df).alias("total_exported"))
    if limit <= 0 or factor <= 0:
        return counted.where(F.lit(False)).withColumn("ratio", F.lit(0.0))
    return counted.where(F.col("total_exported") > limit * factor).withColumn(
        "ratio", F.round(F.col("total_exported") / F.lit(limit), 2)
    )


def require_empty(failing: DataFrame, message: str) -> None:
    """Raise before a write when a guard found captures; shows at most five of them."""
    rows = failing.limit(5).collect()
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")

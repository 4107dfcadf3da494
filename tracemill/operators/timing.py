"""Timing of the detail window: gaps, their statistics, and bursts.

All follow export order, not time order, so a gap can be negative.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.ordering import BLOCK, islands, neighbour

BURST_GAP_MS = 1000.0
BURST_SIZE = 5
GAP_BLOCK_US = 1 << 20
NO_GAP_BLOCK = -(1 << 62)


def gaps(
    df: DataFrame, keys: Sequence[str], time: str = "time_rel_ms", order: str = "frame_no", block_rows: int | None = None
) -> DataFrame:
    """Difference to the previous timed row; rows without a time are skipped."""
    timed = df.where(F.col(time).isNotNull())
    paired = neighbour(timed, keys, order, [time], "_previous", block_rows=block_rows)
    return paired.withColumn("gap", F.col(time) - F.col(f"_previous.{time}")).drop("_previous")


def gap_stats(
    df: DataFrame,
    keys: Sequence[str],
    time: str = "time_rel_ms",
    order: str = "frame_no",
    block_rows: int | None = None,
) -> DataFrame:
    """Packets, duration, and min / max / mean / p95 gap in milliseconds, three decimals; keys with one row are left out.

    The p95 is the gap at index ``floor((n - 1) * 0.95)`` of the sorted gaps, exactly.  Equal gaps
    (in whole microseconds, the precision of the result) are counted first, and the counts are
    scanned in blocks of the value range, so no key is sorted in one task.
    """
    rows = gaps(df, keys, time, order, block_rows)
    counted = rows.groupBy(*keys, F.round(F.col("gap") * 1000, 0).cast("bigint").alias("_us")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("gap").alias("_lo"),
        F.max("gap").alias("_hi"),
        F.min(F.struct(F.col(order).alias("o"), F.col(time).alias("t"))).alias("_head"),
        F.max(F.struct(F.col(order).alias("o"), F.col(time).alias("t"))).alias("_tail"),
        F.min(time).alias("_from"),
        F.max(time).alias("_to"),
    )
    # the first row of a key has no gap: it counts as a packet and for the duration only
    counted = counted.withColumn(BLOCK, F.coalesce(F.expr(f"_us div {GAP_BLOCK_US}"), F.lit(NO_GAP_BLOCK)))
    counted = counted.withColumn("_gaps", F.when(F.col("_us").isNotNull(), F.col("_n")).otherwise(0))
    key = Window.partitionBy(*keys)
    before = key.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy(*keys, BLOCK).agg(
        F.sum("_n").alias("_rows"), F.sum("_gaps").alias("_gaps"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.min("_head").alias("_head"), F.max("_tail").alias("_tail"), F.min("_from").alias("_from"), F.max("_to").alias("_to"),
    )
    total = F.sum("_gaps").over(key)
    # the gaps add up to the way from the first to the last row, whatever the order of summation
    whole = F.max("_tail").over(key)["t"] - F.min("_head").over(key)["t"]
    blocks = blocks.select(
        *keys,
        BLOCK,
        F.coalesce(F.sum("_gaps").over(before), F.lit(0)).alias("_before"),
        (F.floor((total - 1) * F.lit(0.95)) + 1).alias("_rank"),
        F.sum("_rows").over(key).alias("packet_count"),
        F.round(F.max("_to").over(key) - F.min("_from").over(key), 3).alias("duration_ms"),
        F.round(F.min("_lo").over(key), 3).alias("gap_min"),
        F.round(F.max("_hi").over(key), 3).alias("gap_max"),
        F.round(F.try_divide(whole, total), 3).alias("gap_mean"),
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy("_us").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.col("_local")
    return (
        counted.select(*keys, BLOCK, "_us", "_gaps", F.sum("_gaps").over(inside).alias("_local"))
        .join(blocks, [*keys, BLOCK])
        .where((upto >= F.col("_rank")) & (upto - F.col("_gaps") < F.col("_rank")))
        .withColumn("gap_p95", F.round(F.col("_us") / 1000, 3))
        .select(*keys, "packet_count", "duration_ms", "gap_min", "gap_max", "gap_mean", "gap_p95")
    )


def bursts(
    df: DataFrame,
    keys: Sequence[str],
    time: str = "time_rel_ms",
    order: str = "frame_no",
    max_gap: float = BURST_GAP_MS,
    min_size: int = BURST_SIZE,
    block_rows: int | None = None,
) -> DataFrame:
    """Runs of at least ``min_size`` rows whose gaps stay within ``0..max_gap`` (inclusive)."""
    timed = df.where(F.col(time).isNotNull()).select(*keys, order, time)
    close = lambda previous, current: (current[time] - previous[time]).between(0, max_gap)
    numbered = islands(timed, keys, order, [time], close, "_run", block_rows)
    return (
        numbered.groupBy(*keys, "_run")
        .agg(
            F.count(F.lit(1)).alias("packet_count"),
            F.min(order).alias("first_frame"),
            F.round(F.min_by(time, order), 3).alias("start_ms"),
            F.round(F.max_by(time, order), 3).alias("end_ms"),
        )
        .where(F.col("packet_count") >= min_size)
        .drop("_run")
    )

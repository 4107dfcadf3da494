"""What the operators of this subpackage share: written intermediates, splits, sampling, numbering.

Written intermediates are Parquet below ``spark.checkpoint.dir`` of the session, one folder per run
of an operator.  They are plain files that every executor reads again after a loss; a session
removes its folders when the driver process ends.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.session import remove, shared_folder

SLICE_BYTES = 1 << 20


class Run:
    """The written intermediates of one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.folder)

    def land(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage, and the rows stay the same on every read."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        self._remove(f"{self.folder}/{name}")

    def _remove(self, path: str) -> None:
        try:
            remove(self.spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is then the cluster's to clean
            return


def is_fold(doc_id: Column, fold: int, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut a batch so that a slice holds about ``limit`` bytes of ``column``; a longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and total + size > limit:
            part = batch.slice(start, row - start)
            yield part, part.column(column).to_pylist()
            start, total = row, 0
        total += size
    part = batch.slice(start)
    yield part, part.column(column).to_pylist()


def smallest(df: DataFrame, key: str, limit: int) -> DataFrame:
    """A sample of at most ``limit`` rows, the same on every run: those with the smallest hash of ``key``."""
    return df.orderBy(F.xxhash64(key, F.lit("sample")), key).limit(limit)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, blocks: int) -> DataFrame:
    """Add the 0-based, gapless place of each row among those of its ``keys``.

    Rows are dealt into ``blocks`` by the hash of ``order`` and numbered inside (keys, block); one count per
    (keys, block) then gives each block its offset.  No key meets in one task, whatever its share of the rows.
    Equal rows get neighbouring places in no stated order.
    """
    block, place, before = "__block", "__place", "__before"
    rows = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = rows.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    rows = rows.withColumn(place, F.row_number().over(inside).cast("long") - 1)
    return rows.join(offsets, [*keys, block]).withColumn(out, F.col(before) + F.col(place)).drop(block, place, before)

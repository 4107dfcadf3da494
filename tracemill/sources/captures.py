"""Capture files as such: digest and size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.tables import INPUT_LIMIT_MIB
from tracemill.session import intermediate_path
from tracemill.sources.index import capture_key

UNCUT = 1 << 60  # bytes; as a split size and as the cost of opening a file it makes every file one task of its own
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """(capture_id, path, bytes) of all files; the content is not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(capture_key(F.col("path"), path).alias("capture_id"), "path", F.col("length").alias("bytes"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path and SHA-256 of files that come line by line, one after the other."""
    own: str | None = None
    # The reader drops a byte order mark, which shows only at the end, so both readings are digested.
    states: list = []
    size = total = 0

    def finished() -> pa.RecordBatch:
        rows = []
        if own is not None:
            left = size - total  # a last line feed, a dropped mark, or both
            for state in states:
                state.update(b"\n" * (left in (1, 1 + len(BYTE_ORDER_MARK))))
            rows = [(own, states[left >= len(BYTE_ORDER_MARK)].hexdigest())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["path", "capture_sha256"])

    for batch in batches:
        paths, sizes, lines = (batch.column(n).to_pylist() for n in ("path", "bytes", "line"))
        first = 0
        while first < len(paths):
            last = first
            while last < len(paths) and paths[last] == paths[first]:
                last += 1
            part = b"\n".join(lines[first:last])
            if paths[first] != own:
                yield finished()
                own, size, total, states = paths[first], sizes[first], 0, [hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK)]
            else:
                part = b"\n" + part
            total += len(part)
            for state in states:
                state.update(part)
            first = last
    yield finished()


def capture_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file, whatever its size.

    A digest takes its bytes one after the other, so every file is one task, which reads it line by line, in constant memory but for its
    longest run without a line feed (at most 2 GB).  Files without content have no row, here as in ``capture_files``: Spark reads none of them.  The split size that keeps files whole is set in a session of its own.
    """
    uncut = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        uncut.conf.set(name, str(UNCUT))
    lines = uncut.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
    digests = lines.select(*meta, F.col("value").cast("binary").alias("line")).mapInArrow(_digests, "path string, capture_sha256 string")
    folder = intermediate_path(spark)
    digests.write.parquet(folder)
    found = spark.read.schema(digests.schema).parquet(folder)
    return found.select(capture_key(F.col("path"), path).alias("capture_id"), "capture_sha256")


def too_large(files: DataFrame, limit_mib: int = INPUT_LIMIT_MIB) -> DataFrame:
    """Files above the limit; zero or less turns the check off."""
    if limit_mib <= 0:
        return files.where(F.lit(False)).withColumn("mib", F.lit(0.0))
    return files.where(F.col("bytes") > limit_mib * 1024 * 1024).withColumn("mib", F.round(F.col("bytes") / (1024 * 1024), 1))

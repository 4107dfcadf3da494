"""Writing results: every table by capture, with files of bounded size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.ordering import BLOCK, with_block
from tracemill.session import cut_lineage, exists, remove


BUCKETS = 64
BUCKET = "capture_bucket"


def bucket_of(capture: str = "capture_id", buckets: int = BUCKETS) -> Column:
    """The folder of a capture: readers that look for one capture filter on it as well."""
    return F.pmod(F.xxhash64(capture), F.lit(buckets)).cast("int")


def _by_capture(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """Rows sorted by capture and order in a fixed number of folders.

    The blocks of a large capture become files of their own; small captures share the first file of their folder, where
    the sorted key keeps the statistics of row groups narrow.
    """
    rows = with_block(df.withColumn(BUCKET, bucket_of(buckets=buckets)), order)
    return rows.repartition(BUCKET, BLOCK).sortWithinPartitions(BUCKET, "capture_id", order).drop(BLOCK)


def write_detail(packets: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", buckets: int = BUCKETS) -> None:
    """Protected packets, once per packet, schema version in every row."""
    rows = _by_capture(packets.withColumn("schema_version", F.lit("1.0")), "packet_no", buckets)
    rows.write.mode(mode).partitionBy(BUCKET).format(fmt).save(path)


def write_index(index: DataFrame, path: str, mode: str = "error", buckets: int = BUCKETS) -> None:
    """Land a parsed packet index, so that later steps read columns instead of text."""
    _by_capture(index, "frame_no", buckets).write.mode(mode).partitionBy(BUCKET).parquet(path)


def replace_captures(df: DataFrame, path: str, order: str, captures: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Put the rows of ``captures`` (those in ``df`` unless given) in place of what the table at ``path`` holds of them.

    Only the folders of these captures are written, with the other captures that share them, so a run that is repeated leaves the same files.
    Rows are staged and moved in when all tasks are done; a run that fails before leaves the table as it was.  ``runs`` tells what each run wrote.
    """
    spark = df.sparkSession
    new = cut_lineage(df)
    own = cut_lineage((new if captures is None else captures).select("capture_id").distinct())
    touched = own.select(bucket_of(buckets=buckets).alias(BUCKET)).distinct()
    rows = new
    if exists(spark, path):
        old = spark.read.parquet(path).join(touched, BUCKET, "left_semi").drop(BUCKET)
        # The files that this reads are replaced below.
        rows = new.unionByName(cut_lineage(old.join(own, "capture_id", "left_anti")), allowMissingColumns=True)
    rows = cut_lineage(rows)
    _by_capture(rows, order, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    held = rows.select(bucket_of(buckets=buckets).alias(BUCKET)).distinct()
    for row in touched.join(held, BUCKET, "left_anti").collect():  # at most one row per folder
        remove(spark, f"{path}/{BUCKET}={row[0]}")
    counts = own.join(new.groupBy("capture_id").agg(F.count(F.lit(1)).alias("rows")), "capture_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    counts.withColumns({"run_id": F.lit(uuid.uuid4().hex), "written_at": F.current_timestamp()}).write.mode("append").parquet(f"{path}-runs")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id, written_at, capture_id and rows of every run that ``replace_captures`` finished."""
    return spark.read.parquet(f"{path}-runs").select("run_id", "written_at", "capture_id", "rows")


def write_summary(summary: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON document per capture and line."""
    summary.select(F.to_json(F.struct(*summary.columns)).alias("value")).write.mode(mode).text(path)


def write_pseudonyms(mapping: DataFrame, path: str, mode: str = "error") -> bool:
    """The pseudonym map, to a path of its own; nothing is written when there is none."""
    if mapping.limit(1).count() == 0:
        return False
    mapping.write.mode(mode).parquet(path)
    return True


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Several tables below one folder, such as the events, nodes and phases of a flow."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")

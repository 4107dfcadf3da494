"""Landing index exports as they arrive: the batch reader's expressions on a file stream.

The reader is the same; only the way files come in differs.  Parsing keeps no state, so the
stream needs no watermark, and the checkpoint folder makes each file count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.functions.convert import clean
from tracemill.functions.tables import INDEX_FIELDS
from tracemill.sources.index import capture_key, parse_index


def stream_index(spark: SparkSession, path: str, fields: Sequence[str] = INDEX_FIELDS, files_per_trigger: int = 1000) -> DataFrame:
    """Parsed index rows with ``is_valid``, from files that keep arriving under ``path``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    lines = lines.where(clean(F.col("value")).isNotNull())
    return parse_index(lines.select(capture_key(F.col("_metadata.file_path"), path).alias("capture_id"), "value"), fields)


def land_index(parsed: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write valid rows and rejected lines as Parquet, split by ``is_valid``; captures share files, as there may be very many."""
    writer = (
        parsed.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("is_valid")
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

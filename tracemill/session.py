"""Session defaults that the expressions rely on, and the folder for written intermediates."""

from __future__ import annotations

import atexit
import os
import pathlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when the session was started in another folder.

    The folder of the package goes to their search path, which serves all workers that see it; on a cluster without a
    shared folder install the package, or ship it with ``--py-files``.
    """
    root = str(pathlib.Path(__file__).resolve().parent.parent)
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    reach_workers(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracemill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


_OWN_FOLDER = ""


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without one gets a temporary folder of its own."""
    global _OWN_FOLDER
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _OWN_FOLDER = _OWN_FOLDER or tempfile.mkdtemp(prefix="tracemill-")
    return _OWN_FOLDER


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_RUN_FOLDERS: dict[str, SparkSession] = {}


def intermediate_path(spark: SparkSession) -> str:
    """A new path in the run folder of this process, which every executor sees."""
    folder = f"{shared_folder(spark)}/tracemill-run-{_RUN_ID}"
    _RUN_FOLDERS[folder] = spark
    return f"{folder}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the run folder of this process and read it back.

    The files lie below ``spark.checkpoint.dir``, where every executor reads them again after a loss, and
    later steps read only the columns they need.  ``drop_intermediates``, or the end of the process, deletes the folder.
    """
    spark = df.sparkSession
    path = intermediate_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediates() -> None:
    """Delete what ``cut_lineage`` wrote; results that still read it must be written first."""
    while _RUN_FOLDERS:
        folder, spark = _RUN_FOLDERS.popitem()
        try:
            remove(spark, folder)
        except Exception:  # noqa: BLE001  the session ended before; its folder is then the cluster's to clean
            continue


_RUN_ID = uuid.uuid4().hex
atexit.register(drop_intermediates)

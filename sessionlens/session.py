"""Spark session settings and the staging of intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Bytes of rows in memory per byte of a Parquet file, so that small files of many rows aren't broadcast by their size on disk.
FILE_FACTOR = 20


def build_session(app_name: str = "sessionlens", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; cluster settings stay with the submitter."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture costs a round trip per column expression; plans here have hundreds
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings that results and the size of broadcasts depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(FILE_FACTOR))
    return spark


def stage_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a session whose executors are the driver's own threads (master
    ``local[...]``) gets a temporary one where none is set; it is deleted when the driver ends."""
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sessionlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        current = context.getCheckpointDir()
    return current


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{stage_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts the lineage so that a lost executor re-reads files instead of recomputing, and gives the
    readers column pruning, filter pushdown and a known size (so joins broadcast by checked size).
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

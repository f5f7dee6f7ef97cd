"""The five activity logs: readers, the unified row and its weekly files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from sessionlens.functions import calendar

# File columns of each log and the unified row.
LOG_COLUMNS = {
    "device": ["id", "date", "user", "pc", "activity"],
    "email": ["id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "#att", "content"],
    "file": ["id", "date", "user", "pc", "filename", "content"],
    "http": ["id", "date", "user", "pc", "url", "content"],
    "logon": ["id", "date", "user", "pc", "activity"],
}
UNIFIED_COLUMNS = [
    "id", "date", "user", "pc", "type", "activity", "url", "filename", "content",
    "to", "cc", "bcc", "from", "size", "#att",
]
UNIFIED_SCHEMA = StructType([
    StructField(c, TimestampNTZType() if c == "date" else StringType()) for c in UNIFIED_COLUMNS
])
CSV_OPTIONS = {"header": "true", "escape": '"'}


def log_schema(log: str) -> StructType:
    return StructType([StructField(c, StringType()) for c in LOG_COLUMNS[log]])


def read_log(spark: SparkSession, base: str, log: str) -> DataFrame:
    """One CSV log with a header row. One record per line, so files split across tasks."""
    return spark.read.schema(log_schema(log)).options(**CSV_OPTIONS).csv(f"{base}/{log}.csv")


def read_logs(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {log: read_log(spark, base, log) for log in LOG_COLUMNS}


def unify(logs: dict[str, DataFrame]) -> DataFrame:
    """All logs as one table of 15 columns; columns a log lacks are null."""
    typed = [
        df.withColumn("date", calendar.parse_log_time(F.col("date"))).withColumn("type", F.lit(log))
        for log, df in logs.items()
    ]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed)
    missing = {c: F.lit(None).cast("string") for c in UNIFIED_COLUMNS if c not in whole.columns}
    return whole.withColumns(missing).select(*[F.col(f"`{c}`") for c in UNIFIED_COLUMNS])


def first_sunday(http: DataFrame) -> Column:
    """Day the week count starts from: the Sunday on or before the first web request."""
    first = F.min(calendar.parse_log_time(F.col("date")))
    return http.agg(calendar.sunday_on_or_before(first).alias("sunday")).scalar()


def with_week(unified: DataFrame, sunday: Column) -> DataFrame:
    return unified.withColumn("week", calendar.week_number(F.col("date"), sunday))


def write_weeks(unified_weeks: DataFrame, path: str) -> None:
    """One folder per week. Rows of a week are spread over several files: a single week may hold
    a large share of the log, so there is no one-task-per-week shuffle before the write."""
    unified_weeks.write.partitionBy("week").option("compression", "snappy").parquet(path)


def read_weeks(spark: SparkSession, path: str, weeks: list[int] | None = None) -> DataFrame:
    schema = StructType([*UNIFIED_SCHEMA.fields, *spark.read.parquet(path).select("week").schema.fields])
    df = spark.read.schema(schema).parquet(path)
    return df if weeks is None else df.where(F.col("week").isin(weeks))

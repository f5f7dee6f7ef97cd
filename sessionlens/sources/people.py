"""People files: monthly directory snapshots, psychometric scores and the insider answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sessionlens.sources.logs import CSV_OPTIONS

# Columns by position.
SNAPSHOT_COLUMNS = ["uname", "user", "email", "role", "b_unit", "f_unit", "dept", "team", "sup_name"]
TRAITS = ["O", "C", "E", "A", "N"]
ANSWER_COLUMNS = ["dataset", "scenario", "details", "user", "start", "end"]


def _strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Monthly files named ``yyyy-MM.csv``; the month comes from the file name."""
    month = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]{4}-[0-9]{2})(\.csv)?(/[^/]*)?$", 1)
    return (
        spark.read.schema(_strings(SNAPSHOT_COLUMNS)).options(**CSV_OPTIONS).csv(f"{path}/*")
        .select(*SNAPSHOT_COLUMNS, month.alias("month"))
    )


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    """Psychometric scores; an empty table where the file does not exist."""
    schema = StructType(
        [StructField("employee_name", StringType()), StructField("user", StringType())]
        + [StructField(t, DoubleType()) for t in TRAITS]
    )
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(jvm_path):
        return spark.createDataFrame([], schema).drop("employee_name")
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path).drop("employee_name")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """The insider index. Columns are matched by name; unknown extra columns are ignored."""
    raw = spark.read.options(**CSV_OPTIONS).csv(path)
    return raw.select(*[F.col(c).cast("string").alias(c) for c in ANSWER_COLUMNS])


def read_answer_details(spark: SparkSession, path: str) -> DataFrame:
    """Action lists of all insiders: folder ``r4.2-<scenario>``, one file each, no quoted commas.

    Position 1 is the action id, position 3 the user. The header line is recognised by its first
    field. A listed file that does not exist simply has no rows here.
    """
    lines = spark.read.option("wholetext", "false").text(f"{path}/r4.2-*/*").select(
        "value",
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("details"),
        F.regexp_extract(F.col("_metadata.file_path"), r"/r4\.2-([^/]+)/", 1).alias("scenario"),
    )
    return parse_answer_details(lines)


def parse_answer_details(lines: DataFrame) -> DataFrame:
    part = F.split("value", ",")

    def field(i: int):
        return F.regexp_replace(F.get(part, F.lit(i)), '^"+|"+$', "")

    rows = lines.where((F.trim("value") != "") & (F.lower(F.trim(field(1))) != "id"))
    return rows.select("scenario", "details", field(1).alias("id"), field(3).alias("user"))

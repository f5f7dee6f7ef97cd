"""Registration and the output form shared by both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a ``Shapes`` object under ``name``."""

    def register(build):
        from catalog.shapes import shapes

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(shapes(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, others rounded to six places (never -0.0), times and lists as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.array_join(c, ",")
        out.append(c.alias(field.name))
    return df.select(*out)


# --- SQL text helpers ---------------------------------------------------------------------------

def big(expr: str, name: str) -> str:
    return f'CAST({expr} AS BIGINT) AS "{name}"'


def num(expr: str, name: str) -> str:
    return f'ROUND(CAST({expr} AS DOUBLE), 6) + 0.0 AS "{name}"'


def when(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS \"{name}\""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)

"""Raw files to the session table.

``base`` holds the five logs, ``LDAP/`` and ``psychometric.csv``; ``answers`` holds
``insiders.csv`` and the action lists. Run as ``spark-submit ... -m sessionlens.plans.etl base answers out``.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.operators import activity, directory, sessions
from sessionlens.session import build_session, fresh_path, prepare, stage
from sessionlens.sources import logs, people


def session_table(spark: SparkSession, base: str, answers: str, limit: int | None = None) -> DataFrame:
    """The 128-column table. The weekly log, the user table and the action pairs are kept as files
    on the way, as they are read by several steps."""
    prepare(spark)
    read = logs.read_logs(spark, base)
    path = fresh_path(spark, "weeks")
    logs.write_weeks(logs.with_week(logs.unify(read), logs.first_sunday(read["http"])), path)
    weeks = logs.read_weeks(spark, path)
    folk = stage(directory.resolve_supervisor(directory.directory(
        people.read_snapshots(spark, f"{base}/LDAP"), people.read_traits(spark, f"{base}/psychometric.csv"))), "people")
    index = people.read_answers(spark, f"{answers}/insiders.csv")
    users = stage(directory.user_table(folk, weeks, index), "users")
    details = people.read_answer_details(spark, answers)
    pairs = stage(directory.malicious_pairs(directory.insider_index(index), details), "pairs")
    return sessions.session_table(activity.row_features(weeks), users, pairs, limit)


def write_sessions(table: DataFrame, path: str) -> None:
    """The session table as files of one declared schema: counts, codes, times and labels as whole numbers,
    means and scores as doubles."""
    table.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in session_schema(table)]).write.option(
        "compression", "snappy").parquet(path)


def session_schema(table: DataFrame) -> list[tuple[str, str]]:
    """(column, type) in table order; the type follows from what a column measures."""
    return [(c, "double" if "_mean_" in c or c in sessions.USER_COLUMNS[6:] or c == "duration" else kind)
            for c, kind in table.dtypes]


def main() -> None:
    base, answers, out = sys.argv[1:4]
    spark = build_session("session-table")
    write_sessions(session_table(spark, base, answers), out)
    spark.stop()


if __name__ == "__main__":
    main()

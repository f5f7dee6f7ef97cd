"""Session settings."""

from pyspark.sql import functions as F

from sessionlens.session import prepare, stage


def test_many_rows_in_a_small_file_are_not_broadcast(spark):
    """Equal texts shrink in a file: a million rows of 300 MB in memory take about 4 MB on disk."""
    prepare(spark)
    people = stage(spark.range(1_000_000).select("id", F.lit("x" * 300).alias("name")), "people")
    small = stage(spark.range(50).select("id", F.lit("y").alias("team")), "teams")
    rows = stage(spark.range(3_000_000).select("id", F.lit("z" * 50).alias("act")), "rows")
    plan = lambda table: rows.join(table, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan(people)
    assert "BroadcastHashJoin" in plan(small)

"""NaN as a missing value, categories and classes without limits, staging folders."""

import math

import pytest
from pyspark.sql import functions as F

from sessionlens import session
from sessionlens.operators import neighbours, ordering, preparation, sampling, sequences


def test_nan_never_displaces_a_value(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        df = spark.range(0, 8020, 1, 1).select(F.when(F.col("id") < 8000, F.lit(math.nan)).otherwise(F.col("id") % 20).alias("x"))
        assert preparation.few_values(df, ["x"], 5).first()["values"] == 6
        assert not preparation.binary_columns(df, ["x"]).first()["binary"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_value_beside_nan_is_dead(spark):
    df = spark.createDataFrame([(1.0, 1.0), (math.nan, 2.0)], "a double, b double")
    got = {r["column"]: r["dead"] for r in preparation.dead_columns(df, ["a", "b"]).collect()}
    assert got == {"a": True, "b": False}


def test_frequencies_leave_nulls_out(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    got = sorted(r["c"] for r in preparation.frequency_encode(df, df, ["c"]).collect())
    assert got == pytest.approx([0.01, 1 / 3, 2 / 3, 2 / 3])


def test_categories_of_any_size(spark):
    df = spark.range(1001).select(F.format_string("v%04d", "id").alias("c"), "id")
    got = {r["id"]: r["c_index"] for r in preparation.one_hot_index(df, df, "c").collect()}
    assert got[0] is None and all(got[i] == i - 1 for i in range(1, 1001))
    assert len(preparation.levels(df, "c")) == 1001
    assert preparation.one_hot(df, df, "c", ["v0000", "v0003"]).where("c_v0003 = 1").first()["id"] == 3


def test_neighbours_in_many_classes(spark):
    df = spark.range(2010).select("id", (F.col("id") % 1005).alias("c"), F.array(F.col("id").cast("double")).alias("x"))
    assert neighbours.nearest_in_class(df, "c", "id", "x", 1, block_rows=1).count() == 2010


def test_a_class_of_one_row_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, [0.0]), (2, 0, [1.0]), (3, 0, [2.0])], "id long, y int, x array<double>")
    with pytest.raises(Exception, match="no neighbour"):
        sampling.smote(df, "y", "id", "x", {1: 4}).collect()


def test_slices_of_a_user_are_dealt_out(spark):
    rows = spark.range(400).select(
        F.lit("u").alias("user"), F.lit("train").alias("split"), F.col("id").alias("starttime"), F.col("id").alias("sessionid"), F.lit(0).alias("insider"))
    dealt = rows.repartition("user")
    made = ordering.frames(dealt, ["split", "user"], sequences.USER_AXIS, after=2, limit=50)
    assert made.cut
    plan = made.df._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in plan.split("hashpartitioning(split")[1].split(")")[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len({r[0] for r in made.df.select(F.spark_partition_id()).collect()}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_staging_needs_a_shared_folder(monkeypatch, spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key, default=None):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        conf = sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.stage_dir(Session())


def test_auc_of_tiny_scores(spark):
    from sessionlens.operators import evaluation

    values = [10.0 ** -(k % 40) * (1 + k / 1000) for k in range(120)] + [0.0, 0.0, 1.0]
    rows = [("g", v, k % 3 == 0) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, s double, pos boolean")
    pairs = [(a[1], b[1]) for a in rows if a[2] for b in rows if not b[2]]
    want = sum((x > y) + (x == y) / 2 for x, y in pairs) / len(pairs)
    assert evaluation.rank_auc(df, ["g"], "s", "pos", limit=4).first()["auc"] == pytest.approx(want)
    order = df.selectExpr("s", evaluation.score_bucket("s") + " as b").orderBy("s").collect()
    assert [r["b"] for r in order] == sorted(r["b"] for r in order) and len({r["b"] for r in order}) > 100


def test_gate_clamp_is_exact(spark):
    from sessionlens.operators import cascade

    counts = spark.createDataFrame([(0.1, 0.99, 0.5), (0.3, 0.9, 0.2), (0.6, 0.4, 0.1)], "threshold double, recall double, fpr double")
    assert [cascade.gate_threshold(counts, t, clamp=True).first()["threshold"] for t in (0.995, 0.95, 0.9, 0.4)] == [0.01, 0.1, 0.15, 0.15]

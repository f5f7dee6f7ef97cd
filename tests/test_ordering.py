"""Sliced ordering against plain pandas, with a limit small enough that large groups are cut."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import ordering as o

AXIS = o.time_axis("ts", "id")


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(900):
        user = "hot" if i % 3 == 0 else f"u{rnd.randrange(40)}"
        data.append((i, user, start + dt.timedelta(seconds=rnd.randrange(400_000)), rnd.randrange(5)))
    return spark.createDataFrame(data, "id long, user string, ts timestamp_ntz, v long").cache()


def ordered(rows):
    return rows.toPandas().sort_values(["user", "ts", "id"]).reset_index(drop=True)


def test_large_group_is_cut_into_bounded_slices(rows):
    sliced = o.with_slices(rows, ["user"], AXIS, 20).df
    sizes = sliced.groupBy("user", o.SLICE).count().toPandas()
    hot = sizes[sizes.user == "hot"]
    assert len(hot) >= 10 and hot["count"].max() <= 40
    assert sorted(hot[o.SLICE]) == list(range(len(hot)))
    assert sliced.count() == rows.count()
    whole = sizes.groupby("user")["count"].sum()
    cold = sizes[sizes.user.isin(whole[whole <= 20].index)]
    assert (cold[o.SLICE] == 0).all()


@pytest.mark.parametrize("limit", [7, 50, 10_000])
def test_row_index_and_running_sum(rows, limit):
    got = o.running(
        o.row_index(rows, ["user"], AXIS, "n", limit), ["user"], AXIS, {"total": F.col("v")}, limit
    ).toPandas().sort_values(["user", "ts", "id"]).reset_index(drop=True)
    want = ordered(rows)
    assert (got["n"] == want.groupby("user").cumcount()).all()
    assert (got["total"] == want.groupby("user")["v"].cumsum()).all()


@pytest.mark.parametrize("limit", [7, 10_000])
def test_next_row_with_and_without_condition(rows, limit):
    sliced = o.with_slices(rows, ["user"], AXIS, limit)
    nxt = o.with_next(sliced, F.col("id"), "nid")
    nxt = o.with_next(nxt, F.col("id"), "nid2", among=F.col("v") == 2)
    got = nxt.df.toPandas().sort_values(["user", "ts", "id"]).reset_index(drop=True)
    want = ordered(rows)
    assert got["nid"].fillna(-1).tolist() == want.groupby("user")["id"].shift(-1).fillna(-1).tolist()
    two = got[got.v == 2]
    want2 = want[want.v == 2].groupby("user")["id"].shift(-1)
    assert two["nid2"].fillna(-1).tolist() == want2.fillna(-1).tolist()


@pytest.mark.parametrize("limit", [3, 11, 10_000])
def test_frames_reach_across_slices(rows, limit):
    framed = o.frames(rows, ["user"], AXIS, before=2, after=3, limit=limit)
    w = framed.window
    got = (
        framed.df.withColumn("near", F.collect_list("id").over(w.rowsBetween(-2, 3)))
        .where(~F.col(o.HALO))
        .toPandas()
        .sort_values(["user", "ts", "id"])
        .reset_index(drop=True)
    )
    want = ordered(rows)
    for user, group in want.groupby("user"):
        ids = group["id"].tolist()
        mine = got[got.user == user]["near"].tolist()
        assert [list(m) for m in mine] == [ids[max(0, i - 2): i + 4] for i in range(len(ids))]


def test_cut_points_select_exact_counts(rows):
    cut = o.cut_points(rows, ["user"], AXIS, {"half": F.floor(F.col("_n") * 0.5), "none": F.lit(0)})
    joined = rows.join(cut, "user").where(F.struct("ts", "id") <= F.col("half"))
    got = joined.groupBy("user").count().toPandas().set_index("user")["count"]
    want = (ordered(rows).groupby("user").size() // 2)
    want = want[want > 0]
    assert got.sort_index().equals(want.sort_index().rename("count")) or (got.sort_index() == want.sort_index()).all()
    assert cut.where(F.col("none").isNotNull()).count() == 0


def test_text_index_of_keys_that_share_their_first_bytes(spark):
    """10^5 keys of one 20-byte prefix and a small limit: right numbers, and no part above the limit."""
    df = spark.range(100_000).select(F.concat(F.lit("U" * 20), F.lpad(F.hex(F.xxhash64("id")), 16, "0")).alias("w"))
    parts = o.ordered_parts(df, ["w"], 3_000).groupBy("_part").count().toPandas()
    assert len(parts) >= 34 and parts["count"].max() <= 3_000
    got = o.text_index(df, ["w"], "i", limit=3_000).toPandas().sort_values("w")
    assert got["i"].tolist() == list(range(100_000))


@pytest.mark.parametrize("limit", [2, 50, 1000])
def test_text_index_by_code_points(spark, limit):
    words = sorted({f"w{i:04d}" for i in range(300)} | {"", "é", "Z", "\U0001f600", "\uffee", "z"})
    df = spark.createDataFrame([(w,) for w in words[::-1]], "w string")
    got = {r["w"]: r["i"] for r in o.text_index(df, ["w"], "i", limit=limit).collect()}
    assert got == {w: i for i, w in enumerate(words)}


def test_join_splits_a_hot_key(spark):
    """With broadcasts off and a user of a third of all rows, no task gets more than the limit of them."""
    from sessionlens.operators import skew

    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("u"), F.col("id") % 997)).alias("user"))
    table = spark.createDataFrame([("hot", 7)] + [(f"u{i}", i) for i in range(900)], "user string, v long")
    plain = {tuple(r) for r in rows.join(table, "user", "left").select("id", "user", "v").collect()}
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("-1", "false", "200")):
            spark.conf.set(k, v)
        joined = skew.join_by_key(rows, table, "user", 1_000)
        assert {tuple(r) for r in joined.select("id", "user", "v").collect()} == plain
        tasks = joined.where("user = 'hot'").groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert len(tasks) > 10 and tasks.max() < 1_700  # two salts may meet in a task
        plan = joined.groupBy("v").count()._jdf.queryExecution().toString()
        assert "_salt" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {tuple(r) for r in skew.join_by_key(rows, table, "user").select("id", "user", "v").collect()} == plain

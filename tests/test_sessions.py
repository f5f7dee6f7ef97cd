"""Session boundaries, USB pairing, overlaps and ids against slow, plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import activity, ordering, sessions

START = dt.datetime(2024, 1, 7)


def walk(acts):
    """Session number and end state per row, from the description of the rules."""
    numbers, ends, number, is_open = [], {}, 0, False
    for act in acts:
        if not is_open:
            number, is_open = number + 1, True
        elif act == 1:
            ends[number] = 2
            number += 1
        elif act == 2:
            ends[number] = 1
            is_open = False
        numbers.append(number)
    return numbers, [ends.get(n, 0) for n in numbers]


@pytest.fixture(scope="module")
def trace(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(700):
        user = "hot" if i % 2 else f"u{rnd.randrange(12)}"
        at = START + dt.timedelta(seconds=rnd.randrange(300_000))
        rows.append((0, user, f"PC-{rnd.randrange(2)}", at, f"E{i:05d}", rnd.choice([1, 2, 2, 2, 3, 4, 5]), 8, 1))
    schema = "week int, user string, pcid string, time_stamp timestamp_ntz, actid string, act int, day int, time int"
    return spark.createDataFrame(rows, schema).cache()


def plain(trace):
    df = trace.toPandas().sort_values(["user", "pcid", "time_stamp", "actid"]).reset_index(drop=True)
    for _, group in df.groupby(["user", "pcid"]):
        numbers, ends = walk(group["act"].tolist())
        df.loc[group.index, "seq"] = numbers
        df.loc[group.index, "end"] = ends
    return df


@pytest.mark.parametrize("limit", [9, 40, 10_000])
def test_sessionize_matches_the_rules(trace, limit):
    got = sessions.with_sessions(trace, limit).toPandas().sort_values(
        ["user", "pcid", "time_stamp", "actid"]).reset_index(drop=True)
    want = plain(trace)
    assert got["session_seq"].tolist() == want["seq"].astype(int).tolist()
    ends = got.groupby(["user", "pcid", "session_seq"])["_end"].transform("max")
    assert ends.tolist() == want["end"].astype(int).tolist()


@pytest.mark.parametrize("limit", [9, 10_000])
def test_usb_duration_pairs_across_slices(trace, limit):
    sliced = ordering.with_slices(trace, activity.SESSION_KEYS, activity.AXIS, limit)
    got = {r["actid"]: r["usb_dur"] for r in activity.usb_durations(sliced).df.collect()}
    df = plain(trace)
    device = df[df["act"].isin([3, 4])].copy()
    following = device.groupby(["user", "pcid"])[["act", "time_stamp"]].shift(-1)
    paired = (device["act"] == 3) & (following["act"] == 4)
    want = (following["time_stamp"] - device["time_stamp"]).dt.total_seconds().where(paired, 0)
    for actid, seconds in zip(device["actid"], want):
        assert got[actid] == int(seconds)


@pytest.mark.parametrize("limit", [15, 10_000])
def test_overlaps_and_ids(trace, limit):
    numbered = sessions.with_sessions(trace, usb=False)
    spans = numbered.groupBy(*sessions.SESSION_ID).agg(
        F.min("time_stamp").alias("_from"), F.max("time_stamp").alias("_to"), F.max("_end").alias("end_with"),
        F.max("_close").alias("_close")).withColumn("user_int", F.crc32("user") % 1000)
    want = spans.toPandas()
    overlaps = sessions.concurrency(spans, limit).toPandas().set_index(sessions.SESSION_ID)["n_concurrent_sessions"]
    for r in want.itertuples():
        mine = want[want.user == r.user]
        n = ((mine["_from"] < r._6) & (mine["_to"] > r._5)).sum()
        assert overlaps[(r.week, r.user, r.pcid, r.session_seq)] == n
    ids = sessions.session_ids(spans, limit).toPandas()
    ids["open"] = (ids["end_with"] == 0).astype(int)
    ids["at"] = ids["_close"].where(ids["open"] == 0, ids["_from"])
    ids = ids.sort_values(["user_int", "open", "at", "_from", "pcid", "session_seq"])
    assert ids["sessionid"].tolist() == list(range(len(ids)))


def test_column_contract():
    assert len(sessions.SESSION_COLUMNS) == 128
    assert len(sessions.feature_columns()) == 98


def test_spans_end_where_a_month_is_missing(spark):
    """More months than a whole number has bits, gaps on either side of its border and none."""
    from sessionlens.operators import directory

    months = [f"{2000 + i // 12}-{1 + i % 12:02d}" for i in range(140)]
    seen = {"a": range(140), "b": [3, 4, 6, 7], "c": range(50, 62), "d": range(61, 130), "e": [60, 61, 62, 64], "f": [139],
            "g": range(10, 124), "h": [0, 62, 124], "i": range(0, 61)}
    rnd = random.Random(3)
    profiles = [{c: rnd.choice("xyz") for c in directory.PROFILE} for _ in range(40)]
    rows = [(u, months[i], *rnd.choice(profiles).values()) for u, places in seen.items() for i in places for _ in range(rnd.randint(1, 2))]
    rows.append(("n", None, *profiles[0].values()))
    df = spark.createDataFrame(rows, "user string, month string, " + ", ".join(f"{c} string" for c in profiles[0]))
    got = {r["user"]: (r["wstart"], r["wend"]) for r in directory.employment_span(df).collect()}
    want = {}
    for u, places in seen.items():
        end = min(i for i in places if i + 1 not in places) + 1
        want[u] = (months[min(places)], months[end] if end < 140 else None)
    assert got == want
    first = {r["user"]: tuple(r)[1:] for r in directory.first_profile(df).collect()}
    for u in [*seen, "n"]:
        assert first[u] == min((r[1] or "", r[2:]) for r in rows if r[0] == u)[1]


def test_wide_aggregates_deal_rows_over_tasks(spark):
    few = spark.range(50).select((F.col("id") % 7).alias("user"))
    assert ordering.dealt(few, ["user"], 50) is few
    n = 40 * ordering.ROWS_PER_TASK
    assert ordering.dealt(few, ["user"], n).rdd.getNumPartitions() == 40


def test_mails_are_grouped_only_where_an_event_names_them(spark):
    from catalog.shapes import Shapes

    s = Shapes(spark, "/root/testdata/sf0.001")
    from sessionlens.session import stage

    keys = stage(s.table("orders").where("o_orderkey % 7 = 3").select(F.col("o_orderkey").alias("_key")), "mail-keys")
    want = s.mails.where("o_orderkey % 7 = 3")
    got = s.sent(keys)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_pca_scales_by_the_population_deviation(spark):
    import numpy as np

    from sessionlens.operators import learners

    x = np.random.default_rng(5).normal(size=(60, 3)) * [1, 5, 0.1] + [0, 3, 9]
    x = np.hstack([x, np.full((60, 1), 4.0)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, features array<double>")
    got = learners.pca_project(df, "features", 4, most=2).orderBy("id").toPandas()
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    assert np.allclose(np.array(got["features"].tolist()), z)
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(np.array(got["components"].tolist())), np.abs(z @ axes.T))

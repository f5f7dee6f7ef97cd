"""Windows and history features: cut groups give the same rows as whole ones."""

import random

import pytest

from sessionlens.operators import sequences as seq


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else f"u{rnd.randrange(9)}", float(rnd.randrange(500_000)), i, rnd.choice([0, 0, 1, 2, 3]),
             float(rnd.randrange(6)), float(rnd.randrange(6))) for i in range(400)]
    return spark.createDataFrame(rows, "user string, starttime double, sessionid long, insider int, a double, b double").cache()


@pytest.mark.parametrize("rule,size,step", [("max", 3, 1), ("last", 4, 1), ("majority", 5, 2)])
@pytest.mark.parametrize("limit", [8, 10_000])
def test_windows(table, rule, size, step, limit):
    got = seq.sequence_windows(table, ["a", "b"], size, step, rule, limit=limit).collect()
    got = {(r["user"], r["window_no"]): ([list(v) for v in r["features"]], r["y"]) for r in got}
    df = table.toPandas().sort_values(["user", "starttime", "sessionid"])
    want = {}
    for user, group in df.groupby("user"):
        labels, feats = group["insider"].tolist(), group[["a", "b"]].values.tolist()
        for i in range(0, len(group) - size + 1, step):
            ys = labels[i: i + size]
            counts = {c: ys.count(c) for c in (1, 2, 3)}
            most = max(counts.values())
            top = min(c for c in counts if counts[c] == most) if most >= 2 else 0
            want[(user, i)] = (feats[i: i + size], {"max": max(ys), "last": ys[-1], "majority": top}[rule])
    assert got == want


@pytest.mark.parametrize("limit", [7, 10_000])
def test_history_features(table, limit):
    got = seq.temporal_features(table, ["a", "b"], limit=limit).toPandas().set_index("sessionid")
    df = table.toPandas().sort_values(["user", "starttime", "sessionid"]).set_index("sessionid")
    assert len(got) == len(df)
    for c in ("a", "b"):
        previous = df.groupby("user")[c].transform(lambda s: s.shift(1).rolling(5, min_periods=1).mean())
        rank = df.groupby("user")[c].transform(lambda s: s.rolling(6, min_periods=1).rank(pct=True)) * 100 - 50
        diff = (df[c] - previous).fillna(0)
        assert (got[f"{c}_meandiff"].reindex(df.index) - diff).abs().max() < 1e-9
        assert (got[f"{c}_pct"].reindex(df.index) - rank).abs().max() < 1e-9

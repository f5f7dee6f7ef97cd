"""Files to session table, and the model operators."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.shapes import shapes
from sessionlens.operators import learners
from sessionlens.operators import preparation, splits
from sessionlens.plans import cascades, etl
from sessionlens.sources import people

SF = "/root/testdata/sf0.001"


def test_raw_files_give_the_same_session_table(spark, tmp_path):
    s = shapes(spark, SF)
    base, answers = tmp_path / "logs", tmp_path / "answers"
    (base / "LDAP").mkdir(parents=True)
    answers.mkdir()
    for log, df in s.logs().items():
        df.toPandas().to_csv(base / f"{log}.csv", index=False)
    months = s.snapshots().select(*people.SNAPSHOT_COLUMNS, "month").toPandas()
    for month, rows in months.groupby("month"):
        rows.drop(columns="month").to_csv(base / "LDAP" / f"{month}.csv", index=False)
    traits = s.traits().toPandas()
    traits.insert(0, "employee_name", "x")
    traits.to_csv(base / "psychometric.csv", index=False)
    s.answers().toPandas().to_csv(answers / "insiders.csv", index=False)
    for (scenario, details), rows in s.details().toPandas().groupby(["scenario", "details"]):
        folder = answers / f"r4.2-{scenario}"
        folder.mkdir(exist_ok=True)
        (folder / details).write_text("type,id,date,user,pc\n" + "\n".join(rows["value"]) + "\n")

    made = etl.session_table(spark, str(base), str(answers))
    assert made.columns == s.sessions.columns and len(made.columns) == 128
    assert made.count() == s.sessions.count()
    assert made.exceptAll(s.sessions).isEmpty()


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        y = int(i % 10 == 0) * int(1 + (i // 10) % 3)
        rows.append((i, y, [float(v) for v in rng.normal(size=4) + y]))
    return spark.createDataFrame(rows, "id long, y int, features array<double>").cache()


def test_gate_history_and_importance(windows):
    train, val = windows.where("id % 3 <> 0"), windows.where("id % 3 = 0")
    gate = learners.train_gate(train, val, rounds=4, depth=2)
    history = learners.loss_history(gate, {"train": train, "valid": val}).toPandas()
    assert len(history) == 2 * gate.getNumTrees and np.allclose(history["error"] + history["accuracy"], 1)
    final = learners.score(gate, val).select(((F.get("p", F.lit(1)) > 0.5) != (F.col("y") > 0)).cast("double").alias("e"))
    last = history[history.part == "valid"].sort_values("round")["error"].iloc[-1]
    assert abs(final.agg(F.avg("e")).first()[0] - last) < 1e-9
    importance = learners.feature_importance(gate, ["a", "b", "c", "d"]).toPandas()
    assert abs(importance["importance"].sum() - 1) < 1e-6


def test_expert_renumbers_its_classes(windows):
    expert = learners.train_expert(windows, {0: 0, 2: 1, 3: 2}, {1: 5.0}, trees=3, depth=3)
    assert len(learners.score(expert, windows, "e").first()["e"]) == 3


def test_components_are_capped(windows):
    made = learners.pca_project(windows, "features", 4, most=2)
    assert len(made.first()["components"]) == 2


def test_skew_treatment_equals_pandas(spark):
    sessions = shapes(spark, SF).sessions
    prepared, names, numeric = cascades.skew_prepared(sessions)
    columns = preparation.feature_columns(sessions)
    split = splits.time_user_split(sessions).toPandas().set_index(["user", "sessionid"]).sort_index()
    split[columns] = split[columns].astype(float).fillna(0)
    train = split[split.split == "train"]
    few = [c for c in columns if train[c].nunique() <= 5]
    kept = [c for c in columns if c not in few and train[c].std() > 0]
    guarded = ("n_", "file_", "email_", "http_", "usb", "logon")
    kept = [c for c in kept if c.startswith(guarded) or (train[c] == 0).mean() <= 0.99]
    assert numeric == kept and names == [c for c in columns if c in few or c in kept]
    skewed = [c for c in kept if train[c].nunique() > 10 and abs(train[c].skew()) > 3]
    split[skewed] = np.sign(split[skewed]) * np.log1p(split[skewed].abs())
    train = split[split.split == "train"]
    want = (split[kept] - train[kept].mean()) / train[kept].std(ddof=0)
    got = prepared.toPandas().set_index(["user", "sessionid"]).sort_index()
    assert skewed and np.allclose(got[kept].astype(float), want, atol=1e-6)
    assert np.allclose(got[few].astype(float), split[few])


def test_gate_cascade_reports_every_test_window(spark):
    sessions = shapes(spark, SF).sessions
    small = cascades.GateSettings(window=3, rounds=2, gate_depth=2, trees=2, depth=3)
    called = cascades.gate_called(sessions, small).toPandas()
    assert called["id"].is_unique and called["threshold"].nunique() == 1 and 0 < called["threshold"][0] <= 0.2
    assert ((called["gate"] >= called["threshold"]) == (called["suspect"] == 1)).all()
    assert (called.loc[called["suspect"] == 0, "final"] == 0).all() and called["final"].isin(range(4)).all()
    report = cascades.gate_cascade(sessions, small).toPandas()
    assert set(report["tier"]) == {"gate", "final"}


def test_user_cascade_judges_unseen_users(spark):
    sessions = shapes(spark, SF).sessions
    small = replace(cascades.USERS, benign=600, synthetic=40, trees=2, depth=3)
    called = cascades.user_called(sessions, small, clusters=3).toPandas()
    parts = splits.user_fold_split(sessions).toPandas()
    test = parts[parts.split == "test"]
    assert set(called["id"] // 2**32) <= set(test["user"]) and called["id"].is_unique
    assert len(called) == (test.groupby("user").size() - 3).clip(lower=0).sum()
    assert (called.loc[called["pred"] != 0, "final"] == called.loc[called["pred"] != 0, "pred"]).all()
    assert called["final"].isin(range(4)).all()


def test_steps_are_scaled_per_feature(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(40, 3, 2)) * [5, 1] + [2, 7]
    data[:, :, 1] = 4
    frame = spark.createDataFrame([(v.tolist(),) for v in data], "features array<array<double>>")
    got = np.array([r["features"] for r in preparation.scale_steps(frame, frame, "features", 2).collect()])
    flat = data.reshape(-1, 2)
    assert np.allclose(np.sort(got.ravel()), np.sort(((data - flat.mean(0)) / [flat[:, 0].std(), 1]).ravel()))


def test_gate_cascade_writes_windows_once(spark, monkeypatch):
    """Windows of all parts are written once, scored where they are read; scaled sessions go straight into windows."""
    sessions = shapes(spark, SF).sessions
    written, plain = [], cascades.stage

    def noted(df, name, *rest):
        made = plain(df, name, *rest)
        written.append((name, df.columns, made.count()))
        return made

    monkeypatch.setattr(cascades, "stage", noted)
    small = cascades.GateSettings(window=3, rounds=2, gate_depth=2, trees=2, depth=3)
    called = cascades.gate_called(sessions, small)
    wide = {name: n for name, columns, n in written if "features" in columns}
    assert set(wide) == {"windows", "hard"} and wide["hard"] < wide["windows"]
    assert [name for name, *_ in written] == ["split", "windows", "hard"]
    assert 0 < called.count() < wide["windows"]

"""Registered queries against their SQL on the given tables, and whole tables with cut groups."""

import duckdb
import pytest

import catalog
from catalog.shapes import shapes
from sessionlens.operators import sessions, splits

catalog.load()
SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
CHECKED = ["session_table", "activity_features", "malicious_acts", "shared_pcs", "time_user_split", "user_split", "user_fold_split",
           "user_fold_split_fallback", "binary_columns",
           "frequency_encode", "windows_majority", "window_label_counts", "temporal_pct", "temporal_meandiff", "smote",
           "hard_negatives", "gate_thresholds", "classification_report", "auc_mu", "standard_scale_per_lag"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    rows = [tuple("~" if v is None or v != v else float(v) if isinstance(v, (int, float)) else str(v) for v in r)
            for r in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_session_table_is_the_same_when_groups_are_cut(spark):
    s = shapes(spark, SF)
    whole = s.sessions
    cut = sessions.session_table(s.rows(), s.users, s.pairs, limit=4)
    assert cut.count() == whole.count()
    assert cut.exceptAll(whole).isEmpty()


def test_no_known_insider_reaches_the_test_part(spark):
    split = splits.time_user_split(shapes(spark, SF).sessions)
    known = {r["user"] for r in split.where("split <> 'test' AND insider <> 0").collect()}
    assert not known & {r["user"] for r in split.where("split = 'test'").collect()}


def test_folds_balance_labels_and_sizes(spark):
    rows = [(f"u{i}", int(i < 31) + int(i < 7), 1 + (i * i) % 97) for i in range(400)]
    users = spark.createDataFrame(rows, "user string, insider int, n int")
    dealt = splits.deal_folds(users, 5, "insider", "user", "n")
    cut = splits.deal_folds(users, 5, "insider", "user", "n", limit=20)
    assert dealt.exceptAll(cut).isEmpty() and cut.exceptAll(dealt).isEmpty()
    got = dealt.toPandas()
    assert len(got) == 400 and got["user"].is_unique
    for label, part in got.groupby("insider"):
        heads, sizes = part.groupby("fold").size(), part.groupby("fold")["n"].sum()
        assert heads.max() - heads.min() <= 1 and len(heads) == 5
        assert sizes.max() - sizes.min() <= part["n"].max()


def test_no_user_is_in_two_parts_and_an_eighth_is_drawn(spark):
    rows = [(f"u{i}", k, int(i < 6 and k == 0) * (1 + i % 3)) for i in range(60) for k in range(1 + i % 4)]
    sessions = spark.createDataFrame(rows, "user string, sessionid int, insider int")
    for folds, val in ((3, None), (1000, 6)):
        got = splits.user_fold_split(sessions, val_folds=folds).toPandas()
        assert len(got) == len(rows) and (got.groupby("user")["split"].nunique() == 1).all()
        heads = got.groupby("split")["user"].nunique()
        assert heads["test"] == 12 and (val is None or heads["val"] == val)
    empty = splits.user_fold_split(sessions.limit(0))
    assert empty.count() == 0 and "split" in empty.columns

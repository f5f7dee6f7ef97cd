"""Golden rows for the code tables and every decision rule over a probability grid."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import calendar, content, scalars
from sessionlens.operators import cascade, directory
from sessionlens.sources import logs, people


def one(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_time_codes(spark):
    times = ["2024-01-02 17:30:59", "2024-01-02 17:31:00", "2024-01-02 07:29:59", "2024-01-06 12:00:00", "2024-01-07 23:00:00"]
    rows = [(dt.datetime.fromisoformat(t),) for t in times]
    got = one(spark, rows, "t timestamp_ntz", code=calendar.time_code(F.col("t")), day=calendar.day_number(F.col("t")),
              week=calendar.week_number(F.col("t"), F.lit("2023-12-31").cast("date")))
    assert [g["code"] for g in got] == [1, 2, 2, 3, 4]
    assert [g["week"] for g in got] == [0, 0, 0, 0, 1] and got[0]["day"] == 5118


def test_email_edge_cases(spark):
    rows = [(None, "  ", None, None, None, None), ("a@dtaa.com;b@x.org", "", "c@y.org", "12", "2", "two words"),
            ("dtaa.com@dtaa.com", None, None, "1", None, "  ")]
    cols = [F.col(c) for c in ("to", "cc", "bcc", "size", "att", "content")]
    got = one(spark, rows, "to string, cc string, bcc string, size string, att string, content string",
              **content.email_features(*cols))
    assert [g["n_des"] for g in got] == [0, 3, 1]
    assert [g["n_exdes"] for g in got] == [0, 2, -1]
    assert [g["Xemail"] for g in got] == [0, 1, 0] and [g["exbccmail"] for g in got] == [0, 1, 0]
    assert [g["email_text_nwords"] for g in got] == [0, 2, 0]


def test_web_edge_cases(spark):
    urls = ["http://www.dropbox.com/x", "http://host.without.slash", "http://a.b.co.uk/p/q", "http://sub.bbc.com/",
            "http://m.facebook.com/a", "http://job-hunt.org/", "http://x.aol.com/recruit", "http://akeylogger.net/", "", None,
            "http://wikileaks.org/", "http://drive.google.com/f"]
    got = one(spark, [(u,) for u in urls], "u string", d=content.url_domain(F.col("u")),
              **content.url_features(F.col("u"), F.lit(None).cast("string")))
    assert [g["d"] for g in got] == ["dropbox.com", "", "a.b.co.uk", "bbc.com", "facebook.com", "job-hunt.org", "aol.com",
                                     "akeylogger.net", "", "", "wikileaks.org", "drive.google.com"]
    assert [g["http_type"] for g in got] == [3, 1, 1, 1, 2, 4, 4, 6, 1, 1, 5, 3]
    assert got[0]["http_c_nwords"] == 1 and got[8]["url_depth"] == 0 and got[2]["url_depth"] == 2


def test_file_edge_cases(spark):
    names = ["C:\\a\\b.ZIP", "R:\\noextension", "x.tar.exe", None]
    got = one(spark, [(n,) for n in names], "n string", e=content.file_extension(F.col("n")),
              **content.file_features(F.col("n"), F.lit("")))
    assert [g["e"] for g in got] == ["zip", "unknown", "exe", "unknown"]
    assert [g["file_type"] for g in got] == [2, 1, 6, 1] and [g["disk"] for g in got] == [1, 2, 0, 0]
    assert [g["file_depth"] for g in got] == [2, 1, 0, 0] and got[0]["file_nwords"] == 1


def test_small_scalars(spark):
    rows = [(float("inf"), "12.5"), (float("nan"), "x"), (-2.0, None)]
    got = one(spark, rows, "v double, t string", clean=scalars.clean_numeric(F.col("v")), at=scalars.epoch_to_time(F.col("t")),
              clip=scalars.clip(F.lit(-9.0)), best=scalars.argmax(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))))
    assert [g["clean"] for g in got] == [0.0, 0.0, -2.0] and got[1]["at"] is None and got[0]["at"].second == 12
    assert got[0]["clip"] == -3.0 and got[0]["best"] == 1


GRID = [0.0, 0.02, 0.1, 0.16, 0.19, 0.3, 0.95]


def test_decision_rules(spark):
    rows = [(f, *p) for f, p in itertools.product((0, 1, 3), itertools.product(GRID, repeat=3))]
    df = spark.createDataFrame(rows, "first int, a double, b double, c double")
    f, a, b, c = (F.col(n) for n in ("first", "a", "b", "c"))
    got = df.select("*",
        cascade.salvage_contest(f, a, b).alias("contest"), cascade.salvage_ordered(f, a, b).alias("ordered"),
        cascade.salvage_max(f, a, b).alias("max"), cascade.salvage_binary(f, a, 0.15).alias("binary"),
        cascade.gate_argmax(a, [a, b, c]).alias("gate"), cascade.release(a, [b, a, c, c], 0.1, 0.9).alias("release"),
        cascade.salvage_override(f, [c, c, a, b]).alias("override"),
        cascade.per_class([c, a, b, c], {1: 0.1, 2: 0.16, 3: 0.3}).alias("perclass")).collect()
    for r in got:
        first, p, q, z = r["first"], r["a"], r["b"], r["c"]
        arg = lambda v: v.index(max(v))
        kept = first != 0
        contest = (2 if p > q else 3) if p >= 0.1 and q >= 0.03 else 2 if p >= 0.1 else 3 if q >= 0.03 else 0
        override = 3 if q > 0.15 else 2 if p > 0.18 else arg([z, z, p, q])
        ok = [(k, v) for k, v, t in ((1, p, 0.1), (2, q, 0.16), (3, z, 0.3)) if v >= t]
        want = {
            "contest": first if kept else contest,
            "ordered": first if kept else 2 if p >= 0.01 else 3 if q >= 0.2 else 0,
            "max": first if kept else (2 if p >= q else 3) if max(p, q) >= 0.1 else 0,
            "binary": 2 if not kept and p >= 0.15 else first,
            "gate": arg([p, q, z]) + 1 if p >= 0.05 else 0,
            "release": 0 if p < 0.1 or q >= 0.9 else arg([p, z, z]) + 1,
            "override": first if kept else override,
            "perclass": max(ok, key=lambda kv: kv[1])[0] if ok else 0,
        }
        assert {k: r[k] for k in want} == want, r


def test_threshold_buckets_agree_with_comparison(spark):
    rows = [(i % 2, i / 100) for i in range(101)] + [(1, 0.29), (0, 0.57), (1, 0.999), (1, 0.58)]
    counts = cascade.threshold_counts(spark.createDataFrame(rows, "y int, p double"), "y", "p").collect()
    for r in counts:
        assert r["tp"] == sum(1 for y, p in rows if y and p >= r["threshold"])
    gate = cascade.gate_threshold(cascade.threshold_counts(spark.createDataFrame(rows, "y int, p double"), "y", "p"), 0.95, True)
    assert gate.collect()[0]["threshold"] in (0.15, 0.05, 0.04)


def test_employment_gap_and_supervisor(spark):
    rows = [("2010-01", "a", "Ann", "Bob"), ("2010-02", "a", "Ann", "Bob"), ("2010-04", "a", "Ann", "Bob"),
            ("2010-01", "b", "Bob", None), ("2010-02", "b", "Bob", None), ("2010-03", "b", "Bob", None), ("2010-04", "b", "Bob", None),
            ("2010-02", "c", "Bob", "Zed")]
    extra = [c for c in directory.PROFILE if c not in ("uname", "sup_name")]
    df = spark.createDataFrame(rows, "month string, user string, uname string, sup_name string").withColumns(
        {c: F.lit("x") for c in extra})
    got = {r["user"]: r for r in directory.resolve_supervisor(directory.directory(df)).collect()}
    assert (got["a"]["wstart"], got["a"]["wend"], got["a"]["sup"]) == ("2010-01", "2010-03", "b")
    assert got["b"]["wend"] is None and got["c"]["wend"] == "2010-03" and got["c"]["sup"] is None


def test_primary_and_shared_computers(spark):
    acts = [(u, p, w) for w in (0, 1) for u, ps in {"u": ["P1", "P2"], "v": ["P2", "P3"], "w": ["P3"], "t": ["P1", "P4"]}.items() for p in ps]
    acts += [("x", "P9", 0)]
    pcs = directory.user_pcs(spark.createDataFrame(acts, "user string, pc string, week int"))
    roles = spark.createDataFrame([("u", "Sales"), ("v", "ITAdmin"), ("w", "Sales"), ("t", "Sales")], "user string, role string")
    got = {r["user"]: (r["pc"], r["sharedpc"]) for r in directory.shared_pcs(directory.primary_pc(pcs), roles).collect()}
    assert got == {"u": ("P1", ["P2"]), "v": ("P3", None), "w": ("P3", None), "t": ("P4", ["P1"])}


def test_files_round_trip(spark, tmp_path):
    base = tmp_path / "logs"
    base.mkdir()
    head = {n: ",".join(c) for n, c in logs.LOG_COLUMNS.items()}
    body = {"logon": "1,01/04/2010 08:00:00,u,PC-1,Logon", "device": "2,01/04/2010 09:00:00,u,PC-1,Connect",
            "http": '3,01/04/2010 10:00:00,u,PC-1,http://a.com/,"text, with comma"',
            "email": "4,01/05/2010 10:00:00,u,PC-1,a@dtaa.com;b@x.org,,,u@dtaa.com,100,0,hello there",
            "file": "5,01/11/2010 10:00:00,u,PC-1,C:\\x.doc,abc"}
    for name in head:
        (base / f"{name}.csv").write_text(f"{head[name]}\n{body[name]}\n")
    read = logs.read_logs(spark, str(base))
    weekly = logs.with_week(logs.unify(read), logs.first_sunday(read["http"]))
    assert {r["type"]: r["week"] for r in weekly.collect()} == {"logon": 0, "device": 0, "http": 0, "email": 0, "file": 1}
    logs.write_weeks(weekly, str(tmp_path / "weeks"))
    back = logs.read_weeks(spark, str(tmp_path / "weeks"), [1]).collect()
    assert [r["id"] for r in back] == ["5"]
    assert weekly.where("type = 'http'").collect()[0]["content"] == "text, with comma"

    folder = tmp_path / "answers" / "r4.2-1"
    folder.mkdir(parents=True)
    (folder / "r4.2-1-u.csv").write_text('type,id,date,user,pc\nlogon,"{A1}",01/04/2010,"u",PC\nlogon,"{A2}",01/04/2010,"other",PC\n')
    details = people.read_answer_details(spark, str(tmp_path / "answers"))
    index = spark.createDataFrame([("4.2", "1", "r4.2-1-u.csv", "u", "01/04/2010 00:00:00", "01/09/2010 00:00:00"),
                                   ("4.2", "2", "absent.csv", "v", "01/04/2010 00:00:00", "01/09/2010 00:00:00"),
                                   ("5.2", "1", "r4.2-1-u.csv", "w", "01/04/2010 00:00:00", "01/09/2010 00:00:00")],
                                  "dataset string, scenario string, details string, user string, start string, end string")
    insiders = directory.insider_index(index)
    assert {r["user"] for r in insiders.collect()} == {"u", "v"}
    assert [(r["user"], r["id"]) for r in directory.malicious_pairs(insiders, details).collect()] == [("u", "{A1}")]
    assert people.read_traits(spark, str(tmp_path / "nothing.csv")).count() == 0

    ldap = tmp_path / "ldap"
    ldap.mkdir()
    (ldap / "2010-02.csv").write_text(",".join(people.SNAPSHOT_COLUMNS) + "\nAnn,a,e,r,b,f,d,t,Bob\n")
    assert people.read_snapshots(spark, str(ldap)).collect()[0]["month"] == "2010-02"


@pytest.fixture(autouse=True)
def quiet(spark):
    spark.sparkContext.setLogLevel("OFF")

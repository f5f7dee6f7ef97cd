"""Sessions and their feature rows."""

from pyspark.sql import functions as F

from catalog import base_sql as b
from catalog.registry import big, ctes, num, query, when
from catalog.shapes import Shapes
from sessionlens.operators import activity, sessions
from sessionlens.plans import etl
from sessionlens.session import fresh_path

_id = f"{big('week', 'week')}, usr AS \"user\", pcid, {big('seq', 'session_seq')}"
_rows = [*b.ROWS, b.sessionized("feats")]
_known = [*b.NUMBERS, b.sessionized("numeric_rows")]


def _aggregate(group: str | None, condition: dict, inner: str) -> str:
    test = " AND ".join(f"{c} = {v}" for c, v in condition.items())
    return f"{inner} FILTER (WHERE {test})" if test else inner


def feature_sql(full: bool = False) -> list[str]:
    out = []
    for block, group, condition, measures, counted in sessions._groups():
        count, prefix = sessions._names(block, group)
        out.append(big(_aggregate(group, condition, "count(*)"), count))
        for m in measures:
            for stat in sessions.STATISTICS if full else ["mean"]:
                fn = {"min": "min", "max": "max", "med": "median", "mean": "avg", "std": "stddev_pop"}[stat]
                out.append(num(f"coalesce({_aggregate(group, condition, f'{fn}({m})')}, 0)", f"{prefix}_{stat}_{m}"))
        for c, values in counted.items():
            for v in values:
                out.append(big(_aggregate(group, {**condition, f'"{c}"': v}, "count(*)"), f"{prefix}_n-{c}{v}"))
    return out


def hour(e: str) -> str:
    return f"hour({e}) + minute({e}) / 60.0"


SCALARS = [
    num("epoch(min(ts))", "starttime"), num("epoch(max(ts))", "endtime"), big("max(CASE WHEN isnew = 1 THEN day END)", "day"),
    *[num(f"count(*) FILTER (WHERE time = {i}) / CAST(count(*) AS DOUBLE)", n)
      for i, n in enumerate(["isworkhour", "isafterhour", "isweekend", "isweekendafterhour"], start=1)],
    big("count(DISTINCT day)", "n_days"), num("(epoch(max(ts)) - epoch(min(ts))) / 60.0", "duration"),
    big("CASE WHEN max(CASE WHEN isnew = 1 THEN act END) = 1 THEN 1 ELSE 2 END", "start_with"), big("max(ending)", "end_with"),
    num(hour("min(ts)"), "ses_start"), num(hour("max(ts)"), "ses_end"),
]
SPANNED = """spanned AS (SELECT week, usr, pcid, seq, uint, min(ts) AS t0, max(ts) AS t1, max(ending) AS fin, max(closing) AS clo
  FROM sess GROUP BY ALL),
overlap AS (SELECT a.week, a.usr, a.pcid, a.seq, count(b.usr) AS n FROM spanned a LEFT JOIN spanned b
  ON a.week = b.week AND a.usr = b.usr AND b.t0 < a.t1 AND b.t1 > a.t0 GROUP BY ALL),
numbered AS (SELECT *, CAST(week AS BIGINT) * 100000 + row_number() OVER (PARTITION BY week ORDER BY uint,
  CASE WHEN fin = 0 THEN 1 ELSE 0 END, CASE WHEN fin = 0 THEN t0 ELSE clo END, t0, pcid, seq) - 1 AS sessionid
  FROM spanned WHERE uint >= 0)"""
_order = sessions.SESSION_COLUMNS


def exact(column: str) -> str:
    """The same column without the rounding of the output form."""
    return column.replace("ROUND(CAST(", "(CAST(", 1).replace(", 6) + 0.0 AS", ") AS")


_plain = {c.rsplit('AS "', 1)[1][:-1]: c for c in [*SCALARS, *feature_sql()]}
SESSION_SQL = f"""agg AS (
  SELECT week, usr, pcid, seq, uint, {', '.join(exact(c) for c in _plain.values())},
         {big('max(CASE WHEN isnew = 1 THEN pc END)', 'pc')},
         {big('CASE WHEN sum(mal_act) > 0 THEN max(insider) ELSE 0 END', 'insider')}
  FROM sess WHERE uint >= 0 GROUP BY week, usr, pcid, seq, uint),
session_rows AS (
  SELECT {', '.join(f'agg."{c}"' for c in [*_plain, 'pc', 'insider'])}, {big('agg.uint', 'user')}, {big('agg.week', 'week')},
         {big('sessionid', 'sessionid')}, {big('o.n', 'n_concurrent_sessions')},
         {', '.join(big(f'st."{c}"', c) for c in sessions.USER_COLUMNS[:6])},
         {', '.join(num(f'st."{c}"', c) for c in sessions.USER_COLUMNS[6:])}
  FROM agg JOIN overlap o USING (week, usr, pcid, seq) JOIN numbered n USING (week, usr, pcid, seq)
  JOIN static st ON agg.usr = st.usr)"""
SESSIONS = [*_known, SPANNED, SESSION_SQL]


@query("sessionize", ctes(*_rows) + f" SELECT actid, {_id}, {big('ending', '_end')}, {when('closing', '_close')} FROM sess")
def sessionize(s: Shapes):
    return sessions.with_sessions(s.rows(), usb=False).select("actid", *sessions.SESSION_ID, "_end", "_close")


@query("session_features", ctes(*_rows) + f" SELECT {_id}, {', '.join(feature_sql())} FROM sess GROUP BY week, usr, pcid, seq")
def session_features(s: Shapes):
    return sessions.session_features(sessions.with_sessions(s.rows()), sessions.SESSION_ID)


@query("session_features_full", ctes(*_rows) + f" SELECT {_id}, {', '.join(feature_sql(True))} FROM sess GROUP BY week, usr, pcid, seq")
def session_features_full(s: Shapes):
    return sessions.session_features(sessions.with_sessions(s.rows()), sessions.SESSION_ID, full=True)


@query("session_label", ctes(*_known) + f" SELECT {_id}, {big('CASE WHEN sum(mal_act) > 0 THEN max(insider) ELSE 0 END', 'insider')} FROM sess GROUP BY week, usr, pcid, seq")
def session_label(s: Shapes):
    return s.known_rows().groupBy(*sessions.SESSION_ID).agg(sessions.label_aggregate().alias("insider"))


@query("session_scalars", ctes(*_rows) + f" SELECT {_id}, {', '.join(SCALARS)} FROM sess GROUP BY week, usr, pcid, seq")
def session_scalars(s: Shapes):
    return sessions.session_scalars(sessions.with_sessions(s.rows(), usb=False)).drop("_close")


@query("concurrent_sessions", ctes(*_known, SPANNED) + f" SELECT {_id}, {big('n', 'n_concurrent_sessions')} FROM overlap")
def concurrent_sessions(s: Shapes):
    spans = sessions.with_sessions(s.rows(), usb=False).groupBy(*sessions.SESSION_ID).agg(
        F.min("time_stamp").alias("_from"), F.max("time_stamp").alias("_to"))
    return sessions.concurrency(spans, bound=s.weeks)


@query("session_ids", ctes(*_known, SPANNED) + f" SELECT {_id}, {big('sessionid', 'sessionid')} FROM numbered")
def session_ids(s: Shapes):
    rows = activity.with_user(sessions.with_sessions(s.rows(), usb=False), s.users).where(F.col("user_int") >= 0)
    spans = rows.groupBy(*sessions.SESSION_ID, "user_int").agg(
        F.min("time_stamp").alias("_from"), F.max("_end").alias("end_with"), F.max("_close").alias("_close"))
    return sessions.session_ids(spans, bound=s.weeks).select(*sessions.SESSION_ID, "sessionid")


@query("session_table", ctes(*SESSIONS) + " SELECT " + ", ".join(
    num(f'"{c}"', c) if "ROUND" in _plain.get(c, "") or c in sessions.USER_COLUMNS[6:] else f'"{c}"' for c in _order) + " FROM session_rows")
def session_table(s: Shapes):
    return s.session_table()


@query("session_sink", ctes(*SESSIONS) + f""" SELECT week, {big('count(*)', 'sessions')}, {big('max(n_allact)', 'largest')},
  {big('sum(insider)', 'insider_sum')}, {num('max(duration)', 'longest')} FROM session_rows GROUP BY week""")
def session_sink(s: Shapes):
    """All weeks written as one session table and read back."""
    path = fresh_path(s.spark, "sessions-out")
    etl.write_sessions(s.session_table(), path)
    return s.spark.read.parquet(path).groupBy("week").agg(
        F.count(F.lit(1)).alias("sessions"), F.max("n_allact").alias("largest"), F.sum("insider").alias("insider_sum"),
        F.max("duration").alias("longest"))

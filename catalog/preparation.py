"""Splits, column selection, scaling and encoding on the session table."""

from pyspark.sql import functions as F

from catalog.registry import big, ctes, num, query, when
from catalog.sessions import SESSIONS, _plain
from catalog.shapes import Shapes
from sessionlens.functions import scalars
from sessionlens.operators import preparation as prep
from sessionlens.operators import sessions as sess
from sessionlens.operators import splits
from sessionlens.session import stage

ALL = [c for c in sess.SESSION_COLUMNS if c not in {*prep.IDENTIFIERS, *prep.LEAKAGE}]
#: Traits are unknown for some users; windows and fits take the columns that every session has.
FILLED = [c for c in ALL if c not in {"O", "C", "E", "A", "N"}]
CODES = ["pc", "start_with", "end_with", "role", "f_unit", "dept", "team"]
_KEY = ["user", "sessionid"]
_key_sql = '"user", sessionid'

RANKED = """placed AS (SELECT *, row_number() OVER (ORDER BY starttime, "user", sessionid) AS rn, count(*) OVER () AS total
  FROM session_rows),
parts0 AS (SELECT *, CASE WHEN rn <= floor(floor(total * CAST(0.8 AS DOUBLE)) * CAST(0.8 AS DOUBLE)) THEN 'train'
  WHEN rn <= floor(total * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM placed),
parts AS (SELECT * FROM parts0 WHERE split <> 'test' OR "user" NOT IN
  (SELECT "user" FROM parts0 WHERE split <> 'test' AND insider <> 0)),
thirds AS (SELECT *, CASE WHEN rn <= floor(total * CAST(0.64 AS DOUBLE)) THEN 'train'
  WHEN rn <= floor(total * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM placed),
train AS (SELECT * FROM thirds WHERE split = 'train')"""
SPLIT = [*SESSIONS, RANKED]


def _long(columns: list[str], source: str = "train") -> str:
    casts = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in columns)
    names = ", ".join(f'"{c}"' for c in columns)
    return f'long AS (UNPIVOT (SELECT {casts} FROM {source}) ON {names} INTO NAME "column" VALUE v)'


SKEW = """moments AS (SELECT "column", avg(v) AS m, count(v) AS n FROM long GROUP BY "column"),
skews AS (SELECT l."column", any_value(n) AS n, min(v) AS lo, max(v) AS hi, count(DISTINCT v) AS nv,
  CASE WHEN min(v) < max(v) THEN avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5)
     * sqrt(CAST(any_value(n) AS DOUBLE) * (any_value(n) - 1)) / (any_value(n) - 2) ELSE 0 END AS skewness
  FROM long l JOIN moments USING ("column") GROUP BY l."column")"""


def timed(s: Shapes):
    return splits.time_split(s.sessions)


def train(s: Shapes):
    return timed(s).where(F.col("split") == "train")


def parted(s: Shapes, columns: list[str]):
    """The split sessions, stored as they are read several times, and their training part."""
    whole = stage(timed(s).select(*_KEY, "split", *columns), "split-sessions")
    return whole, whole.where(F.col("split") == "train")


# --- splits ---------------------------------------------------------------------------------

@query("time_user_split", ctes(*SPLIT) + f" SELECT {_key_sql}, split FROM parts")
def time_user_split(s: Shapes):
    return splits.time_user_split(s.sessions).select(*_KEY, "split")


@query("time_split_3way", ctes(*SPLIT) + f" SELECT {_key_sql}, split FROM thirds")
def time_split_3way(s: Shapes):
    return timed(s).select(*_KEY, "split")


_labels = ", ".join(big(f"count(*) FILTER (WHERE insider = {c})", f"label_{c}") for c in range(4))


@query("split_report", ctes(*SPLIT) + f"""
SELECT split, {big('count(*)', 'n_rows')}, {big('count(DISTINCT "user")', 'n_users')}, {num('min(starttime)', 'first_time')},
       {num('max(starttime)', 'last_time')}, {_labels} FROM parts GROUP BY split""")
def split_report(s: Shapes):
    return splits.split_report(splits.time_user_split(s.sessions))


@query("user_label", ctes(*SESSIONS) + f' SELECT "user", {big("max(insider)", "insider")} FROM session_rows GROUP BY "user"')
def user_label(s: Shapes):
    return splits.user_labels(s.sessions)


@query("user_split", ctes(*SESSIONS, """ul AS (SELECT "user", max(insider) AS insider FROM session_rows GROUP BY "user"),
ur AS (SELECT *, row_number() OVER (PARTITION BY insider ORDER BY md5(CAST("user" AS VARCHAR) || '-42'), "user") AS r,
  count(*) OVER (PARTITION BY insider) AS n FROM ul),
up AS (SELECT *, floor(n * CAST(0.2 AS DOUBLE) + 0.5) AS nt FROM ur),
us AS (SELECT "user", CASE WHEN r <= nt THEN 'test' WHEN r <= nt + floor((n - nt) * 0.125 + 0.5) THEN 'val'
  ELSE 'train' END AS split FROM up)""") + """
SELECT s."user", s.sessionid, us.split FROM session_rows s JOIN us ON s."user" = us."user" """)
def user_split(s: Shapes):
    return splits.user_split(s.sessions).select(*_KEY, "split")


def _dealt(name: str, source: str, folds: int) -> str:
    """Users of each label dealt to and fro by falling size and hash."""
    return f"""{name} AS (SELECT *, (b + CASE WHEN (k // {folds}) % 2 = 0 THEN k % {folds} ELSE {folds - 1} - k % {folds} END) % {folds} AS fold FROM (
  SELECT *, row_number() OVER (PARTITION BY insider ORDER BY n DESC, md5(CAST("user" AS VARCHAR) || '-42'), "user") - 1 AS k,
    rank() OVER (ORDER BY insider) - 1 AS b FROM {source}))"""


_users = 'ul AS (SELECT "user", max(insider) AS insider, count(*) AS n FROM session_rows GROUP BY "user")'
_others = 'rest AS (SELECT "user", insider, n FROM first_deal WHERE fold > 0)'
_members = """ SELECT s."user", s.sessionid, CASE WHEN d.fold = 0 THEN 'test' WHEN v.val THEN 'val' ELSE 'train' END AS split
FROM session_rows s JOIN first_deal d ON s."user" = d."user" LEFT JOIN v ON s."user" = v."user" """


@query("user_fold_split", ctes(*SESSIONS, _users, _dealt("first_deal", "ul", 5), _others, _dealt("second_deal", "rest", 8),
       'v AS (SELECT "user", fold = 0 AS val FROM second_deal)') + _members)
def user_fold_split(s: Shapes):
    return splits.user_fold_split(s.sessions).select(*_KEY, "split")


@query("user_fold_split_fallback", ctes(*SESSIONS, _users, _dealt("first_deal", "ul", 5), _others,
       "sizes AS (SELECT insider, count(*) AS c FROM rest GROUP BY 1)",
       "seats AS (SELECT *, (SELECT sum(c) FROM sizes) AS a, (SELECT CAST(ceil(sum(c) * 0.125) AS BIGINT) FROM sizes) AS m FROM sizes)",
       "sure AS (SELECT *, c * m // a AS f, c * m % a AS r FROM seats)",
       """quota AS (SELECT insider, f + CASE WHEN row_number() OVER (ORDER BY r DESC, c DESC, insider) <= m - (SELECT sum(f) FROM sure)
  THEN 1 ELSE 0 END AS q FROM sure)""",
       """v AS (SELECT "user", row_number() OVER (PARTITION BY insider ORDER BY md5(CAST("user" AS VARCHAR) || '-42'), "user") <= q AS val
  FROM rest JOIN quota USING (insider))""") + _members)
def user_fold_split_fallback(s: Shapes):
    """More validation folds than any label has users, so an eighth of them is drawn."""
    return splits.user_fold_split(s.sessions, val_folds=1 << 40).select(*_KEY, "split")


# --- column selection -------------------------------------------------------------------------

STRICT = [c for c in ALL if c not in {*prep.SUSPECT, *prep.OPTIONAL}]


@query("feature_select", ctes(*SESSIONS) + f""" SELECT {_key_sql},
  {', '.join(num(f'"{c}"', c) if "ROUND" in _plain.get(c, "") or c in sess.USER_COLUMNS[6:] else f'"{c}"' for c in STRICT)} FROM session_rows""")
def feature_select(s: Shapes):
    """The strictest selection: identifiers, leaking, suspect and optional columns dropped."""
    chosen = prep.feature_columns(s.sessions, leakage=True, suspect=True, optional=True)
    return s.sessions.select(*_KEY, *[prep.column(c) for c in chosen])


@query("dead_columns", ctes(*SPLIT, _long(ALL)) + f"""
SELECT "column", {big('CASE WHEN count(DISTINCT v) <= 1 THEN 1 ELSE 0 END', 'dead')} FROM long GROUP BY "column" """)
def dead_columns(s: Shapes):
    return prep.dead_columns(train(s), ALL)


@query("dead_columns_std", ctes(*SPLIT, _long(ALL)) + f"""
SELECT "column", {big('CASE WHEN max(v) > min(v) THEN 0 ELSE 1 END', 'dead')} FROM long GROUP BY "column" """)
def dead_columns_std(s: Shapes):
    return prep.dead_by_std(train(s), ALL)


_protected = " OR ".join(f"starts_with(\"column\", '{p}')" for p in prep.PROTECTED_PREFIXES)


@query("sparse_columns", ctes(*SPLIT, _long(ALL)) + f"""
SELECT "column", {num('avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END)', 'zero_share')},
       {big(f'CASE WHEN avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) > 0.99 AND NOT ({_protected}) THEN 1 ELSE 0 END', 'sparse')}
FROM long GROUP BY "column" """)
def sparse_columns(s: Shapes):
    return prep.sparse_columns(train(s), ALL)


@query("binary_columns", ctes(*SPLIT, _long(ALL)) + f"""
SELECT "column", {big('CASE WHEN count(DISTINCT v) <= 5 THEN 1 ELSE 0 END', 'binary')} FROM long GROUP BY "column" """)
def binary_columns(s: Shapes):
    return prep.binary_columns(train(s), ALL)


@query("skewed_columns", ctes(*SPLIT, _long(ALL), SKEW) + f"""
SELECT "column", {num('round(skewness, 4)', 'skewness')}, {big('CASE WHEN abs(skewness) > 3 AND nv > 10 THEN 1 ELSE 0 END', 'skewed')} FROM skews""")
def skewed_columns(s: Shapes):
    return prep.skewed_columns(train(s), ALL).withColumn("skewness", F.round("skewness", 4))


@query("clean_numeric", f"""SELECT event_id, {num("CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN 0 ELSE value END", 'value')} FROM events""")
def clean_numeric(s: Shapes):
    i, v = F.col("event_id"), F.col("value")
    dirty = (F.when(i % 7 == 0, F.lit(float("inf"))).when(i % 11 == 0, F.lit(float("-inf")))
             .when(i % 13 == 0, F.lit(None).cast("double")).otherwise(v))
    return prep.clean(s.table("events").select("event_id", dirty.alias("value")), ["value"])


@query("epoch_parse", f"""SELECT event_id, {when("CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts) END", 'time')} FROM events""")
def epoch_parse(s: Shapes):
    seconds = F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp")).cast("string")
    text = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(seconds)
    return s.table("events").select("event_id", scalars.epoch_to_time(text).alias("time"))


# --- scaling ------------------------------------------------------------------------------------

def _scaled(center: str, width: str, inner: str = "{0}") -> str:
    fits = ", ".join(f"{center.format(inner.format(f'\"{c}\"'))} AS a{i}, {width.format(inner.format(f'\"{c}\"'))} AS b{i}"
                     for i, c in enumerate(FILLED))
    cols = ", ".join(num(f"({inner.format(f't.\"{c}\"')} - f.a{i}) / CASE WHEN f.b{i} > 0 THEN f.b{i} ELSE 1 END", c)
                     for i, c in enumerate(FILLED))
    return ctes(*SPLIT, f"f AS (SELECT {fits} FROM train)") + f" SELECT {_key_sql}, {cols} FROM thirds t, f"


_log = "(sign({0}) * ln(1 + abs({0})))"


@query("signed_log", ctes(*SESSIONS) + f" SELECT {_key_sql}, " + ", ".join(num(_log.format(f'"{c}"'), c) for c in FILLED) + " FROM session_rows")
def signed_log(s: Shapes):
    return prep.apply_signed_log(s.sessions.select(*_KEY, *FILLED), FILLED)


@query("standard_scale", _scaled("avg({0})", "stddev_pop({0})"))
def standard_scale(s: Shapes):
    return prep.standard_scale(*parted(s, FILLED), FILLED).select(*_KEY, *FILLED)


@query("clip_features", _scaled("avg({0})", "stddev_pop({0})").replace("SELECT \"user\", sessionid, ", "SELECT \"user\", sessionid, ").replace(
    f" SELECT {_key_sql}, ", f", z AS (SELECT {_key_sql}, ") + f") SELECT {_key_sql}, " + ", ".join(
        num(f'greatest(least("{c}", 3), -3)', c) for c in FILLED) + " FROM z")
def clip_features(s: Shapes):
    scaled = prep.standard_scale(*parted(s, FILLED), FILLED)
    return scaled.select(*_KEY, *[scalars.clip(F.col(c)).alias(c) for c in FILLED])


@query("minmax_scale", _scaled("min({0})", "(max({0}) - min({0}))", _log))
def minmax_scale(s: Shapes):
    logged = prep.apply_signed_log(parted(s, FILLED)[0], FILLED)
    return prep.minmax_scale(logged, logged.where(F.col("split") == "train"), FILLED).select(*_KEY, *FILLED)


@query("frequency_encode", ctes(*SPLIT, *[
    f'fq_{c} AS (SELECT "{c}" AS v, count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE) AS f FROM train GROUP BY 1)' for c in CODES])
    + f" SELECT t.\"user\", t.sessionid, " + ", ".join(num(f"coalesce(greatest(fq_{c}.f, 0.01), 0.01)", c) for c in CODES)
    + " FROM thirds t " + " ".join(f'LEFT JOIN fq_{c} ON t."{c}" = fq_{c}.v' for c in CODES))
def frequency_encode(s: Shapes):
    return prep.frequency_encode(*parted(s, CODES), CODES).select(*_KEY, *CODES)


@query("one_hot", ctes(*SESSIONS) + f" SELECT {_key_sql}, " + ", ".join(
    big(f"CASE WHEN pc = {v} THEN 1 ELSE 0 END", f"pc_{v}") for v in (1, 2, 3)) + " FROM session_rows")
def one_hot(s: Shapes):
    """Levels of the computer code; the first level has no column."""
    return prep.one_hot(s.sessions.select(*_KEY, "pc"), s.sessions, "pc")


_audited = ["max(v)", "avg(v)", "stddev_samp(v)"]


@query("feature_audit", ctes(*SPLIT, _long(ALL), SKEW) + f"""
SELECT "column", {num('round(any_value(hi), 4)', 'max')}, {num('round(avg(v), 4)', 'mean')}, {num('round(stddev_samp(v), 4)', 'std')},
  {num('round(any_value(skewness), 4)', 'skewness')}, {big('CASE WHEN abs(any_value(skewness)) > 3 THEN 1 ELSE 0 END', 'still_skewed')}
FROM long JOIN skews USING ("column") GROUP BY "column" """)
def feature_audit(s: Shapes):
    return prep.audit(train(s), ALL)


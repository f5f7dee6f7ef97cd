"""Windows of consecutive sessions and history features."""

from pyspark.sql import functions as F

from catalog.preparation import FILLED, SPLIT
from catalog.registry import big, ctes, num, query
from catalog.sessions import SESSIONS
from catalog.shapes import Shapes
from sessionlens.operators import preparation as prep
from sessionlens.operators import sequences as seq
from sessionlens.operators import splits

_W = 'PARTITION BY "user" ORDER BY starttime, sessionid'


def windows_sql(size: int, y: str, where: str = "", columns: list[str] = FILLED, source: str = "session_rows",
                part: str = '"user"') -> list[str]:
    over = f"(PARTITION BY {part} ORDER BY starttime, sessionid ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"
    plain = f"(PARTITION BY {part} ORDER BY starttime, sessionid)"
    cells = ", ".join(
        f"lead(CAST(\"{c}\" AS DOUBLE), {t}) OVER {plain} AS \"{c}_t-{size - 1 - t}\"" for t in range(size) for c in columns)
    return [f"""wins0 AS (SELECT {part}, row_number() OVER {plain} - 1 AS window_no, count(*) OVER {over} AS c, {y.format(over=over, plain=plain)} AS y,
  {cells} FROM {source}),
wins AS (SELECT * EXCLUDE (c) FROM wins0 WHERE c = {size} {where})"""]


def _pack(size: int) -> str:
    names = seq.flat_names(FILLED, size)
    total = " + ".join(f'{i % 97 + 1} * "{n}"' for i, n in enumerate(names))
    return f'"user", {big("window_no", "window_no")}, {big("y", "y")}, {num(f"\"{names[0]}\"", "first")}, {num(f"\"{names[-1]}\"", "last")}, {num(total, "total")}'


def packed(windows):
    """First and last entry of a flat window and the sum of all, each times a weight that tells its place."""
    flat = seq.flatten_windows(windows)
    return flat.select("user", "window_no", "y", F.element_at("features", 1).alias("first"), F.element_at("features", -1).alias("last"),
                       F.aggregate(F.transform("features", lambda x, i: x * (i % 97 + 1)), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("windows_max", ctes(*SESSIONS, *windows_sql(3, "max(insider) OVER {over}")) + f" SELECT {_pack(3)} FROM wins")
def windows_max(s: Shapes):
    return packed(seq.sequence_windows(s.sessions, FILLED, 3))


@query("windows_last", ctes(*SESSIONS, *windows_sql(4, "lead(insider, 3) OVER {plain}")) + f" SELECT {_pack(4)} FROM wins")
def windows_last(s: Shapes):
    return packed(seq.sequence_windows(s.sessions, FILLED, 4, rule="last"))


_count = "sum(CASE WHEN insider = {c} THEN 1 ELSE 0 END) OVER {{over}}"
_n = {c: _count.format(c=c) for c in (1, 2, 3)}
_maj = (f"CASE WHEN greatest({_n[1]}, {_n[2]}, {_n[3]}) < 2 THEN 0 WHEN {_n[1]} >= {_n[2]} AND {_n[1]} >= {_n[3]} THEN 1 "
        f"WHEN {_n[2]} >= {_n[3]} THEN 2 ELSE 3 END")


@query("windows_majority", ctes(*SESSIONS, *windows_sql(5, _maj)) + f" SELECT {_pack(5)} FROM wins")
def windows_majority(s: Shapes):
    return packed(seq.sequence_windows(s.sessions, FILLED, 5, rule="majority"))


@query("windows_stride", ctes(*SESSIONS, *windows_sql(5, "max(insider) OVER {over}", "AND window_no % 2 = 0")) + f" SELECT {_pack(5)} FROM wins")
def windows_stride(s: Shapes):
    return packed(seq.sequence_windows(s.sessions, FILLED, 5, step=2))


_few = ["n_allact", "n_http", "n_email", "n_file", "usb_mean_usb_dur"]


@query("windows_flat", ctes(*SESSIONS, *windows_sql(3, "max(insider) OVER {over}", columns=_few)) + f"""
SELECT "user", {big('window_no', 'window_no')}, {big('y', 'y')}, {', '.join(num(f'"{n}"', n) for n in seq.flat_names(_few, 3))} FROM wins""")
def windows_flat(s: Shapes):
    flat = seq.flatten_windows(seq.sequence_windows(s.sessions, _few, 3))
    names = seq.flat_names(_few, 3)
    return flat.select("user", "window_no", "y", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)])


@query("window_label_counts", ctes(*SPLIT, *windows_sql(5, "max(insider) OVER {over}", columns=["duration"], source="parts", part='split, "user"'))
       + f" SELECT split, {big('y', 'y')}, {big('count(*)', 'n')} FROM wins GROUP BY split, y")
def window_label_counts(s: Shapes):
    """Label distribution of the windows made inside each part."""
    split = splits.time_user_split(s.sessions)
    made = seq.sequence_windows(split, ["duration"], 5, keys=["split", "user"])
    return made.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"))


_flat3 = seq.flat_names(_few, 3)


@query("standard_scale_per_lag", ctes(*SPLIT, *windows_sql(3, "lead(insider, 2) OVER {plain}", columns=_few, source="thirds", part='split, "user"'),
       "f AS (SELECT " + ", ".join(f'avg("{n}") AS a{i}, stddev_pop("{n}") AS b{i}' for i, n in enumerate(_flat3)) + " FROM wins WHERE split = 'train')")
       + f" SELECT split, \"user\", {big('window_no', 'window_no')}, {big('y', 'y')}, "
       + ", ".join(num(f'("{n}" - a{i}) / CASE WHEN b{i} > 0 THEN b{i} ELSE 1 END' if i % 5 != 4 else f'"{n}"', n) for i, n in enumerate(_flat3))
       + " FROM wins, f")
def standard_scale_per_lag(s: Shapes):
    """Scaling fitted after windowing, one mean per feature and lag; the last feature stays as it is."""
    made = seq.flatten_windows(seq.sequence_windows(
        splits.time_split(s.sessions), _few, 3, rule="last", keys=["split", "user"]))
    positions = [i for i in range(15) if i % 5 != 4]
    scaled = prep.scale_positions(made, made.where(F.col("split") == "train"), "features", positions, 15)
    return scaled.select("split", "user", "window_no", "y", *[F.col("features")[i].alias(n) for i, n in enumerate(_flat3)])


_prev = f"({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query("temporal_meandiff", ctes(*SESSIONS) + ' SELECT "user", sessionid, ' + ", ".join(
    num(f'coalesce(coalesce("{c}", 0) - avg(coalesce("{c}", 0)) OVER {_prev}, 0)', f"{c}_meandiff") for c in seq.TEMPORAL_COLUMNS) + " FROM session_rows")
def temporal_meandiff(s: Shapes):
    rows = s.sessions.select("user", "sessionid", "starttime", *seq.TEMPORAL_COLUMNS).fillna(0, seq.TEMPORAL_COLUMNS)
    made = seq.temporal_features(rows, seq.TEMPORAL_COLUMNS, percentile=False)
    return made.select("user", "sessionid", *[F.col(f"`{c}_meandiff`") for c in seq.TEMPORAL_COLUMNS])


def _pct(c: str) -> str:
    w = f"({_W})"
    lags = [f'lag("{c}", {k}) OVER {w}' for k in range(1, 6)]
    below = " + ".join(f'coalesce(CAST({p} < "{c}" AS INTEGER), 0)' for p in lags)
    equal = " + ".join(f'coalesce(CAST({p} = "{c}" AS INTEGER), 0)' for p in lags)
    n = f"count(*) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    return f"(({below}) + ({equal} + 2) / 2.0) / {n} * 100 - 50"


@query("temporal_pct", ctes(*SESSIONS) + ' SELECT "user", sessionid, ' + ", ".join(
    num(_pct(c), f"{c}_pct") for c in seq.TEMPORAL_COLUMNS) + " FROM session_rows")
def temporal_pct(s: Shapes):
    made = seq.temporal_features(s.sessions.select("user", "sessionid", "starttime", *seq.TEMPORAL_COLUMNS), seq.TEMPORAL_COLUMNS, meandiff=False)
    return made.select("user", "sessionid", *[f"{c}_pct" for c in seq.TEMPORAL_COLUMNS])

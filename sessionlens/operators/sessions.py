"""Sessions: rows of a user on one computer between logon and logoff, and their feature row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions import calendar
from sessionlens.functions.activity import CONNECT, EMAIL, FILE, HTTP, LOGOFF, LOGON
from sessionlens.operators import ordering
from sessionlens.operators.activity import AXIS, SESSION_KEYS, usb_durations
from sessionlens.operators.ordering import LAST, SLICE, Sliced
from sessionlens.session import stage

# Activity groups with their measured columns, counted values and sub-groups.
FILE_GROUPS = ["otherf", "compf", "phof", "docf", "txtf", "exef"]
HTTP_GROUPS = ["otherf", "socnetf", "cloudf", "jobf", "leakf", "hackf"]
BLOCKS = [
    ("allact", None, [], {}, None, []),
    ("logon", LOGON, [], {}, None, []),
    ("usb", CONNECT, ["usb_dur"], {}, None, []),
    ("file", FILE, ["file_len", "file_depth", "file_nwords"], {"disk": [0, 1, 2]}, "file_type", FILE_GROUPS),
    ("email", EMAIL, ["n_des", "n_atts", "n_exdes", "n_bccdes", "email_size", "email_text_slen",
                      "email_text_nwords"], {"Xemail": [1], "exbccmail": [1]}, None, []),
    ("http", HTTP, ["url_len", "url_depth", "http_c_len", "http_c_nwords"], {}, "http_type", HTTP_GROUPS),
]
BASE_COLUMNS = [
    "starttime", "endtime", "user", "sessionid", "day", "week", "pc", "isworkhour", "isafterhour",
    "isweekend", "isweekendafterhour", "n_days", "duration", "n_concurrent_sessions", "start_with",
    "end_with", "ses_start", "ses_end",
]
USER_COLUMNS = ["role", "b_unit", "f_unit", "dept", "team", "ITAdmin", "O", "C", "E", "A", "N"]
STATISTICS = ["min", "max", "med", "mean", "std"]


def _groups():
    """(block, sub-group or None, row condition as parts, measures, counted values) in output order."""
    for block, act, measures, counted, kind, names in BLOCKS:
        yield block, None, {"act": act} if act else {}, measures, counted
        for code, name in enumerate(names, start=1):
            yield block, name, {"act": act, kind: code}, measures, counted


def _names(block: str, group: str | None) -> tuple[str, str]:
    """Count name and the prefix of the other columns."""
    return (f"n_{block}", block) if group is None else (f"{block}_n_{group}", f"{block}_{group}")


def feature_columns(full: bool = False) -> list[str]:
    out = []
    for block, group, _, measures, counted in _groups():
        count, prefix = _names(block, group)
        stats = STATISTICS if full else ["mean"]
        out.append(count)
        out += [f"{prefix}_{s}_{m}" for m in measures for s in stats]
        out += [f"{prefix}_n-{c}{v}" for c, values in counted.items() for v in values]
    return out


SESSION_COLUMNS = [*BASE_COLUMNS, *USER_COLUMNS, *feature_columns(), "insider"]


def feature_aggregates(full: bool = False) -> tuple[list[Column], list[Column]]:
    """Aggregates of one ``groupBy`` and the projection that turns them into features.

    Means are kept as sum and count so that the count of a group is held once, and every buffer is
    a plain number: the aggregation stays a hash aggregate with map-side combine. The expressions
    are written as SQL text, one call each, because there are several hundred of them.
    """
    aggs, outs = [], []
    for block, group, condition, measures, counted in _groups():
        count, prefix = _names(block, group)
        tests = [f"{c} = {v}" for c, v in condition.items()]

        def picked(value: str, *extra: str, tests=tests) -> str:
            test = " AND ".join([*tests, *extra])
            return f"IF({test}, {value}, NULL)" if test else value

        aggs.append(f"count({picked('1')}) AS `{count}`")
        outs.append(f"`{count}`")
        for m in measures:
            aggs.append(f"sum({picked(m)}) AS `{prefix}_sum_{m}`")
            if full:
                functions = {"min": "min", "max": "max", "std": "stddev_pop"}
                aggs += [f"{f}({picked(m)}) AS `{prefix}_{s}_{m}`" for s, f in functions.items()]
            for s in STATISTICS if full else ["mean"]:
                source = f"try_divide(`{prefix}_sum_{m}`, `{count}`)" if s == "mean" else f"`{prefix}_{s}_{m}`"
                outs.append(f"coalesce(double({source}), 0D) AS `{prefix}_{s}_{m}`")
        for c, values in counted.items():
            for v in values:
                name = f"{prefix}_n-{c}{v}"
                aggs.append(f"count({picked('1', f'{c} = {v}')}) AS `{name}`")
                outs.append(f"`{name}`")
    return [F.expr(a) for a in aggs], [F.expr(o) for o in outs]


def session_features(rows: DataFrame, keys: list[str], full: bool = False) -> DataFrame:
    aggs, outs = feature_aggregates(full)
    n = rows.count()
    grouped = ordering.dealt(rows, keys, n).groupBy(*keys).agg(*aggs)
    if full:  # keys are never null
        grouped = grouped.join(ordering.dealt(medians(rows, keys, n), keys, n), keys, "left")
    return grouped.select(*keys, *outs)


def medians(rows: DataFrame, keys: list[str], n: int = 0) -> DataFrame:
    """One ``..._med_...`` column per measure and group, as a weighted order statistic. ``n`` is the number of rows, if known.

    Values are counted per (session, measure, value) with map-side combine; running counts then tell which values stand in the
    middle. Only distinct values of one measure are ever ordered together, and that window spills.
    """
    names, entries = [], []
    for block, group, condition, measures, _ in _groups():
        prefix = _names(block, group)[1]
        test = " AND ".join([f"{c} = {v}" for c, v in condition.items()]) or "true"
        for m in measures:
            entries.append(f"IF({test} AND {m} IS NOT NULL, named_struct('_pos', {len(names)}, '_v', double({m})), NULL)")
            names.append(f"{prefix}_med_{m}")
    long = rows.select(*keys, F.expr(f"inline(filter(array({', '.join(entries)}), x -> x IS NOT NULL))"))
    counted = long.groupBy(*keys, "_pos", "_v").agg(F.count(F.lit(1)).alias("_n"))
    one = Window.partitionBy(*keys, "_pos")
    placed = counted.select(
        *keys, "_pos", "_v", F.sum("_n").over(one).alias("_all"),
        F.sum("_n").over(one.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    middle = [F.min(F.when(F.col("_upto") >= F.expr(at), F.col("_v"))) for at in ("(_all + 1) div 2", "_all div 2 + 1")]
    found = placed.groupBy(*keys, "_pos").agg(((middle[0] + middle[1]) / 2).alias("_med"))
    return ordering.dealt(found, keys, n).groupBy(*keys).agg(*[F.expr(f"max(IF(_pos = {i}, _med, NULL)) AS `{n}`") for i, n in enumerate(names)])


# --- session boundaries -----------------------------------------------------------------------

def _closes(logoff: Column, run: Column, opened: Column) -> Column:
    """Does this logoff end a session? In a run of logoffs the odd ones close and the even ones
    open a session of their own, the other way round while nothing else has happened yet."""
    odd = run % 2 == 1
    return logoff & F.when(opened, odd).otherwise(~odd)


def _borders(sliced: Sliced) -> DataFrame:
    """What each slice of a cut group has to know from the earlier ones: was there any row other
    than a logoff, and how many logoffs in a row came last."""
    logoff = (F.col("act") == LOGOFF).cast("long")
    down = Window.partitionBy(*sliced.slots).orderBy(*[F.desc(c) for c in AXIS.by])
    rows = sliced.border_rows.select(*sliced.slots, *AXIS.by, logoff.alias("_off"))
    others_after = F.sum(1 - F.col("_off")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    summary = rows.withColumn("_tail", (others_after == 0).cast("long")).groupBy(*sliced.slots).agg(
        F.sum("_tail").alias("_tail"), F.max(1 - F.col("_off")).alias("_other"))
    order = Window.partitionBy(*sliced.keys).orderBy(SLICE)
    marked = summary.withColumn("_era", F.sum("_other").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_era = Window.partitionBy(*sliced.keys, "_era").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_run_out", F.sum("_tail").over(in_era))
    return marked.select(
        *sliced.slots,
        F.coalesce(F.lag("_run_out").over(order), F.lit(0)).alias("_run_in"),
        F.coalesce(F.lag("_era").over(order) > 0, F.lit(False)).alias("_opened_in"),
    )


def _mark(sliced: Sliced) -> Sliced:
    """``_closed`` and ``_new`` per row and ``_seq``, the number of session starts so far in the slice."""
    upto = sliced.window.rowsBetween(Window.unboundedPreceding, 0)
    logoff = F.col("act") == LOGOFF
    run_in = F.coalesce("_run_in", F.lit(0)) if sliced.cut else F.lit(0)
    opened_in = F.coalesce("_opened_in", F.lit(False)) if sliced.cut else F.lit(False)
    counted = sliced.df.withColumn("_offs", F.sum(logoff.cast("long")).over(upto))
    counted = counted.withColumn("_base", F.max(F.when(~logoff, F.col("_offs"))).over(upto))
    run = F.col("_offs") - F.coalesce("_base", -run_in)
    opened = F.col("_base").isNotNull() | opened_in
    closed = counted.withColumn("_closed", _closes(logoff, run, opened))
    across = F.when(F.col(SLICE) > 0, _closes(run_in > 0, run_in, opened_in))
    before = F.coalesce(F.lag("_closed").over(sliced.window), across, F.lit(True))
    started = closed.withColumn("_new", (before | (F.col("act") == LOGON)).cast("long"))
    return sliced.of(started.withColumn("_seq", F.sum("_new").over(upto)).drop("_offs", "_base"))


def sessionize(sliced: Sliced) -> Sliced:
    """Give every row its session number inside (week, user, computer).

    A logoff closes the open session, a logon always starts one, and any other row (a logoff too)
    starts one if none is open. Adds ``session_seq``, ``first_row`` (1 on the row that opens the
    session), and ``_end``/``_close``: on the row that ends a session, 1 for a logoff or 2 for a
    following logon, and when that happened. Expects slices over ``SESSION_KEYS``.
    """
    number = F.col("_seq")
    if sliced.cut:
        borders = _borders(sliced)
        marked = _mark(sliced.attach(borders))
        starts = _mark(sliced.of(sliced.border_rows).attach(borders)).df.groupBy(*sliced.slots).agg(
            F.sum("_new").alias("_new"))
        marked = marked.attach(sliced.before(starts, {"_earlier": "_new"}))
        number = number + F.coalesce("_earlier", F.lit(0))
    else:
        marked = _mark(sliced)
    numbered = ordering.with_next(marked, F.struct("act", "time_stamp"), "_after").df
    by_logon = F.col("_after.act") == LOGON
    return sliced.of(numbered.withColumns({
        "session_seq": number,
        "first_row": F.col("_new"),
        "_end": F.when(F.col("_closed"), 1).when(by_logon, 2).otherwise(0),
        "_close": F.when(F.col("_closed"), F.col("time_stamp")).when(by_logon, F.col("_after.time_stamp")),
    }).drop("_closed", "_new", "_seq", "_run_in", "_opened_in", "_earlier", "_after"))


def with_sessions(rows: DataFrame, limit: int | None = None, usb: bool = True) -> DataFrame:
    """Session numbers and USB durations. Sessions come first: their partitioning also serves the
    finer one of the device rows (and the aggregation per session), so there is one shuffle."""
    numbered = sessionize(ordering.with_slices(rows, SESSION_KEYS, AXIS, limit))
    return (usb_durations(numbered) if usb else numbered).df.drop(SLICE, LAST)


# --- one row per session ------------------------------------------------------------------------

def scalar_aggregates() -> list[Column]:
    """First-row values come from the row flagged as first, days of the week are bits: plain
    numeric buffers again."""
    first = F.col("first_row") == 1
    share = [F.count(F.when(F.col("time") == code, 1)).alias(f"_t{code}") for code in (1, 2, 3, 4)]
    return [
        F.min("time_stamp").alias("_from"),
        F.max("time_stamp").alias("_to"),
        F.max(F.when(first, F.col("day"))).alias("day"),
        F.max(F.when(first, F.col("act"))).alias("_first_act"),
        F.bit_or(F.expr("shiftleft(1L, pmod(day, 7))")).alias("_days"),
        F.max("_end").alias("end_with"),
        F.max("_close").alias("_close"),
        F.count(F.lit(1)).alias("_rows"),
        *share,
    ]


def scalar_columns() -> list[Column]:
    start, end = F.col("_from"), F.col("_to")
    names = ["isworkhour", "isafterhour", "isweekend", "isweekendafterhour"]
    return [
        calendar.epoch_seconds(start).alias("starttime"),
        calendar.epoch_seconds(end).alias("endtime"),
        F.col("day"),
        *[(F.col(f"_t{code}") / F.col("_rows")).alias(n) for code, n in enumerate(names, start=1)],
        F.bit_count("_days").alias("n_days"),
        ((calendar.epoch_seconds(end) - calendar.epoch_seconds(start)) / 60).alias("duration"),
        F.when(F.col("_first_act") == LOGON, 1).otherwise(2).alias("start_with"),
        F.col("end_with"),
        calendar.hour_fraction(start).alias("ses_start"),
        calendar.hour_fraction(end).alias("ses_end"),
    ]


SESSION_ID = [*SESSION_KEYS, "session_seq"]


def session_scalars(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy(*SESSION_ID).agg(*scalar_aggregates())
    return grouped.select(*SESSION_ID, *scalar_columns(), F.col("_close"))


def label_aggregate() -> Column:
    return F.when(F.sum("mal_act") > 0, F.max("insider")).otherwise(0)


def concurrency(sessions: DataFrame, limit: int | None = None, bound: DataFrame | None = None) -> DataFrame:
    """Sessions of the same user and week that overlap each session, itself included if it has a
    length: (starts before its end) minus (ends up to its start), by a sweep over the end points.

    No pairs are formed. ``bound`` is a stored table with at least as many rows per (week, user). A session of length zero is one point that starts and ends nothing for
    the running difference, so points at one time sort as ends, zero-length, starts.
    """
    who = ["week", "user"]
    point = F.col("_from") == F.col("_to")
    kinds = F.when(point, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2)))
    points = sessions.select(*SESSION_ID, "_from", "_to", F.explode(kinds).alias("kind"))
    points = points.withColumn("at", F.when(F.col("kind") == 0, F.col("_to")).otherwise(F.col("_from")))
    axis = ordering.time_axis("at", "kind", "pcid", "session_seq")
    swept = ordering.running(points, who, axis, {
        "starts": (F.col("kind") != 0).cast("long"), "ends": (F.col("kind") != 2).cast("long"),
    }, limit, bound)
    started = F.max(F.when(F.col("kind") == 0, F.col("starts")))
    ended = F.max(F.when(F.col("kind") == 2, F.col("ends")))
    at_once = F.max(F.when(F.col("kind") == 1, F.col("starts") - F.col("ends")))
    return swept.groupBy(*SESSION_ID).agg(
        F.coalesce(at_once, started - ended).cast("long").alias("n_concurrent_sessions"))


def session_ids(sessions: DataFrame, limit: int | None = None, bound: DataFrame | None = None) -> DataFrame:
    """``week * 100000 + n``: users in index order, inside a user by closing time, then the
    sessions still open by opening time. Expects ``user_int``, ``end_with``, ``_from``, ``_close``."""
    still_open = (F.col("end_with") == 0).cast("int")
    placed = (
        sessions.withColumn("_open", still_open)
        .withColumn("_at", F.when(F.col("_open") == 0, F.col("_close")).otherwise(F.col("_from")))
    )
    week_seconds = 7 * 86_400 + 1
    axis = ordering.Axis(
        ("user_int", "_open", "_at", "_from", "pcid", "session_seq"),
        f"user_int * {2 * week_seconds} + _open * {week_seconds} + {_second_of_week()}",
        4096 * 2 * week_seconds,
    )
    return (
        ordering.row_index(placed, ["week"], axis, "_no", limit, bound)
        .withColumn("sessionid", (F.col("week") * F.lit(100_000).cast("long") + F.col("_no")))
        .drop("_no", "_open", "_at")
    )


def _second_of_week() -> str:
    """Seconds since the Sunday a week starts on (1970-01-04 was one)."""
    return "pmod(unix_seconds(cast(_at as timestamp)) - 259200, 604800)"


def session_table(rows: DataFrame, users: DataFrame, pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Row features → the 128-column session table. ``users`` and ``pairs`` are staged tables.

    Sessions of people missing from the directory are dropped, as they have no user columns.
    """
    from sessionlens.operators.activity import with_malicious_flag, with_user
    from sessionlens.operators.skew import join_by_key

    numbered = with_sessions(rows, limit)
    known = with_malicious_flag(with_user(numbered, users, limit), pairs).where(F.col("user_int") >= 0)
    aggs, outs = feature_aggregates()
    first = F.col("first_row") == 1
    grouped = known.groupBy(*SESSION_ID, "user_int").agg(
        *aggs, *scalar_aggregates(), F.max(F.when(first, F.col("pc"))).alias("pc"), label_aggregate().alias("insider"))
    # read three times below; 128 numbers per session are far smaller than the rows behind them
    grouped = stage(grouped, "session-parts")
    narrow = grouped.select(*SESSION_ID, "user_int", "_from", "_to", "end_with", "_close")
    overlaps = concurrency(narrow, limit, grouped)
    ids = session_ids(narrow, limit, grouped).select(*SESSION_ID, "sessionid")
    static = users.select(
        "user", *[F.col(f"{c}_code").alias(c) for c in USER_COLUMNS[:5]], "ITAdmin", "O", "C", "E", "A", "N")
    # narrow tables are joined first (everybody with a session is in the directory by now), so the wide rows move once
    placed = join_by_key(overlaps.join(ids, SESSION_ID), static, "user", limit)
    n = grouped.count()
    whole = ordering.dealt(grouped, SESSION_ID, n).join(ordering.dealt(placed, SESSION_ID, n), SESSION_ID)
    flat = whole.select(
        F.col("user_int").alias("user"), "sessionid", "week", "pc", "n_concurrent_sessions", *scalar_columns(), *outs,
        *USER_COLUMNS, "insider")
    return flat.select(*[F.col(f"`{c}`") for c in SESSION_COLUMNS])

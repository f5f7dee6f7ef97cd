"""Logs, row features and labels."""

from pyspark.sql import functions as F

from catalog import base_sql as b
from catalog.registry import big, ctes, query, when
from sessionlens.functions import calendar, content
from sessionlens.functions.activity import activity_code
from sessionlens.operators import activity, ordering
from sessionlens.session import fresh_path, stage
from sessionlens.sources import logs as log_files

_unified_text = ", ".join(f'"{c}"' for c in ["id", "type", "activity", "url", "filename", "content", "to", "cc", "bcc", "from", "size"])
_unified_sql = f"""SELECT {_unified_text}, att AS "#att", usr AS "user", pc, {when('date', 'date')} FROM unified"""


@query("scan_logs", ctes(*b.LOGS) + f"""
SELECT type, count(*) AS n, {big("sum(length(coalesce(content, '')))", 'content_length')},
       {big("count(DISTINCT usr)", 'users')}, {when('min(date)', 'first_date')}, {when('max(date)', 'last_date')},
       {big("sum(length(coalesce(url, '')) + length(coalesce(filename, '')) + length(coalesce(bcc, '')) + length(coalesce(activity, '')))", 'text_length')}
FROM unified GROUP BY type""")
def scan_logs(s):
    """Write the five logs as CSV, read them back with declared columns and summarise each."""
    base = fresh_path(s.spark, "csv")
    for log, df in s.logs().items():
        df.write.options(**log_files.CSV_OPTIONS).csv(f"{base}/{log}.csv")
    text = F.length(F.concat(*[F.coalesce(c, F.lit("")) for c in ("url", "filename", "bcc", "activity")]))
    return log_files.unify(log_files.read_logs(s.spark, base)).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("content_length"),
        F.countDistinct("user").alias("users"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum(text).alias("text_length"))


@query("unify_logs", ctes(*b.LOGS) + _unified_sql)
def unify_logs(s):
    return log_files.unify(s.logs())


@query("week_partition", ctes(*b.LOGS) + f"""
SELECT {big('week', 'week')}, type, count(*) AS n, {when('min(date)', 'first_date')}, {when('max(date)', 'last_date')}
FROM unified GROUP BY week, type""")
def week_partition(s):
    """Weekly files written and read back."""
    path = fresh_path(s.spark, "weekly")
    log_files.write_weeks(s.weeks, path)
    return log_files.read_weeks(s.spark, path).groupBy("week", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("week_number", ctes(b.EV) + f""",
s AS (SELECT CAST(d AS DATE) - CAST(dayofweek(d) AS INTEGER) AS sunday FROM (SELECT min(ts) AS d FROM base WHERE log = 'http'))
SELECT event_id, {big("floor(date_diff('day', (SELECT sunday FROM s), CAST(ts AS DATE)) / 7)", 'week')} FROM base""")
def week_number(s):
    return s.events.select("event_id", calendar.week_number(F.col("ts"), s.sunday()).alias("week"))


@query("day_number", ctes(b.EV) + f"""
SELECT event_id, {big("date_diff('day', DATE '2009-12-28', CAST(ts AS DATE))", 'day')} FROM base""")
def day_number(s):
    return s.events.select("event_id", calendar.day_number(F.col("ts")).alias("day"))


@query("date_text", ctes(b.EV) + " SELECT event_id, strftime(ts, '%Y-%m-%d') AS date FROM base")
def date_text(s):
    return s.events.select("event_id", calendar.date_text(F.col("ts")).alias("date"))


@query("time_code", ctes(b.EV) + f" SELECT event_id, {big(b.TIME_CODE.format('ts'), 'time')} FROM base")
def time_code(s):
    return s.events.select("event_id", calendar.time_code(F.col("ts")).alias("time"))


@query("activity_code", ctes(b.EV) + f" SELECT event_id, {big(b.ACT.replace('type', 'log'), 'act')} FROM base")
def activity_codes(s):
    return s.events.select("event_id", activity_code(F.col("log"), F.col("activity")).alias("act"))


_mail = [n for n in activity.EMAIL_FEATURES]


@query("email_features", ctes(b.MAILS) + " SELECT o_orderkey, " + ", ".join(
    big(b.FEATURE_SQL[n][1], n) for n in _mail) + " FROM mails")
def email_features(s):
    c = {n: F.col(f"`{n}`") for n in ("to", "cc", "bcc", "size", "#att", "content")}
    found = content.email_features(c["to"], c["cc"], c["bcc"], c["size"], c["#att"], c["content"])
    return s.mails.select("o_orderkey", *[found[n].alias(n) for n in _mail])


@query("url_features", ctes(b.WEB, f"d AS (SELECT *, {b.domain('url')} AS dom FROM web)") + " SELECT page_id, " + ", ".join(
    big(b.FEATURE_SQL[n][1], n) for n in activity.HTTP_FEATURES) + " FROM d")
def url_features(s):
    found = content.url_features(F.col("url"), F.col("content"))
    return s.web.select("page_id", *[found[n].alias(n) for n in activity.HTTP_FEATURES])


@query("url_domain", ctes(b.WEB) + f" SELECT page_id, {b.domain('url')} AS domain FROM web")
def url_domain(s):
    return s.web.select("page_id", content.url_domain(F.col("url")).alias("domain"))


@query("url_category", ctes(b.WEB, f"d AS (SELECT *, {b.domain('url')} AS dom FROM web)") + f"""
SELECT {b.category('dom', 'url')} AS http_type, count(*) AS n, min(dom) AS first_domain FROM d GROUP BY 1""".replace(
    "AS http_type", "AS http_type"))
def url_category(s):
    domain = content.url_domain(F.col("url"))
    return s.web.select(content.url_category(domain, F.col("url")).alias("http_type"), domain.alias("d")).groupBy(
        "http_type").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_domain"))


@query("file_features", ctes(b.FILES) + f" SELECT p_partkey, {b.extension('filename')} AS extension, " + ", ".join(
    big(b.FEATURE_SQL[n][1], n) for n in activity.FILE_FEATURES) + " FROM files")
def file_features(s):
    found = content.file_features(F.col("filename"), F.col("content"))
    return s.files.select("p_partkey", content.file_extension(F.col("filename")).alias("extension"),
                          *[found[n].alias(n) for n in activity.FILE_FEATURES])


@query("usb_duration", ctes(*b.ROWS) + f" SELECT actid, {big('act', 'act')}, {big('usb_dur', 'usb_dur')} FROM feats WHERE act IN (3, 4)")
def usb_duration(s):
    sliced = ordering.with_slices(s.rows(), activity.SESSION_KEYS, activity.AXIS)
    return activity.usb_durations(sliced).df.where(F.col("act").isin(3, 4)).select("actid", "act", "usb_dur")


@query("activity_features", ctes(*b.NUMBERS) + " SELECT " + ", ".join(
    [big("week", "week"), "actid", "pcid", when("ts", "time_stamp"), big("uint", "user")]
    + [big(f'"{n}"', n) for n in ["day", "act", "pc", "time", *activity.FEATURES, "mal_act", "insider"]]) + " FROM numeric_rows")
def activity_features(s):
    return activity.numeric_activity(s.weeks, s.users, s.pairs)


@query("pc_code", ctes(*b.NUMBERS) + f" SELECT {big('pc', 'pc')}, count(*) AS n, count(DISTINCT usr) AS users FROM numeric_rows GROUP BY pc")
def pc_codes(s):
    rows = activity.with_user(s.rows(), s.users)
    return rows.groupBy("pc").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"))


@query("insider_interval_label", ctes(*b.NUMBERS) + f" SELECT actid, {big('insider', 'insider')} FROM numeric_rows")
def insider_interval_label(s):
    return activity.with_user(s.rows(), s.users).select("actid", "insider")


@query("mal_act_flag", ctes(*b.NUMBERS) + f" SELECT actid, {big('mal_act', 'mal_act')} FROM numeric_rows")
def mal_act_flag(s):
    return activity.with_malicious_flag(s.rows(), s.pairs).select("actid", "mal_act")




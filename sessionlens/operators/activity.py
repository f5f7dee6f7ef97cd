"""From unified log rows to numeric activity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions import calendar, content
from sessionlens.functions.activity import CONNECT, DISCONNECT, activity_code, pc_code
from sessionlens.operators import ordering
from sessionlens.operators.skew import broadcasts, join_by_key
from sessionlens.operators.ordering import Sliced

SESSION_KEYS = ["week", "user", "pcid"]
AXIS = ordering.time_axis("time_stamp", "actid")
FILE_FEATURES = ["file_type", "file_len", "file_nwords", "disk", "file_depth"]
HTTP_FEATURES = ["http_type", "url_len", "url_depth", "http_c_len", "http_c_nwords"]
EMAIL_FEATURES = [
    "n_des", "n_atts", "Xemail", "n_exdes", "n_bccdes", "exbccmail", "email_size",
    "email_text_slen", "email_text_nwords",
]
FEATURES = ["usb_dur", *FILE_FEATURES, *HTTP_FEATURES, *EMAIL_FEATURES]


def only_for(log: str, features: dict[str, Column]) -> dict[str, Column]:
    """Features of one log; every other row has 0."""
    return {name: F.when(F.col("type") == log, c).otherwise(0).cast("long") for name, c in features.items()}


def row_features(unified_weeks: DataFrame) -> DataFrame:
    """Codes and content features of each row. Long texts end here, before any shuffle.

    What several features of a row share (host, domain, extension) has columns of its own: inside the conditions of a log's
    features it would be computed again wherever it is named.
    """
    unified_weeks = unified_weeks.withColumns({"_host": content.url_host(F.col("url")), "_extension": content.file_extension(F.col("filename"))})
    unified_weeks = unified_weeks.withColumn("_domain", content.url_domain(F.col("url"), F.col("_host")))
    c = {name: F.col(f"`{name}`") for name in unified_weeks.columns}
    extracted = {
        **only_for("file", content.file_features(c["filename"], c["content"], c["_extension"])),
        **only_for("http", content.url_features(c["url"], c["content"], c["_domain"])),
        **only_for("email", content.email_features(c["to"], c["cc"], c["bcc"], c["size"], c["#att"], c["content"])),
    }
    return unified_weeks.select(
        c["id"].alias("actid"),
        c["pc"].alias("pcid"),
        c["date"].alias("time_stamp"),
        c["user"],
        c["week"],
        calendar.day_number(c["date"]).alias("day"),
        activity_code(c["type"], c["activity"]).alias("act"),
        calendar.time_code(c["date"]).alias("time"),
        *[extracted[name].alias(name) for name in FEATURES if name != "usb_dur"],
    )


def usb_durations(sliced: Sliced) -> Sliced:
    """Seconds from a connect to the next device row of the same user, computer and week, where
    that row is a disconnect; else 0. Expects slices over ``SESSION_KEYS``."""
    device = F.col("act").isin(CONNECT, DISCONNECT)
    nxt = ordering.with_next(sliced, F.struct("act", "time_stamp"), "_usb", among=device).df
    paired = (F.col("act") == CONNECT) & (F.col("_usb.act") == DISCONNECT)
    seconds = calendar.epoch_seconds(F.col("_usb.time_stamp")) - calendar.epoch_seconds(F.col("time_stamp"))
    return sliced.of(nxt.withColumn("usb_dur", F.when(paired, seconds).otherwise(0).cast("long")).drop("_usb"))


def with_user(rows: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    """User columns of each row: index, computer code and insider scenario at that time.

    ``users`` is a staged table: broadcast while it is small, else joined with the rows of a user above ``limit``
    dealt over several tasks.
    """
    own = users.select("user", "user_int", F.col("pc").alias("_own"), "sharedpc", "sup_pc", "malscene", "mstart", "mend")
    inside = (F.col("malscene") > 0) & F.col("time_stamp").between(F.col("mstart"), F.col("mend"))
    return (
        join_by_key(rows, own, "user", limit)
        .withColumn("pc", pc_code(F.col("pcid"), F.col("_own"), F.col("sharedpc"), F.col("sup_pc")))
        .withColumn("insider", F.when(inside, F.col("malscene")).otherwise(0))
        .withColumn("user_int", F.coalesce("user_int", F.lit(-1)).cast("long"))
        .drop("_own", "sharedpc", "sup_pc", "malscene", "mstart", "mend")
    )


#: Action pairs that are broadcast, about 20 MB.
MOST_PAIRS = 100_000


def with_malicious_flag(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """1 for rows whose (user, id) is named in an insider's action list. ``pairs`` is a stored table."""
    marked = pairs.select("user", F.col("id").alias("actid"), F.lit(1).alias("mal_act"))
    if broadcasts(rows) and pairs.count() <= MOST_PAIRS:  # the rows stay where they are
        marked = F.broadcast(marked)
    return rows.join(marked, ["user", "actid"], "left").withColumn("mal_act", F.coalesce("mal_act", F.lit(0)))


def numeric_activity(unified_weeks: DataFrame, users: DataFrame, pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """The 30 numeric columns of an activity row, with ``week``."""
    sliced = ordering.with_slices(row_features(unified_weeks), SESSION_KEYS, AXIS, limit)
    rows = with_malicious_flag(with_user(usb_durations(sliced).df, users, limit), pairs)
    return rows.select(
        "week", "actid", "pcid", "time_stamp", F.col("user_int").alias("user"), "day", "act", "pc", "time",
        *FEATURES, "mal_act", "insider",
    )

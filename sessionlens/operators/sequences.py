"""Sequences of consecutive sessions of a user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.operators import ordering
from sessionlens.operators.ordering import HALO, OFFSET, Sliced
from sessionlens.operators.preparation import column

USER_AXIS = ordering.epoch_axis("starttime", "sessionid")

# The columns that get history features.
TEMPORAL_COLUMNS = [
    "http_mean_http_c_len", "http_n_cloudf", "http_socnetf_mean_url_depth", "file_mean_file_len",
    "http_cloudf_mean_url_len", "http_jobf_mean_url_len", "n_usb", "http_n_leakf", "file_n_docf",
    "isafterhour", "n_concurrent_sessions", "http_leakf_mean_http_c_nwords", "http_otherf_mean_url_len",
    "http_otherf_mean_http_c_nwords", "http_mean_http_c_nwords", "http_socnetf_mean_url_len",
    "usb_mean_usb_dur", "role", "n_allact", "ses_start", "http_socnetf_mean_http_c_len",
    "email_n-Xemail1", "http_otherf_mean_http_c_len", "http_n_jobf", "http_leakf_mean_http_c_len",
    "f_unit", "http_jobf_mean_url_depth", "http_n_otherf", "http_leakf_mean_url_depth",
    "email_mean_n_des", "isweekendafterhour", "file_docf_n-disk0", "n_file",
    "http_hackf_mean_url_depth", "n_http", "http_jobf_mean_http_c_nwords",
    "email_mean_email_text_nwords", "duration", "http_socnetf_mean_http_c_nwords", "E",
    "http_leakf_mean_url_len", "http_mean_url_depth", "end_with", "file_n-disk0",
    "http_hackf_mean_http_c_len", "http_hackf_mean_http_c_nwords", "http_jobf_mean_http_c_len",
    "file_docf_mean_file_nwords", "isworkhour", "team", "email_mean_email_size",
    "http_otherf_mean_url_depth", "n_days", "email_mean_email_text_slen",
    "http_cloudf_mean_url_depth", "http_hackf_mean_url_len", "N", "file_docf_mean_file_len",
    "file_mean_file_nwords", "http_n_hackf", "A", "http_mean_url_len", "O", "ses_end",
    "http_n_socnetf", "dept", "C", "ITAdmin",
]


def majority(label: Column, frame, at_least: int, classes: Sequence[int] = (1, 2, 3)) -> Column:
    """Most frequent non-zero label of a frame if it occurs often enough, else 0; the smallest
    label wins a tie."""
    counts = [F.sum((label == c).cast("int")).over(frame) for c in classes]
    most = F.greatest(*counts)
    out = F.lit(0)
    for c, n in reversed(list(zip(classes, counts))):
        out = F.when(n == most, c).otherwise(out)
    return F.when(most >= at_least, out).otherwise(0)


def sequence_windows(
    df: DataFrame,
    features: Sequence[str],
    size: int,
    step: int = 1,
    rule: str = "max",
    at_least: int = 2,
    label: str = "insider",
    keys: Sequence[str] = ("user",),
    axis: ordering.Axis = USER_AXIS,
    limit: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every ``step``-th run of ``size`` consecutive sessions of a user as one row.

    ``features`` is a list of ``size`` vectors, ``y`` the largest, the last or the majority label.
    """
    framed = ordering.frames(df, keys, axis, after=size - 1, limit=limit)
    frame = framed.window.rowsBetween(0, size - 1)
    labels = F.col(label)
    y = {
        "max": lambda: F.max(labels).over(frame),
        "last": lambda: F.lead(labels, size - 1).over(framed.window),
        "majority": lambda: majority(labels, frame, at_least),
    }[rule]()
    vector = F.array(*[column(c).cast("double") for c in features])
    rolled = framed.df.withColumns({"_vector": vector, "_own": (~F.col(HALO)).cast("long")})
    rolled = rolled.select(
        *keys, *carry, HALO,
        (F.sum("_own").over(framed.window.rowsBetween(Window.unboundedPreceding, 0)) - 1 + F.col(OFFSET)).alias("window_no"),
        F.collect_list("_vector").over(frame).alias("features"), y.alias("y"),
    )
    whole = rolled.where(~F.col(HALO) & (F.size("features") == size) & (F.col("window_no") % step == 0))
    return whole.drop(HALO)


def flatten_windows(windows: DataFrame) -> DataFrame:
    return windows.withColumn("features", F.flatten("features"))


def flat_names(features: Sequence[str], size: int) -> list[str]:
    """Names of the entries of a flat window, oldest step first."""
    return [f"{c}_t-{size - 1 - t}" for t in range(size) for c in features]


def _history(df: DataFrame, columns: Sequence[str], length: int, keys, axis, limit) -> tuple[Sliced, list[str]]:
    """The preceding rows as ``length`` lags of one struct: one offset function per lag however
    many columns there are."""
    framed = ordering.frames(df, keys, axis, before=length, limit=limit)
    packed = framed.df.withColumn(
        "_now", F.struct(*[column(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    lags = {f"_lag{k}": F.lag("_now", k).over(framed.window) for k in range(1, length + 1)}
    return framed.of(packed.withColumns(lags)), list(lags)


def temporal_features(
    df: DataFrame,
    columns: Sequence[str],
    length: int = 5,
    meandiff: bool = True,
    percentile: bool = True,
    keys: Sequence[str] = ("user",),
    axis: ordering.Axis = USER_AXIS,
    limit: int | None = None,
) -> DataFrame:
    """History features of each session against up to ``length`` earlier ones of the same user.

    ``<c>_meandiff`` is the value minus the mean of the earlier ones (0 without any);
    ``<c>_pct`` is its average-tie percentile rank among them and itself, from -50 to 50.
    """
    framed, lags = _history(df, columns, length, keys, axis, limit)
    # written as SQL text: one call per feature instead of one per operation
    seen = " + ".join(f"int({lag} IS NOT NULL)" for lag in lags)
    extra = {}
    for i, c in enumerate(columns):
        now, past = f"_now.c{i}", [f"{lag}.c{i}" for lag in lags]
        if percentile:
            below = " + ".join(f"int(coalesce({p} < {now}, false))" for p in past)
            equal = " + ".join(f"int(coalesce({p} = {now}, false))" for p in past)
            extra[f"{c}_pct"] = f"(({below}) + ({equal} + 2) / 2D) / (_seen + 1) * 100 - 50"
        if meandiff:
            total = " + ".join(f"coalesce({p}, 0D)" for p in past)
            extra[f"{c}_meandiff"] = f"IF(_seen > 0, {now} - ({total}) / _seen, 0D)"
    own = framed.df.withColumn("_seen", F.expr(seen)).where(~F.col(HALO))
    kept = [column(c) for c in df.columns]
    return own.select(*kept, *[F.expr(e).alias(name) for name, e in extra.items()])



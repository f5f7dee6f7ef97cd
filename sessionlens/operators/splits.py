"""Train, validation and test parts by time or by user, without leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions.scalars import digest
from sessionlens.operators import ordering
from sessionlens.session import stage

SESSION_AXIS = ordering.epoch_axis("starttime", "user", "sessionid")


def share(of: Column, part: float) -> Column:
    """``int(n * part)``"""
    return F.floor(of * F.lit(part)).cast("long")


def time_user_split(
    df: DataFrame, label: str = "insider", user: str = "user", axis: ordering.Axis = SESSION_AXIS
) -> DataFrame:
    """80 % past, 20 % future by time, the past again 80/20 into train and val. Users that showed
    an incident in the past are taken out of the future, which becomes the test part."""
    past_size = share(F.col("_n"), 0.8)
    within = ordering.among_first(df, axis, {"past": past_size, "train": share(past_size, 0.8)})
    part = F.when(within["train"], "train").when(within["past"], "val").otherwise("test")
    marked = df.withColumn("split", part)
    known = marked.where((F.col("split") != "test") & (F.col(label) != 0)).select(user).distinct()
    future = marked.where(F.col("split") == "test").join(known, user, "left_anti")
    return marked.where(F.col("split") != "test").unionByName(future)


def time_split(df: DataFrame, axis: ordering.Axis = SESSION_AXIS, train: float = 0.64, val: float = 0.80) -> DataFrame:
    """Three parts by time: up to ``train``, up to ``val`` and the rest."""
    within = ordering.among_first(df, axis, {"train": share(F.col("_n"), train), "val": share(F.col("_n"), val)})
    return df.withColumn("split", F.when(within["train"], "train").when(within["val"], "val").otherwise("test"))


def user_labels(df: DataFrame, label: str = "insider", user: str = "user") -> DataFrame:
    return df.groupBy(user).agg(F.max(label).alias(label))


def user_split(df: DataFrame, label: str = "insider", user: str = "user") -> DataFrame:
    """Whole users per part, stratified by their highest label: a fifth for test, an eighth of the
    others for val. Users of a stratum are drawn by hash."""
    users = user_labels(df, label, user).withColumn("_h", digest(F.col(user)))
    axis = ordering.hash_axis("_h", user)
    test = F.floor(F.col("_n") * 0.2 + 0.5)
    cuts = ordering.cut_points(users, [label], axis, {
        "_test": test, "_val": test + F.floor((F.col("_n") - test) * 0.125 + 0.5)})
    part = (
        F.when(F.coalesce(axis.key <= F.col("_test"), F.lit(False)), "test")
        .when(F.coalesce(axis.key <= F.col("_val"), F.lit(False)), "val")
        .otherwise("train")
    )
    # one row per label value
    members = users.join(F.broadcast(cuts), label, "left").select(user, part.alias("split"))
    return df.join(members, user)


def _ranked(users: DataFrame, label: str, axis: ordering.Axis, limit: int | None) -> DataFrame:
    return ordering.row_index(users, [label], axis, "_rank", limit)


def deal_folds(users: DataFrame, folds: int, label: str, user: str, size: str, limit: int | None = None) -> DataFrame:
    """Give every user a ``fold`` so that labels and sizes are spread evenly.

    The users of a label are laid by falling size and hash and dealt to and fro over the folds, so a label's users per
    fold differ by at most one, and its rows per fold by at most its largest user's.
    """
    laid = users.withColumns({"_less": -F.col(size).cast("long"), "_h": digest(F.col(user))})
    bucket = "_less * 65536 + cast(conv(substr(_h, 1, 4), 16, 10) as bigint)"
    ranked = _ranked(laid, label, ordering.Axis(("_less", "_h", user), bucket, 1 << 16), limit)
    # one row per label value
    counts = users.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(label, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    at = F.col("_rank") % folds
    turned = F.when(F.floor(F.col("_rank") / folds) % 2 == 0, at).otherwise(folds - 1 - at)
    fold = ((F.col("_before") + turned) % folds).cast("int")  # labels begin where the ones before would go on
    return ranked.join(F.broadcast(before), label).select(*users.columns, fold.alias("fold"))


def proportional_draw(users: DataFrame, share_of: float, label: str, user: str, limit: int | None = None) -> DataFrame:
    """Mark ``drawn`` for ``ceil(n * share_of)`` users by hash; labels get seats in proportion, the largest remainders first."""
    counts = users.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy()  # one row per label value
    seats = F.ceil(F.sum("_n").over(whole) * F.lit(share_of)).cast("long")
    quota = counts.withColumn("_seats", seats).withColumn("_all", F.sum("_n").over(whole))
    quota = quota.withColumn("_sure", F.floor(F.col("_n") * F.col("_seats") / F.col("_all")).cast("long"))
    rest = F.col("_n") * F.col("_seats") - F.col("_sure") * F.col("_all")
    quota = quota.withColumn("_more", F.row_number().over(Window.orderBy(rest.desc(), F.col("_n").desc(), label)))
    left = F.col("_seats") - F.sum("_sure").over(whole)
    quota = quota.select(label, (F.col("_sure") + (F.col("_more") <= left).cast("long")).alias("_quota"))
    hashed = users.withColumn("_h", digest(F.col(user)))
    ranked = _ranked(hashed, label, ordering.hash_axis("_h", user), limit)
    return ranked.join(F.broadcast(quota), label).select(*users.columns, (F.col("_rank") < F.col("_quota")).alias("drawn"))


def user_fold_split(
    df: DataFrame, label: str = "insider", user: str = "user", test_folds: int = 5, val_folds: int = 8, limit: int | None = None
) -> DataFrame:
    """Whole users per part: the first of ``test_folds`` folds for test, of the others the first of ``val_folds`` for val.

    Where no label is left with a user for each of the ``val_folds``, an eighth of the others is drawn for val instead,
    by label in proportion. Users are known by their highest label and their number of rows.
    """
    users = df.groupBy(user).agg(F.max(label).alias(label), F.count(F.lit(1)).alias("_rows"))
    dealt = stage(deal_folds(users, test_folds, label, user, "_rows", limit), "folds")
    rest = dealt.where("fold > 0").drop("fold")
    enough = rest.groupBy(label).count().agg(F.max("count").alias("n")).first()["n"]
    if enough is not None and enough >= val_folds:
        second = deal_folds(rest, val_folds, label, user, "_rows", limit).withColumn("val", F.col("fold") == 0)
    else:
        second = proportional_draw(rest, 0.125, label, user, limit).withColumnRenamed("drawn", "val")
    parts = second.select(user, F.when(F.col("val"), "val").otherwise("train").alias("split"))
    members = stage(parts.unionByName(dealt.where("fold = 0").select(user, F.lit("test").alias("split"))), "members")
    return df.join(members, user)


def split_report(split: DataFrame, label: str = "insider", user: str = "user", time: str = "starttime") -> DataFrame:
    """Rows, users, time range and label counts per part."""
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(user).alias("n_users"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        *[F.count(F.when(F.col(label) == c, 1)).alias(f"label_{c}") for c in range(4)],
    )

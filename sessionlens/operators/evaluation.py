"""Confusion matrices, reports, ranking metrics and importance summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.operators import ordering

CLIP = 1e-15


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_share(matrix: DataFrame) -> DataFrame:
    """Share of each prediction inside its actual class; the matrix has classes² rows."""
    return matrix.select("actual", "predicted", (F.col("n") / F.sum("n").over(Window.partitionBy("actual"))).alias("share"))


def classification_report(matrix: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class with accuracy, macro and weighted averages.

    ``matrix`` is a confusion matrix, so everything here is a handful of rows; a class without
    predictions or rows scores 0.
    """
    sides = matrix.select(F.col("actual").alias("cls"), F.col("n").alias("support"), F.lit(0).alias("called"),
                          F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        matrix.select(F.col("predicted").alias("cls"), F.lit(0).alias("support"), F.col("n").alias("called"),
                      F.lit(0).alias("hit")))
    sums = sides.groupBy("cls").agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "called", "hit")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = sums.select(
        F.col("cls").cast("string").alias("name"), "support", "hit",
        ratio(F.col("hit"), F.col("called")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("support") + F.col("called")).alias("f1"))
    total = F.sum("support")
    accuracy = scored.agg((F.sum("hit") / total).alias("a"), total.alias("support")).select(
        F.lit("accuracy").alias("name"), F.col("a").alias("precision"), F.col("a").alias("recall"),
        F.col("a").alias("f1"), "support")
    macro = scored.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")).select(
        F.lit("macro avg").alias("name"), "precision", "recall", "f1", "support")
    weighted = scored.agg(
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")],
        total.alias("support")).select(F.lit("weighted avg").alias("name"), "precision", "recall", "f1", "support")
    rows = scored.select("name", "precision", "recall", "f1", "support")
    whole = rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)
    return whole.select("name", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                        F.col("support").cast("long").alias("support"))


def accuracy_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    right = (F.col(actual) == F.col(predicted)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("total"), F.sum(right).alias("correct"), F.sum(1 - right).alias("incorrect"),
                  F.avg(right.cast("double")).alias("accuracy"))


def score_bucket(score: str) -> str:
    """A whole number that never falls along a score: its power of two and 2^30 steps inside, so that
    scores near 0 (usual for a gate) are told apart as finely as large ones."""
    size = f"abs({score})"
    power = f"floor(log2({size}))"
    steps = f"((cast({power} as bigint) + 1100) * 1073741824 + cast(floor(({size} / pow(2, {power}) - 1) * 1073741824) as bigint))"
    return f"case when {size} < 1e-300 or {score} is null then 0 else cast(sign({score}) as bigint) * {steps} end"


def rank_auc(scores: DataFrame, groups: Sequence[str], score: str, positive: str, limit: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per group: the share of (positive, negative) pairs in right
    order, ties counting half. Equal scores are merged first and counts run along the score."""
    merged = scores.groupBy(*groups, score).agg(
        F.sum(F.col(positive).cast("long")).alias("pos"), F.sum(1 - F.col(positive).cast("long")).alias("neg"))
    axis = ordering.Axis((score,), score_bucket(score), 1 << 24)
    swept = ordering.running(merged, groups, axis, {"upto": F.col("neg")}, limit, bound=scores)
    below = F.col("upto") - F.col("neg") / F.lit(2.0)
    return swept.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("pos") * below), F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def auc_one_vs_rest(df: DataFrame, label: str, probabilities: Sequence[str], limit: int | None = None) -> DataFrame:
    """AUC of each class probability against all other classes."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("cls"), F.col(p).alias("score"), (F.col(label) == c).alias("positive"))
        for c, p in enumerate(probabilities)
    ])
    long = df.select(F.inline(rows))
    return rank_auc(long, ["cls"], "score", "positive", limit)


def auc_mu(df: DataFrame, label: str, probabilities: Sequence[str], limit: int | None = None) -> DataFrame:
    """Mean over class pairs of the AUC that separates the pair by the difference of their scores."""
    pairs = [(i, j) for i in range(len(probabilities)) for j in range(i)]
    rows = F.array(*[
        F.struct(F.lit(f"{i}-{j}").alias("pair"), (F.col(probabilities[i]) - F.col(probabilities[j])).alias("score"),
                 (F.col(label) == i).alias("positive"), F.col(label).isin(i, j).alias("_in"))
        for i, j in pairs
    ])
    long = df.select(F.inline(rows)).where("_in").drop("_in")
    return rank_auc(long, ["pair"], "score", "positive", limit).agg(F.avg("auc").alias("auc_mu"))


def log_loss(df: DataFrame, label: str, probabilities: Sequence[str]) -> DataFrame:
    """Mean negative log probability of the true class, and the error rate of the likeliest one."""
    p = F.array(*[F.col(c) for c in probabilities])
    true = F.greatest(F.least(F.get(p, F.col(label)), F.lit(1 - CLIP)), F.lit(CLIP))
    wrong = (F.array_position(p, F.array_max(p)) - 1 != F.col(label)).cast("double")
    return df.agg(F.avg(-F.log(true)).alias("log_loss"), F.avg(wrong).alias("error"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Count, balanced weight ``n / (k * n_c)`` and the rest-to-class ratio of each class."""
    counts = df.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    total, classes = F.sum("n").over(every), F.count(F.lit(1)).over(every)
    return counts.select("cls", "n", (total / (classes * F.col("n"))).alias("weight"),
                         ((total - F.col("n")) / F.col("n")).alias("ratio"))


def base_feature(name: Column) -> Column:
    """Name without the lag of a flat window."""
    return F.regexp_extract(name, "^(.*)_t-", 1)


def importance_rollup(df: DataFrame, feature: str = "feature", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, base_feature(F.col(feature)).alias("base_feature")).agg(F.sum(value).alias("importance"))


def top_features(rolled: DataFrame, k: int) -> DataFrame:
    return rolled.orderBy(F.desc("importance"), "base_feature").limit(k)


def top_per_class(rolled: DataFrame, cls: str, k: int) -> DataFrame:
    order = Window.partitionBy(cls).orderBy(F.desc("importance"), "base_feature")
    return rolled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mean_absolute(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(value)).alias("importance"))

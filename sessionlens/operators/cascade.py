"""Two-tier decisions. All rules are column expressions over probability columns.

Thresholds are parameters; the sets used by the known pipelines are listed as fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions.scalars import argmax

# Fixed values.
GATE_RECALL_TARGETS = [0.995, 0.95, 0.80, 0.96, 0.97]
RELEASE_THRESHOLDS = [0.90, 0.99, 0.98, 0.995]
SALVAGE_BINARY_THRESHOLDS = [0.25, 0.15, 0.50, 0.30, 0.27]
CLASS_THRESHOLDS = {1: 0.90, 2: 0.60, 3: 0.70}
DEFAULT_GATE, CLAMP_ABOVE, CLAMP_TO = 0.01, 0.20, 0.15


def _first_largest(values: Sequence[Column]) -> Column:
    return argmax(F.array(*values))


def threshold_counts(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Recall and false positive rate at every threshold 0.01 .. 0.99.

    Rows are counted per hundredth first; the cumulative step sees 100 rows. The bucket is corrected
    for the rounding of ``p * 100`` so that it agrees with ``p >= i / 100`` exactly.
    """
    p = F.col(probability)
    rough = F.floor(p * 100)
    bucket = F.when((rough + 1) / F.lit(100.0) <= p, rough + 1).when(rough / F.lit(100.0) > p, rough - 1).otherwise(rough)
    positive = (F.col(label) > 0).cast("long")
    counts = df.groupBy(F.least(bucket, F.lit(99)).cast("int").alias("i")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    grid = df.sparkSession.range(0, 100).select(F.col("id").cast("int").alias("i"))
    filled = grid.join(counts, "i", "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    swept = filled.select(
        "i", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    return swept.where(F.col("i") >= 1).select(
        (F.col("i") / F.lit(100.0)).alias("threshold"), "tp", "fp",
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("p")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.col("fp").cast("double"), F.col("n")), F.lit(0.0)).alias("fpr"))


def gate_threshold(counts: DataFrame, target: float, clamp: bool = False) -> DataFrame:
    """Highest threshold that keeps the target recall (0.01 if none does), as one row."""
    best = F.max(F.when(F.col("recall") >= target, F.struct("threshold", "recall", "fpr")))
    row = counts.agg(best.alias("b")).select(
        F.coalesce("b.threshold", F.lit(DEFAULT_GATE)).alias("threshold"),
        F.coalesce("b.recall", F.lit(0.0)).alias("recall"), F.coalesce("b.fpr", F.lit(1.0)).alias("fpr"))
    if clamp:
        row = row.withColumn(
            "threshold", F.when(F.col("threshold") > CLAMP_ABOVE, CLAMP_TO).otherwise(F.col("threshold")))
    return row


def gate_argmax(gate: Column, expert: Sequence[Column], threshold: float = 0.05) -> Column:
    """Suspects get the expert's class 1..3, everyone else 0."""
    return F.when(gate >= threshold, _first_largest(expert) + 1).otherwise(0)


def release(gate: Column, expert: Sequence[Column], gate_threshold: float, release_threshold: float = 0.90) -> Column:
    """A suspect goes free only if the four-class expert is that sure of class 0."""
    suspect = F.when(expert[0] >= release_threshold, 0).otherwise(_first_largest(expert[1:]) + 1)
    return F.when(gate >= gate_threshold, suspect).otherwise(0)


def salvage_override(first: Column, expert: Sequence[Column], t2: float = 0.18, t3: float = 0.15) -> Column:
    """Rows called 0 get the four-class expert's verdict, overridden by 2 and then by 3."""
    second = F.when(expert[3] > t3, 3).when(expert[2] > t2, 2).otherwise(_first_largest(expert))
    return F.when(first == 0, second).otherwise(first)


def salvage_contest(first: Column, p2: Column, p3: Column, t2: float = 0.1, t3: float = 0.03) -> Column:
    """Rows called 0: class 2 and 3 each need their threshold; with both the larger wins, 3 on a tie."""
    two, three = p2 >= t2, p3 >= t3
    second = F.when(two & three, F.when(p2 > p3, 2).otherwise(3)).when(two, 2).when(three, 3).otherwise(0)
    return F.when(first == 0, second).otherwise(first)


def salvage_binary(first: Column, p: Column, threshold: float) -> Column:
    return F.when((first == 0) & (p >= threshold), 2).otherwise(first)


def salvage_max(first: Column, p2: Column, p3: Column, threshold: float = 0.1) -> Column:
    """Rows called 0: the likelier of classes 2 and 3 if it reaches the threshold, 2 on a tie."""
    second = F.when(F.greatest(p2, p3) >= threshold, F.when(p2 >= p3, 2).otherwise(3)).otherwise(0)
    return F.when(first == 0, second).otherwise(first)


def salvage_ordered(first: Column, p2: Column, p3: Column, t2: float = 0.01, t3: float = 0.20) -> Column:
    """Rows called 0: class 2 is asked first, class 3 only if it declines."""
    return F.when(first == 0, F.when(p2 >= t2, 2).when(p3 >= t3, 3).otherwise(0)).otherwise(first)


def per_class(p: Sequence[Column], thresholds: dict[int, float] | None = None) -> Column:
    """The likeliest class that reaches its own threshold (the first on a tie), else 0."""
    limits = thresholds or CLASS_THRESHOLDS
    passing = {c: F.when(p[c] >= t, p[c]) for c, t in limits.items()}
    best = F.greatest(*passing.values())
    out = F.lit(0)
    for c in sorted(passing, reverse=True):
        out = F.when(passing[c] == best, c).otherwise(out)
    return out


def salvage_counts(df: DataFrame, first: str, final: str) -> DataFrame:
    """How many rows a rule changed, by the class they got."""
    return df.where(F.col(first) != F.col(final)).groupBy(F.col(final).alias("final")).agg(F.count(F.lit(1)).alias("n"))

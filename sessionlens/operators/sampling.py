"""Balancing of classes. Every draw is "the first n rows of a class in hash order".

The order comes from an MD5 of the row id, so a sample has an exact size, is the same on every run
and survives recomputed tasks. The n-th hash is found from bucket counts and the sample is a plain
filter: no class is sorted or sent to one task, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions.scalars import digest, uniform
from sessionlens.operators import ordering
from sessionlens.operators.neighbours import nearest_in_class

HASH = "_h"


def hash_order(df: DataFrame, row_id: str, seed: int = 42) -> tuple[DataFrame, ordering.Axis]:
    return df.withColumn(HASH, digest(F.col(row_id), seed)), ordering.hash_axis(HASH, row_id)


def draw(
    df: DataFrame, groups: Sequence[str], row_id: str, size: Column, strict: bool = False, seed: int = 42
) -> DataFrame:
    """The first ``size`` rows (an expression over the group size ``_n``) of each group by hash.

    With ``strict`` a size above the group is an error, otherwise the whole group is taken.
    ``groups`` has few values (classes, clusters), so the cuts are a handful of rows.
    """
    hashed, axis = hash_order(df, row_id, seed)
    wanted = size.cast("long")
    if strict:
        wanted = F.when(wanted > F.col("_n"), F.raise_error(F.lit("sample larger than its class"))).otherwise(wanted)
    target = {"_cut": F.least(wanted, F.col("_n"))}
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not groups:
        return hashed.where(ordering.among_first(hashed, axis, target)["_cut"]).select(*columns)
    cuts = ordering.cut_points(hashed, groups, axis, target)
    return hashed.join(F.broadcast(cuts), list(groups)).where(axis.key <= F.col("_cut")).select(*columns)


def undersample(df: DataFrame, label: str, row_id: str, targets: dict[int, int], strict: bool = True) -> DataFrame:
    """Reduce the named classes to exact counts; other classes are untouched."""
    size = F.lit(None).cast("long")
    for value, n in targets.items():
        size = F.when(F.col(label) == value, F.lit(n)).otherwise(size)
    named = F.col(label).isin(*targets)
    return df.where(~named).unionByName(draw(df.where(named), [label], row_id, size, strict))


def _reduced(df: DataFrame, label: str, row_id: str, size: Column, majority: int = 0) -> DataFrame:
    """The other classes whole, ``size`` rows of the majority class."""
    rest = df.where(F.col(label) != majority)
    return rest.unionByName(draw(df.where(F.col(label) == majority), [], row_id, size))


def balance_one_to_one(df: DataFrame, label: str, row_id: str, majority: int = 0) -> DataFrame:
    """As many rows of the majority class as of all the others together."""
    return balance_to(df, label, row_id, F.col(label) != majority, majority)


def balance_to(df: DataFrame, label: str, row_id: str, counted: Column, majority: int = 0) -> DataFrame:
    """The majority class reduced to the number of rows where ``counted`` holds (at most its size)."""
    n = df.where(counted).agg(F.count(F.lit(1)).alias("n")).scalar()
    return _reduced(df, label, row_id, n, majority)


def stratified_sample(df: DataFrame, label: str, row_id: str, negatives: int) -> DataFrame:
    """All positives and a fixed number of negatives."""
    return _reduced(df, label, row_id, F.lit(negatives))


def random_subset(df: DataFrame, row_id: str, size: int) -> DataFrame:
    return draw(df, [], row_id, F.lit(size))


def hard_negatives(
    df: DataFrame, label: str, probability: str, row_id: str, threshold: Column | float, share: float = 0.3
) -> DataFrame:
    """All positives, the negatives the gate suspects, and a random share of all negatives."""
    hashed, axis = hash_order(df, row_id)
    negative = F.col(label) == 0
    part = {"share": F.floor(F.col("_n") * F.lit(share)).cast("long")}
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    picked = ordering.among_first(hashed.where(negative), axis, part)["share"]
    keep = ~negative | (F.col(probability) >= limit) | picked
    return hashed.where(keep).drop(HASH)


def shuffle_rows(df: DataFrame, row_id: str, name: str = "position", limit: int | None = None) -> DataFrame:
    """Position of each row in a random order of the whole table."""
    hashed, axis = hash_order(df, row_id)
    return ordering.global_index(hashed, axis, name, limit).drop(HASH)


def cluster_sample(
    df: DataFrame, label: str, row_id: str, vector: str, clusters: int = 12, total: int = 50_000, majority: int = 0,
    assign: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """At most ``total // clusters`` rows of each behaviour cluster of the majority class."""
    from sessionlens.operators.learners import kmeans_clusters

    rows = df.where(F.col(label) == majority)
    placed = assign(rows) if assign else kmeans_clusters(rows, vector, clusters)
    kept = draw(placed, ["cluster"], row_id, F.lit(total // clusters))
    return kept.unionByName(df.where(F.col(label) != majority).withColumn("cluster", F.lit(-1)))


def round_columns(df: DataFrame, columns: Sequence[str], only: Column | None = None) -> DataFrame:
    """Round chosen columns, e.g. codes of rows made by interpolation."""
    test = F.lit(True) if only is None else only
    return df.withColumns({c: F.when(test, F.round(F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")) for c in columns})


def synthetic_rows(
    df: DataFrame, label: str, row_id: str, vector: str, targets: dict[int, int], k: int = 2, checked: bool = True
) -> DataFrame:
    """New rows that bring each named class up to its target: a row moved part of the way towards
    one of its ``k`` nearest neighbours of the same class.

    Rows are used in hash order, round after round; round r uses neighbour 1 + r mod k. A class
    that takes part has fewer rows than its target, which is a parameter, so the neighbour search
    and the numbering below are bounded by the targets and not by the table. A class below its target
    with fewer than two rows has no neighbour to move towards, which is an error. So is a class above its target
    if ``checked``; otherwise it gets no rows.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_m"))
    target = F.lit(None).cast("long")
    for value, n in targets.items():
        target = F.when(F.col(label) == value, F.lit(n)).otherwise(target)
    need = target - F.col("_m")
    if checked:
        need = F.when(need < 0, F.raise_error(F.lit("target below the class size"))).otherwise(need)
    alone = F.raise_error(F.lit("a class of one row has no neighbour to be raised from"))
    need = F.when((need > 0) & (F.col("_m") < 2), alone).otherwise(need)
    short = counts.withColumn("_need", need).where(F.col("_need") > 0)
    # one row per class
    pool = df.select(row_id, label, vector).join(F.broadcast(short), label)
    hashed, axis = hash_order(pool, row_id)
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*axis.by)) - 1)
    copies = F.ceil((F.col("_need") - F.col("_r")) / F.col("_m"))
    planned = ranked.where(F.col("_need") > F.col("_r")).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    planned = planned.withColumn("nn_rank", F.col("copy") % F.greatest(F.least(F.lit(k), F.col("_m") - 1), F.lit(1)) + 1)
    near = nearest_in_class(pool, label, row_id, vector, k).select(row_id, "nn_rank", "nn_id")
    partner = pool.select(F.col(row_id).alias("nn_id"), F.col(vector).alias("_nn"))
    step = uniform(digest(F.col(row_id), tag=F.col("copy")))
    moved = F.zip_with(vector, "_nn", lambda a, b: a + F.col("_step") * (b - a))
    return (
        planned.join(near, [row_id, "nn_rank"]).join(partner, "nn_id").withColumn("_step", step)
        .select(F.col(row_id), F.col("copy").cast("int").alias("copy"), F.col(label), moved.alias(vector))
    )


def smote(
    df: DataFrame, label: str, row_id: str, vector: str, targets: dict[int, int], k: int = 2, checked: bool = True
) -> DataFrame:
    """Original rows (``copy`` = -1) and the synthetic ones. Unless ``checked``, a class above its target stays as it is."""
    return union_synthetic(df.select(row_id, label, vector), synthetic_rows(df, label, row_id, vector, targets, k, checked))


def union_synthetic(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    return original.withColumn("copy", F.lit(-1)).unionByName(synthetic)


def smote_partial(
    df: DataFrame, label: str, row_id: str, vector: str, raw: int, targets: dict[int, int], k: int = 2, checked: bool = True
) -> DataFrame:
    """Interpolate only the first ``raw`` entries; the others of a synthetic row are 0."""
    head = df.withColumn("_raw", F.slice(vector, 1, raw))
    made = synthetic_rows(head, label, row_id, "_raw", targets, k, checked)
    rest = df.select(F.max(F.size(vector)).alias("n")).scalar() - raw
    filled = made.withColumn(vector, F.concat("_raw", F.array_repeat(F.lit(0.0), rest))).drop("_raw")
    return union_synthetic(df.select(row_id, label, vector), filled)

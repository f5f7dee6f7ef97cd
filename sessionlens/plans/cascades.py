"""Session table to two-tier cascade report.

Four workflows: ``flat_cascade`` works on flattened windows of session features, ``history_cascade``
adds history features and fills them with 0 in synthetic rows, ``gate_cascade`` puts a binary gate before
a four-class expert and works on columns that ``skew_prepared`` selects and scales, ``user_cascade`` is judged on unseen users and samples by behaviour clusters. Sizes and thresholds are parameters
with the values of the known pipelines as defaults; a sample size above what a class holds is
reduced to the class, so the same plan runs on small tables.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.scalars import argmax
from sessionlens.operators import cascade, evaluation, learners, preparation, sampling, sequences, splits
from sessionlens.session import stage



@dataclass(frozen=True)
class Settings:
    window: int = 5
    benign: int = 30_000
    synthetic: int = 10_000
    neighbours: int = 2
    trees: int = 20
    depth: int = 8
    weights: dict[int, float] = field(default_factory=lambda: {0: 1.0, 1: 1.5, 2: 3.0, 3: 1.0})
    expert_weights: dict[int, float] = field(default_factory=lambda: {0: 1.0, 1: 5.0, 2: 3.0})


HISTORY = Settings(benign=20_000, synthetic=5_000, weights={})


def _identified(windows: DataFrame) -> DataFrame:
    """A window's id: user index and position, unique as both are below 2^31."""
    return windows.withColumn("id", F.shiftleft(F.col("user").cast("long"), 32) + F.col("window_no"))


def _resample(train: DataFrame, settings: Settings, raw: int | None = None) -> DataFrame:
    """Under-sample class 0, then raise the rare classes that are below the target."""
    size = F.least(F.lit(settings.benign), F.col("_n"))
    kept = train.where(F.col("y") != 0).unionByName(
        sampling.draw(train.where(F.col("y") == 0), ["y"], "id", size))
    return _raised(stage(kept.select("id", "y", "features"), "resampled"), settings, raw)


def _raised(kept: DataFrame, settings: Settings, raw: int | None = None) -> DataFrame:
    """Raise the rare classes that are below the target. A class of fewer than two rows can't be raised, which is
    told as a warning."""
    counts = {r["y"]: r["count"] for r in kept.groupBy("y").count().collect()}
    for c in (1, 2, 3):
        if counts.get(c, 0) < 2:
            warnings.warn(f"class {c} has {counts.get(c, 0)} training rows and is not raised", stacklevel=3)
    targets = {c: settings.synthetic for c in (1, 2, 3) if 1 < counts.get(c, 0) < settings.synthetic}
    if not targets:
        return kept.withColumn("copy", F.lit(-1))
    if raw is None:
        return sampling.smote(kept, "y", "id", "features", targets, settings.neighbours)
    return sampling.smote_partial(kept, "y", "id", "features", raw, targets, settings.neighbours)


def _reported(scored: DataFrame) -> DataFrame:
    tiers = [("first", "pred"), ("final", "final")]
    made = [
        evaluation.classification_report(evaluation.confusion(scored, "y", c)).withColumn("tier", F.lit(name))
        for name, c in tiers
    ]
    return made[0].unionByName(made[1])


def flat_cascade(sessions: DataFrame, settings: Settings = Settings(), names: list[str] | None = None) -> DataFrame:
    """Multiclass tier, three-class expert on the rows called 0, contest of classes 2 and 3.

    ``names`` are the features: by default every column that doesn't identify a session.
    """
    names = preparation.feature_columns(sessions, leakage=False) if names is None else names
    split = splits.time_user_split(sessions).fillna(0, names)
    windows = stage(_identified(sequences.flatten_windows(sequences.sequence_windows(
        split, names, settings.window, keys=["split", "user"]))), "windows")
    train, test = (windows.where(F.col("split") == p) for p in ("train", "test"))
    balanced = stage(_resample(train, settings), "balanced")
    first = learners.train_multiclass(balanced, settings.weights, settings.trees, settings.depth)
    mapping = {0: 0, 2: 1, 3: 2}
    rest = sampling.balance_to(balanced.where(F.col("y").isin(*mapping)).withColumn(
        "row", F.concat_ws(":", "id", "copy")), "y", "row", F.col("y").isin(2, 3))
    expert = learners.train_expert(rest, mapping, settings.expert_weights, trees=settings.trees, depth=settings.depth)
    called = learners.score(first, test).withColumn("pred", argmax(F.col("p")))
    scored = learners.score(expert, called, "e")
    two, three = (F.coalesce(F.get("e", F.lit(i)), F.lit(0.0)) for i in (1, 2))
    return _reported(scored.withColumn("final", cascade.salvage_contest(F.col("pred"), two, three)))


def history_cascade(sessions: DataFrame, settings: Settings = HISTORY, threshold: float = 0.25) -> DataFrame:
    """Scaled and frequency-encoded sessions with history features; binary expert for class 2."""
    split = stage(splits.time_user_split(sessions), "split")
    train = split.where(F.col("split") == "train")
    names = preparation.feature_columns(sessions, leakage=False)
    dead = set(preparation.names_where(preparation.dead_columns(train, names), "dead"))
    names = [c for c in names if c not in dead]
    numeric = [c for c in names if c not in preparation.CATEGORICAL]
    coded = preparation.frequency_encode(split, train, [c for c in preparation.CATEGORICAL if c in names])
    scaled = preparation.standard_scale(coded.fillna(0, numeric), train.fillna(0, numeric), numeric)
    raw = [c for c in sequences.TEMPORAL_COLUMNS if c in names]
    enriched = sequences.temporal_features(scaled, raw, keys=["split", "user"])
    history = [f"{c}_{kind}" for kind in ("pct", "meandiff") for c in raw]
    windows = sequences.sequence_windows(enriched, raw + history, settings.window, keys=["split", "user"])
    # raw entries of all steps first, so that synthetic rows can leave the history part at 0
    width = len(raw)
    head = F.flatten(F.transform("features", lambda v: F.slice(v, 1, width)))
    tail = F.flatten(F.transform("features", lambda v: F.slice(v, width + 1, 2 * width)))
    windows = stage(_identified(windows.withColumn("features", F.concat(head, tail))), "windows")
    train_rows, test = (windows.where(F.col("split") == p) for p in ("train", "test"))
    balanced = stage(_resample(train_rows, settings, width * settings.window), "balanced")
    first = learners.train_multiclass(balanced, settings.weights, settings.trees, settings.depth)
    pair = train_rows.where(F.col("y").isin(0, 2))
    expert = learners.train_expert(
        sampling.balance_one_to_one(pair, "y", "id"), {0: 0, 2: 1}, trees=settings.trees, depth=settings.depth)
    called = learners.score(first, test).withColumn("pred", argmax(F.col("p")))
    scored = learners.score(expert, called, "e")
    two = F.coalesce(F.get("e", F.lit(1)), F.lit(0.0))
    return _reported(scored.withColumn("final", cascade.salvage_binary(F.col("pred"), two, threshold)))


USERS = Settings(window=4, benign=50_000, weights={}, expert_weights={0: 1.0, 1: 2.0, 2: 5.0})


def user_called(sessions: DataFrame, settings: Settings = USERS, clusters: int = 12, threshold: float = 0.1) -> DataFrame:
    """The test windows of unseen users with ``pred`` (first tier) and ``final``.

    Parts are whole users, dealt in folds by label and size. Windows bear the label of their last session and are
    scaled per feature over all their steps. Benign training windows are drawn evenly from behaviour clusters, so
    that rare habits stay; the rare classes are raised. Rows called 0 get the likelier of classes 2 and 3 if the
    three-class expert finds it likely enough.
    """
    names = preparation.feature_columns(sessions, leakage=False)
    split = stage(splits.user_fold_split(sessions).fillna(0, names), "split")
    steps = stage(sequences.sequence_windows(split, names, settings.window, rule="last", keys=["split", "user"]), "steps")
    scaled = preparation.scale_steps(steps, steps.where(F.col("split") == "train"), "features", len(names))
    windows = stage(_identified(sequences.flatten_windows(scaled)), "windows")
    train, test = (windows.where(F.col("split") == p) for p in ("train", "test"))
    kept = sampling.cluster_sample(train.select("id", "y", "features"), "y", "id", "features", clusters, settings.benign)
    balanced = stage(_raised(stage(kept.select("id", "y", "features"), "clustered"), settings), "balanced")
    first = learners.train_multiclass(balanced, settings.weights, settings.trees, settings.depth)
    mapping = {0: 0, 2: 1, 3: 2}
    rest = balanced.where(F.col("y").isin(*mapping))
    expert = learners.train_expert(rest, mapping, settings.expert_weights, trees=settings.trees, depth=settings.depth)
    called = learners.score(first, test).withColumn("pred", argmax(F.col("p")))
    scored = learners.score(expert, called, "e")
    two, three = (F.coalesce(F.get("e", F.lit(i)), F.lit(0.0)) for i in (1, 2))
    return scored.select("id", "y", "pred", cascade.salvage_max(F.col("pred"), two, three, threshold).alias("final"))


def user_cascade(sessions: DataFrame, settings: Settings = USERS) -> DataFrame:
    """The report of both tiers of :func:`user_called`."""
    return _reported(stage(user_called(sessions, settings), "called"))


@dataclass(frozen=True)
class GateSettings:
    window: int = 5
    recall: float = 0.995
    clamp: bool = True
    share: float = 0.3
    released: float = 0.90
    rounds: int = 20
    gate_depth: int = 4
    trees: int = 20
    depth: int = 8
    weights: dict[int, float] = field(default_factory=lambda: {0: 1.0, 1: 5.0, 2: 40.0, 3: 80.0})


def skew_prepared(sessions: DataFrame, scale: str = "standard") -> tuple[DataFrame, list[str], list[str]]:
    """The split sessions with scaled columns, the names that stay, and those of them that are numeric.

    All choices are made on the training part: columns of at most five values stay as they are, of the others
    those without deviation and the unprotected sparse ones go, skewed ones get a signed logarithm, and all are
    scaled, ``standard`` or ``minmax``. Missing values count as 0.
    """
    names = preparation.feature_columns(sessions)
    split = stage(splits.time_user_split(sessions).fillna(0, names), "split")
    train = split.where(F.col("split") == "train")
    few = set(preparation.names_where(preparation.binary_columns(train, names), "binary"))
    numeric = [c for c in names if c not in few]
    dead = set(preparation.names_where(preparation.dead_by_std(train, numeric), "dead"))
    sparse = set(preparation.names_where(preparation.sparse_columns(train, numeric), "sparse"))
    numeric = [c for c in numeric if c not in dead | sparse]
    skewed = preparation.names_where(preparation.skewed_columns(train, numeric), "skewed")
    logged = preparation.apply_signed_log(split, skewed)
    scaler = {"standard": preparation.standard_scale, "minmax": preparation.minmax_scale}[scale]
    scaled = scaler(logged, logged.where(F.col("split") == "train"), numeric)
    return scaled, [c for c in names if c in few or c in numeric], numeric


def skew_audit(sessions: DataFrame, scale: str = "standard") -> DataFrame:
    """What skew treatment left: largest value, mean, deviation and skewness of every scaled column in the training part."""
    prepared, _, numeric = skew_prepared(sessions, scale)
    return preparation.audit(prepared.where(F.col("split") == "train"), numeric)


def gate_called(sessions: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """The test windows with ``gate`` (probability), ``threshold``, ``suspect`` and ``final``.

    The gate tells incidents from the rest; its threshold is the highest that keeps the recall on the validation
    part, clamped if it lies above what a shifted test part bears. The expert learns from all incidents, the
    benign windows that the gate suspects and a share of all benign ones, and may release a suspect only if it
    is sure. Windows are wide, so they are written once and every part is scored where it is read; the share is drawn by id
    and label alone.
    """
    prepared, names, _ = skew_prepared(sessions)
    windows = stage(_identified(sequences.flatten_windows(sequences.sequence_windows(
        prepared, names, settings.window, keys=["split", "user"]))), "windows")
    train, val = (windows.where(F.col("split") == p) for p in ("train", "val"))
    gate = learners.train_gate(train, val, settings.rounds, settings.gate_depth)
    gated = learners.score(gate, windows, "g").withColumn("gate", F.get("g", F.lit(1))).drop("g")
    train, val, test = (gated.where(F.col("split") == p) for p in ("train", "val", "test"))
    counts = cascade.threshold_counts(val, "y", "gate")
    threshold = float(cascade.gate_threshold(counts, settings.recall, settings.clamp).first()["threshold"])
    kept = stage(sampling.hard_negatives(train, "y", "gate", "id", threshold, settings.share).select("id", "y", "features"), "hard")
    expert = learners.train_multiclass(kept, settings.weights, settings.trees, settings.depth)
    scored = learners.score(expert, test, "e")
    chances = [F.coalesce(F.get("e", F.lit(i)), F.lit(0.0)) for i in range(4)]
    return scored.select(
        "id", "y", "gate", F.lit(threshold).alias("threshold"), (F.col("gate") >= threshold).cast("int").alias("suspect"),
        cascade.release(F.col("gate"), chances, threshold, settings.released).alias("final"))


def gate_cascade(sessions: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """The report of the gate (incident or not) and of the whole cascade (four classes)."""
    called = stage(gate_called(sessions, settings), "called")
    binary = called.withColumn("y", (F.col("y") > 0).cast("int"))
    tiers = {"gate": evaluation.confusion(binary, "y", "suspect"), "final": evaluation.confusion(called, "y", "final")}
    made = [evaluation.classification_report(m).withColumn("tier", F.lit(n)) for n, m in tiers.items()]
    return made[0].unionByName(made[1])

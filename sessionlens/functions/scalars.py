"""Small numeric and hashing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def digest(row_id: Column, seed: int = SEED, tag: Column | None = None) -> Column:
    """Reproducible random order of a row: an MD5 over its id and the seed."""
    parts = [row_id.cast("string")] + ([tag.cast("string")] if tag is not None else [])
    return F.md5(F.concat_ws("-", *parts, F.lit(str(seed))))


def uniform(hex_digest: Column) -> Column:
    """A draw from [0, 1): the first 32 bits of a digest."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def clip(x: Column, low: float = -3.0, high: float = 3.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def clean_numeric(x: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def epoch_to_time(text: Column) -> Column:
    """Seconds since 1970 given as text or number; null where it is not a number."""
    return F.timestamp_seconds(text.try_cast("double")).cast("timestamp_ntz")


def argmax(vector: Column) -> Column:
    """Index of the largest entry, the first one on a tie."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def remap(label: Column, mapping: dict[int, int]) -> Column:
    """Replace labels by a fixed mapping; null for a label it does not name."""
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), label.cast("int"))


def one_hot_label(label: Column, classes: int) -> Column:
    return F.array(*[F.when(label == c, 1.0).otherwise(0.0) for c in range(classes)])


def weight_of(label: Column, weights: dict[int, float]) -> Column:
    """Row weight by class; 1.0 for a class the map leaves out."""
    pairs = [F.lit(v) for k, w in weights.items() for v in (k, float(w))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label.cast("int")), F.lit(1.0))

"""Column selection, scaling and encoding. Statistics come from the training part only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.scalars import clean_numeric, signed_log
from sessionlens.operators import ordering
from sessionlens.session import stage

# Columns that identify rather than describe, and columns dropped on request.
IDENTIFIERS = ["insider", "starttime", "endtime", "sessionid", "user", "day", "week"]
WEB_MEASURES = ["url_len", "url_depth", "http_c_len", "http_c_nwords"]
LEAKAGE = [c for g in ("leakf", "hackf") for c in [f"http_n_{g}", *[f"http_{g}_mean_{m}" for m in WEB_MEASURES]]]
SUSPECT = [
    "file_n_phof", "file_phof_mean_file_len", "file_phof_mean_file_nwords",
    "file_phof_n-disk0", "file_phof_n-disk1", "file_phof_n-disk2",
    "http_n_cloudf", *[f"http_cloudf_mean_{m}" for m in WEB_MEASURES],
]
OPTIONAL = [f"file_{g}_n-disk{d}" for g in ("compf", "txtf", "exef") for d in (1, 2)]
CATEGORICAL = ["pc", "start_with", "end_with", "role", "b_unit", "f_unit", "dept", "team", "ITAdmin"]
PROTECTED_PREFIXES = ("n_", "file_", "email_", "http_", "usb", "logon")
#: Levels that may become columns.
MOST_LEVELS = 2_000
SPARSE_SHARE, BINARY_VALUES, SKEW_VALUES, SKEW_LIMIT, RARE_FREQUENCY = 0.99, 5, 10, 3.0, 0.01


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def feature_columns(
    df: DataFrame, leakage: bool = True, suspect: bool = False, optional: bool = False, extra: Sequence[str] = ()
) -> list[str]:
    """Columns that describe a session, in table order, without the lists asked to be dropped."""
    out = {*IDENTIFIERS, *extra, *(LEAKAGE if leakage else []), *(SUSPECT if suspect else []), *(OPTIONAL if optional else [])}
    return [c for c in df.columns if c not in out and c != "split"]


def known(x: Column) -> Column:
    """The value as a double, with NaN as null: a missing value is no value."""
    return F.nullif(x.cast("double"), F.lit(float("nan")))


def per_column(df: DataFrame, columns: Sequence[str], measures: dict[str, callable]) -> DataFrame:
    """One scan, one row per column with each measure. NaN counts as null.

    Values are aggregated in long form under a small integer key: the plan stays short and compiled
    however many columns there are, and map-side combine leaves one row per column and task. (One wide
    aggregate of all columns was tried and took several times as long.)
    """
    long = df.select(F.posexplode(F.array(*[known(column(c)) for c in columns])).alias("pos", "v"))
    stats = long.groupBy("pos").agg(*[m(F.col("v")).alias(name) for name, m in measures.items()])
    names = F.array(*[F.lit(c) for c in columns])
    return stats.select(F.get(names, F.col("pos")).alias("column"), *measures)


def skew(x: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant column."""
    n = F.count(x).cast("double")
    corrected = F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(F.min(x) < F.max(x), corrected).otherwise(0.0)


def dead_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``dead`` for columns with at most one value (nulls do not count)."""
    return per_column(df, columns, {"low": F.min, "high": F.max}).select(
        "column", (~F.coalesce(F.col("low") < F.col("high"), F.lit(False))).alias("dead"))


def dead_by_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``dead`` for columns whose sample deviation is not above 0."""
    return per_column(df, columns, {"std": F.stddev_samp}).select(
        "column", (~F.coalesce(F.col("std") > 0, F.lit(False))).alias("dead"))


def sparse_columns(df: DataFrame, columns: Sequence[str], share: float = SPARSE_SHARE) -> DataFrame:
    """``sparse`` for columns that are nearly always 0, unless their name is protected."""
    protected = [c for c in columns if c.startswith(PROTECTED_PREFIXES)]
    zero = per_column(df, columns, {"zero_share": lambda x: F.avg((x == 0).cast("double"))})
    return zero.select("column", "zero_share", ((F.col("zero_share") > share) & ~F.col("column").isin(protected)).alias("sparse"))


def few_values(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """Number of distinct values of each column, counted up to ``most + 1``.

    Each task keeps at most that many values per column and emits only those, so the shuffle holds
    a few values per column and task whatever the cardinality; no built-in aggregate stops early.
    Nulls and NaN are no values.
    """
    names = list(columns)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        kept = {name: set() for name in names}
        for batch in batches:
            for i, name in enumerate(names):
                if len(kept[name]) <= most:
                    kept[name].update(pc.unique(pc.drop_null(batch.column(i)))[: most + 1].to_pylist())
        pairs = [(name, v) for name in names for v in sorted(kept[name])[: most + 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())],
            names=["column", "value"])

    narrow = df.select(*[known(column(c)).alias(c) for c in names])
    values = narrow.mapInArrow(scan, "column string, value double").distinct()
    counted = values.groupBy("column").agg(F.count("value").alias("n"))
    return counted.select("column", F.least("n", F.lit(most + 1)).alias("values"))


def binary_columns(df: DataFrame, columns: Sequence[str], most: int = BINARY_VALUES) -> DataFrame:
    return few_values(df, columns, most).select("column", (F.col("values") <= most).alias("binary"))


def skewed_columns(
    df: DataFrame, columns: Sequence[str], limit: float = SKEW_LIMIT, more_than: int | None = SKEW_VALUES
) -> DataFrame:
    """``skewed`` for columns beyond the skewness limit (and, if asked, with enough values)."""
    measured = per_column(df, columns, {"skewness": skew})
    test = F.abs("skewness") > limit
    if more_than is None:
        return measured.select("column", "skewness", test.alias("skewed"))
    many = few_values(df, columns, more_than)
    return measured.join(many, "column", "left").select(
        "column", "skewness", (test & (F.coalesce("values", F.lit(0)) > more_than)).alias("skewed"))


def names_where(report: DataFrame, flag: str) -> list[str]:
    """Column names a report flags; a report has one row per column of the table."""
    return sorted(r["column"] for r in report.where(F.col(flag)).select("column").collect())


def clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clean_numeric(column(c)) for c in columns})


def apply_signed_log(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: signed_log(column(c)) for c in columns})


def _fitted(df: DataFrame, train: DataFrame, columns: Sequence[str], measures: dict[str, callable]) -> tuple[DataFrame, callable]:
    """Attach the training statistics as one struct column (a scalar subquery, run once)."""
    fields = [m(column(c)).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, m in measures.items()]
    row = train.agg(F.struct(*fields).alias("fit")).scalar()
    return df.withColumn("_fit", row), lambda name, i: F.col("_fit").getField(f"{name}_{i}")


def standard_scale(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of the training part; a constant column is only centred."""
    fitted, stat = _fitted(df, train, columns, {"mean": F.avg, "std": F.stddev_pop})
    scaled = {
        c: (column(c) - stat("mean", i)) / F.when(stat("std", i) > 0, stat("std", i)).otherwise(1.0)
        for i, c in enumerate(columns)
    }
    return fitted.withColumns(scaled).drop("_fit")


def minmax_scale(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / range of the training part; a constant column becomes its distance from min."""
    fitted, stat = _fitted(df, train, columns, {"low": F.min, "high": F.max})
    scaled = {}
    for i, c in enumerate(columns):
        width = stat("high", i) - stat("low", i)
        scaled[c] = (column(c) - stat("low", i)) / F.when(width > 0, width).otherwise(1.0)
    return fitted.withColumns(scaled).drop("_fit")


def scale_positions(df: DataFrame, train: DataFrame, vector: str, positions: Sequence[int], length: int) -> DataFrame:
    """Standard scaling of chosen positions of a flat window, fitted per position."""
    fields = [
        m(F.col(vector)[p]).alias(f"{name}_{p}") for p in positions for name, m in (("mean", F.avg), ("std", F.stddev_pop))
    ]
    row = train.agg(F.struct(*fields).alias("fit")).scalar()
    chosen = set(positions)

    def value(p: int) -> Column:
        x = F.col(vector)[p]
        if p not in chosen:
            return x
        std = F.col("_fit").getField(f"std_{p}")
        return (x - F.col("_fit").getField(f"mean_{p}")) / F.when(std > 0, std).otherwise(1.0)

    return df.withColumn("_fit", row).withColumn(vector, F.array(*[value(p) for p in range(length)])).drop("_fit")


def scale_steps(df: DataFrame, train: DataFrame, vector: str, width: int) -> DataFrame:
    """Standard scaling of windows (a list of ``width`` values per step), fitted per value over all steps."""
    steps = train.select(F.explode(vector).alias("_v"))
    fields = [m(F.col("_v")[i]).alias(f"{name}_{i}") for i in range(width) for name, m in (("mean", F.avg), ("std", F.stddev_pop))]
    fit = F.col("_fit")

    def value(v: Column, i: int) -> Column:
        std = fit.getField(f"std_{i}")
        return (v[i] - fit.getField(f"mean_{i}")) / F.when(std > 0, std).otherwise(1.0)

    fitted = df.withColumn("_fit", steps.agg(F.struct(*fields).alias("fit")).scalar())
    return fitted.withColumn(vector, F.transform(vector, lambda v: F.array(*[value(v, i) for i in range(width)]))).drop("_fit")


def frequency_encode(df: DataFrame, train: DataFrame, columns: Sequence[str], floor: float = RARE_FREQUENCY) -> DataFrame:
    """Share of a value in the training part, at least ``floor``; unseen values get ``floor``.

    All columns are counted in one pass over the training part. The counts are stored, so the size
    of each lookup is known and Spark broadcasts only those that fit.
    """
    values = F.array(*[column(c).cast("string") for c in columns])
    counts = stage(
        train.select(F.posexplode(values).alias("pos", "value")).groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n")),
        "frequencies")
    totals = counts.where(F.col("value").isNotNull()).groupBy("pos").agg(F.sum("n").cast("double").alias("total"))
    counts = stage(counts.join(totals, "pos"), "frequency-shares")
    out = df
    for i, c in enumerate(columns):
        seen = counts.where((F.col("pos") == i) & F.col("value").isNotNull()).select(
            F.col("value").alias("_value"), (F.col("n") / F.col("total")).alias("_n"))
        share = F.coalesce(F.greatest(F.col("_n"), F.lit(floor)), F.lit(floor))
        out = out.join(seen, column(c).cast("string") == F.col("_value"), "left").withColumn(c, share).drop("_value", "_n")
    return out


def levels(train: DataFrame, name: str) -> list:
    """Sorted values of a category in the training part, one per column of the one-hot form: at most MOST_LEVELS."""
    found = train.select(column(name)).where(column(name).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{name} has more than {MOST_LEVELS} levels: use one_hot_index")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, train: DataFrame, name: str, values: Sequence | None = None) -> DataFrame:
    """0/1 columns for the training levels except the first; values unseen in training are all 0.

    The result has a column per level, so the levels are few by its nature (``values`` gives them
    where they are known); :func:`one_hot_index` is the form for categories of any size.
    """
    found = levels(train, name) if values is None else list(values)
    flags = {f"{name}_{v}": F.when(column(name) == v, 1).otherwise(0) for v in found[1:]}
    return df.withColumns(flags).drop(name)


def one_hot_index(df: DataFrame, train: DataFrame, name: str) -> DataFrame:
    """The sparse one-hot form: the position of the single 1 (from 0 for the second training level),
    null where all are 0. Levels stay a table and are joined, however many there are."""
    found = train.select(column(name).alias("_level")).where("_level is not null").distinct()
    places = ordering.text_index(found.withColumn("_text", F.col("_level").cast("string")), ["_text", "_level"], "_place").drop("_text")
    joined = df.join(stage(places, "levels"), column(name) == F.col("_level"), "left")
    return joined.withColumn(f"{name}_index", F.when(F.col("_place") > 0, F.col("_place") - 1)).drop(name, "_level", "_place")


def audit(df: DataFrame, columns: Sequence[str], limit: float = SKEW_LIMIT) -> DataFrame:
    """Largest value, mean, deviation and skewness per column, to four places."""
    stats = per_column(df, columns, {"max": F.max, "mean": F.avg, "std": F.stddev_samp, "skewness": skew})
    rounded = [F.round(c, 4).alias(c) for c in ("max", "mean", "std", "skewness")]
    return stats.select("column", *rounded, (F.abs("skewness") > limit).alias("still_skewed"))

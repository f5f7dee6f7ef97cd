"""Ordered work inside groups of any size.

Everything in this workflow that follows time (sessions, sequence windows, time splits, exact
samples) is "rows of a group in order". A plain ``Window.partitionBy(group)`` puts a whole group
into one task, which fails once a single user owns a third of the log. Here a group above a row
limit is cut along its order into slices of near-equal size; windows run per ``(group, slice)``
and what has to cross a slice border travels in small tables with one row per slice.

Group sizes are measured before the plan is built, so data without a large group pays one narrow
count and gets the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sessionlens.session import stage

ROWS_PER_SLICE = 4_000_000
#: Rows dealt to a task whose aggregation or join makes them several hundred columns wide.
ROWS_PER_TASK = 100_000

SLICE = "_slice"
LAST = "_last_slice"
HALO = "_halo"
OFFSET = "_offset"
_COARSE = "_coarse"
_FINE = "_fine"


@dataclass(frozen=True)
class Axis:
    """A total order inside a group.

    ``by`` are the sort columns (unique together inside a group), ``bucket`` is a SQL expression
    for an integer that never falls along ``by``, and ``width`` buckets make one coarse bucket. Both levels keep the
    histograms that place the cuts small.
    """

    by: tuple[str, ...]
    bucket: str
    width: int

    @property
    def fine(self) -> Column:
        return F.expr(self.bucket).cast("long")

    @property
    def coarse(self) -> Column:
        return F.floor(self.fine / F.lit(self.width)).cast("long")

    @property
    def key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.by])


def time_axis(ts: str, *ties: str) -> Axis:
    """Order by a timestamp column, second by second within days."""
    return Axis((ts, *ties), f"unix_seconds(cast({ts} as timestamp))", 86_400)


def epoch_axis(seconds: str, *ties: str) -> Axis:
    """Order by a numeric epoch column."""
    return Axis((seconds, *ties), f"floor({seconds})", 86_400)


def hash_axis(digest: str, *ties: str) -> Axis:
    """Order by a hex digest column: uniform, so any prefix cuts evenly."""
    return Axis((digest, *ties), f"conv(substr({digest}, 1, 8), 16, 10)", 1 << 16)


@dataclass(frozen=True)
class Sliced:
    """Rows with ``_slice`` and ``_last_slice``; ``cut`` tells whether any group has several slices."""

    df: DataFrame
    keys: list[str]
    axis: Axis
    cut: bool

    def of(self, df: DataFrame) -> Sliced:
        return Sliced(df, self.keys, self.axis, self.cut)

    @property
    def slots(self) -> list[str]:
        return [*self.keys, SLICE]

    @property
    def window(self) -> WindowSpec:
        """A row's own slice in order."""
        return Window.partitionBy(*self.slots).orderBy(*self.axis.by)

    @property
    def border_rows(self) -> DataFrame:
        """Rows of groups that were cut; the only ones whose slices need anything from outside."""
        return self.df.where(F.col(LAST) > 0)

    def attach(self, carry: DataFrame) -> Sliced:
        """Join a table of one row per slice; its size is rows/limit, so it is broadcast."""
        return self.of(self.df.join(F.broadcast(carry), self.slots, "left"))

    def before(self, summary: DataFrame, sums: dict[str, str]) -> DataFrame:
        """Per slice, the sum of each column over all earlier slices."""
        earlier = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        return summary.select(
            *self.slots, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for name, c in sums.items()])


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` dealt by ``keys`` over one task per ``ROWS_PER_TASK`` of its ``rows``; as it is, if they are fewer.

    Adaptive execution joins partitions by the bytes of what is shuffled, so narrow rows that an aggregation widens would
    need memory in proportion to the input. A number given here stays.
    """
    if rows <= ROWS_PER_TASK:
        return df
    return df.repartition(max(-(-rows // ROWS_PER_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def has_large_group(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """Whether any group has more than ``limit`` rows. A narrow count that decides the plan."""
    narrow = df.select(*keys)
    if narrow.count() <= limit:
        return False
    return not narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).isEmpty()


def with_slices(
    df: DataFrame, keys: Sequence[str], axis: Axis, limit: int | None = None, bound: DataFrame | None = None
) -> Sliced:
    """Cut every group of more than ``limit`` rows along its order.

    Group sizes are measured first, on ``bound`` where that is given (a stored table whose groups
    are at least as large, so that ``df`` need not be computed twice). Without a large group the
    plan stays a plain window per group. With one, rows are dealt by (group, slice), as input that
    is already dealt by group would otherwise keep all slices of a group in one task. Slice numbers are contiguous, every slice holds
    at least one row, and the cuts are stored as a table with one row per (large group, coarse
    bucket): its size follows rows/limit, which is what makes its broadcast safe.
    """
    limit = ROWS_PER_SLICE if limit is None else limit
    keys = list(keys)
    if not has_large_group(df if bound is None else bound, keys, limit):
        whole = df.withColumns({SLICE: F.lit(0), LAST: F.lit(0)})
        return Sliced(whole, keys, axis, False)
    source = df if bound is None else stage(df, "ordered")
    marked = source.withColumns({_COARSE: axis.coarse, _FINE: axis.fine})
    lookup = stage(_cuts(marked, keys, limit), "cuts")
    position = F.col("_base") + F.size(F.filter("_starts", lambda s: s <= F.col(_FINE))) - 1
    sliced = (
        marked.join(F.broadcast(lookup), [*keys, _COARSE], "left")
        .withColumns({SLICE: F.coalesce(position, F.lit(0)).cast("int"),
                      LAST: F.coalesce(F.col(LAST), F.lit(0)).cast("int")})
        .drop(_COARSE, _FINE, "_base", "_starts")
    )
    return Sliced(sliced.repartition(*keys, SLICE), keys, axis, True)


def _cuts(marked: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Per (large group, coarse bucket): number of its first slice and the buckets where slices start."""
    large = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)
    hist = stage(
        marked.join(F.broadcast(large), keys, "left_semi").groupBy(*keys, _COARSE, _FINE)
        .agg(F.count(F.lit(1)).alias("_n")), "histogram")
    coarse_order = Window.partitionBy(*keys).orderBy(_COARSE).rowsBetween(Window.unboundedPreceding, -1)
    before = hist.groupBy(*keys, _COARSE).agg(F.sum("_n").alias("_n")).select(
        *keys, _COARSE, F.coalesce(F.sum("_n").over(coarse_order), F.lit(0)).alias("_before")
    )
    fine_order = Window.partitionBy(*keys, _COARSE).orderBy(_FINE).rowsBetween(Window.unboundedPreceding, -1)
    step = F.floor(
        (F.col("_before") + F.coalesce(F.sum("_n").over(fine_order), F.lit(0))) / F.lit(limit)
    )
    starts = (
        hist.join(before, [*keys, _COARSE])
        .select(*keys, _COARSE, _FINE, step.alias("_step"))
        .groupBy(*keys, _COARSE, "_step")
        .agg(F.min(_FINE).alias("_start"))
    )
    numbered = starts.select(
        *keys,
        _COARSE,
        "_start",
        (F.dense_rank().over(Window.partitionBy(*keys).orderBy("_step")) - 1).alias("_no"),
    )
    return (
        numbered.groupBy(*keys, _COARSE)
        .agg(F.min("_no").alias("_base"), F.sort_array(F.collect_list("_start")).alias("_starts"),
             F.max("_no").alias("_top"))
        .withColumn(LAST, F.max("_top").over(Window.partitionBy(*keys)))
        .drop("_top")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    axis: Axis,
    values: dict[str, Column],
    limit: int | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums of ``values`` along the order inside each group."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    inputs = {f"_v{i}": value for i, value in enumerate(values.values())}
    sliced = with_slices(df.withColumns(inputs), keys, axis, limit, bound)
    sums = {c: F.sum(c).over(sliced.window.rowsBetween(Window.unboundedPreceding, 0)) for c in inputs}
    if sliced.cut:
        totals = sliced.border_rows.groupBy(*sliced.slots).agg(*[F.sum(c).alias(c) for c in inputs])
        sliced = sliced.attach(sliced.before(totals, {f"_c{c}": c for c in inputs}))
        sums = {c: total + F.coalesce(F.col(f"_c{c}"), F.lit(0)) for c, total in sums.items()}
    return sliced.df.select(*columns, *[sums[c].alias(name) for name, c in zip(values, inputs)])


def row_index(
    df: DataFrame, keys: Sequence[str], axis: Axis, name: str, limit: int | None = None, bound: DataFrame | None = None
) -> DataFrame:
    """Number the rows of each group 0, 1, ... along the order."""
    counted = running(df, keys, axis, {name: F.lit(1).cast("long")}, limit, bound)
    return counted.withColumn(name, F.col(name) - 1)


def global_index(
    df: DataFrame, axis: Axis, name: str, limit: int | None = None, bound: DataFrame | None = None
) -> DataFrame:
    """Number all rows 0, 1, ... along the order without one task seeing them all."""
    whole = F.lit(0).alias("_all")
    bound = None if bound is None else bound.select("*", whole)
    return row_index(df.select("*", whole), ["_all"], axis, name, limit, bound).drop("_all")


def ordered_parts(df: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """Rows with ``_part`` and ``_at``: ranges of the order of ``by`` with at most ``limit`` rows, and the place in them.

    The ranges follow samples of whole keys, so keys may agree in any number of first bytes. Their sizes are counted, and as
    long as one is above the limit twice as many are cut. ``by`` is unique together, so this ends.
    """
    source = stage(df, "to-order")
    parts = max(1, -(-2 * source.count() // limit))
    while True:
        # a source of several partitions is sampled in each; the range exchange keeps this number of partitions
        placed = source.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
        placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
        placed = stage(placed, "ordered-parts")
        if placed.groupBy("_part").count().where(F.col("count") > limit).isEmpty():
            return placed
        parts *= 2


def text_index(
    df: DataFrame, by: Sequence[str], name: str, limit: int | None = None, bound: DataFrame | None = None
) -> DataFrame:
    """Number all rows 0, 1, ... in the order of string columns that are unique together.

    No task sees more than ``limit`` rows. ``bound`` is a stored table with at least as many rows, counted in place of ``df``.
    """
    limit = ROWS_PER_SLICE if limit is None else limit
    if (df if bound is None else bound).count() <= limit:
        whole = df.withColumn("_all", F.lit(0))
        return whole.withColumn(name, F.row_number().over(Window.partitionBy("_all").orderBy(*by)).cast("long") - 1).drop("_all")
    placed = ordered_parts(df, by, limit)
    # one row per part, i.e. rows / limit
    sizes = placed.groupBy(F.lit(0).alias("_all"), "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_all").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at"))
    return numbered.drop("_part", "_at", "_before")


def with_next(sliced: Sliced, value: Column, name: str, among: Column | None = None) -> Sliced:
    """``value`` of the following row of the group (of the following row where ``among`` holds)."""
    flag, payload, head = f"_f_{name}", f"_p_{name}", f"_h_{name}"
    source = sliced.of(sliced.df.withColumns({flag: F.lit(True) if among is None else among, payload: value}))
    part = sliced.slots if among is None else [*sliced.slots, flag]
    following = F.lead(payload).over(Window.partitionBy(*part).orderBy(*sliced.axis.by))
    if sliced.cut:
        heads = source.border_rows.groupBy(*sliced.slots).agg(
            F.min_by(F.when(F.col(flag), F.col(payload)), F.when(F.col(flag), sliced.axis.key)).alias(head))
        later = Window.partitionBy(*sliced.keys).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        source = source.attach(
            heads.select(*sliced.slots, F.last(head, ignorenulls=True).over(later).alias(head)))
        following = F.coalesce(following, F.col(head))
    return source.of(source.df.withColumn(name, following).drop(flag, payload, head))


def frames(
    df: DataFrame, keys: Sequence[str], axis: Axis, before: int = 0, after: int = 0, limit: int | None = None
) -> Sliced:
    """Slices with the neighbouring rows that a frame of ``before``/``after`` rows reaches into.

    Borrowed rows carry ``_halo``; windows over a slice then see every row a frame needs.
    ``_offset`` is the number of own rows in earlier slices.
    """
    sliced = with_slices(df, keys, axis, limit)
    if not sliced.cut:
        return sliced.of(sliced.df.withColumns({HALO: F.lit(False), OFFSET: F.lit(0).cast("long")}))
    keys, edge_rows = sliced.keys, sliced.border_rows
    columns = [F.col(f"`{c}`") for c in sliced.df.columns]
    whole = sliced.df.withColumn(HALO, F.lit(False))
    for reach, ahead in ((after, True), (before, False)):
        if reach == 0:
            continue
        direction = [F.asc(c) if ahead else F.desc(c) for c in axis.by]
        edge = edge_rows.withColumn(
            "_rank", F.row_number().over(Window.partitionBy(*sliced.slots).orderBy(*direction))
        ).where(F.col("_rank") <= reach)
        first, last = (F.col(SLICE) - reach, F.col(SLICE) - 1) if ahead else (F.col(SLICE) + 1, F.col(SLICE) + reach)
        span = F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.col(LAST)))
        valid = (F.col(SLICE) > 0) if ahead else (F.col(SLICE) < F.col(LAST))
        lent = edge.where(valid).withColumn("_to", F.explode(span)).drop("_rank")
        lent = lent.withColumn(
            "_rank", F.row_number().over(Window.partitionBy(*keys, "_to").orderBy(*direction))
        ).where(F.col("_rank") <= reach)
        whole = whole.unionByName(lent.withColumn(SLICE, F.col("_to")).select(*columns, F.lit(True).alias(HALO)))
    sizes = edge_rows.groupBy(*sliced.slots).agg(F.count(F.lit(1)).alias("_n"))
    placed = sliced.of(whole).attach(sliced.before(sizes, {OFFSET: "_n"}))
    offset = F.coalesce(F.col(OFFSET), F.lit(0)).cast("long")
    return placed.of(placed.df.withColumn(OFFSET, offset).repartition(*placed.slots))


def cut_points(
    df: DataFrame, groups: Sequence[str], axis: Axis, targets: dict[str, Column]
) -> DataFrame:
    """Per group, the sort key of its ``target``-th row for each named target.

    ``targets`` are expressions over ``_n``, the group size. A row belongs to the first ``target``
    rows exactly when its key is not above the returned one (null for a target below 1). Only
    counts per bucket are shuffled; the single bucket holding a cut is the only one sorted. The
    result has one row per group and is stored, so every use sees the same cut.
    """
    names = list(groups) or ["_all"]
    base = df if groups else df.withColumn("_all", F.lit(0))
    base = base.select(*names, axis.coarse.alias(_COARSE), axis.fine.alias(_FINE), axis.key.alias("_key"))

    def crossing(counts: DataFrame, bucket: str) -> DataFrame:
        """The bucket in which the running count reaches what is needed, and how much is left in it."""
        upto = Window.partitionBy(*names, "_target").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        reached = counts.withColumn("_upto", F.sum("_c").over(upto))
        before = F.col("_upto") - F.col("_c")
        hit = reached.where((before < F.col("_need")) & (F.col("_need") <= F.col("_upto")))
        return hit.select(*names, "_target", bucket, (F.col("_need") - before).alias("_need"))

    per_group = Window.partitionBy(*names)
    coarse = base.groupBy(*names, _COARSE).agg(F.count(F.lit(1)).alias("_c")).withColumn("_n", F.sum("_c").over(per_group))
    wanted = F.array(*[
        F.struct(F.lit(t).alias("_target"), F.coalesce(n, F.lit(0)).cast("long").alias("_need")) for t, n in targets.items()])
    hit = crossing(coarse.select(*names, _COARSE, "_c", F.inline(wanted)), _COARSE)
    # one row per group and target
    fine = (
        base.join(F.broadcast(hit), [*names, _COARSE])
        .groupBy(*names, "_target", _COARSE, "_need", _FINE)
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    hit = crossing(fine, _FINE)
    edge = base.join(F.broadcast(hit), [*names, _FINE]).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*names, "_target", _FINE).orderBy("_key"))
    )
    found = edge.where(F.col("_rank") == F.col("_need")).groupBy(*names).agg(
        *[F.max(F.when(F.col("_target") == name, F.col("_key"))).alias(name) for name in targets]
    )
    return stage(found if groups else found.drop("_all"), "cut-points")


def among_first(df: DataFrame, axis: Axis, targets: dict[str, Column]) -> dict[str, Column]:
    """For each target count, the test whether a row is among the first that many of the table.

    The cut is a single sort key and enters the plan as a literal.
    """
    row = cut_points(df, [], axis, targets).first()
    tests = {}
    for name in targets:
        key = None if row is None else row[name]
        limit = None if key is None else F.struct(*[
            F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(axis.by, key)])
        tests[name] = F.lit(False) if limit is None else axis.key <= limit
    return tests

"""The user table: employment span, supervisor, computers, insider intervals and static codes.

One row per user; nothing here gathers more per user than its own computers of two weeks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions import calendar
from sessionlens.operators import ordering

# Fixed values.
ADMIN_ROLE = "ITAdmin"
DATASET = "4.2"
STATIC_COLUMNS = ["role", "b_unit", "f_unit", "dept", "team"]
TRAITS = ["O", "C", "E", "A", "N"]
PROFILE = ["uname", "email", "role", "b_unit", "f_unit", "dept", "team", "sup_name"]


#: Months in one whole number.
_BITS = 62


def _calendar(snapshots: DataFrame) -> DataFrame:
    """The months with their place and the following one; one row per monthly file."""
    order = Window.orderBy("month")
    return snapshots.where(F.col("month").isNotNull()).select("month").distinct().select(
        "month", F.row_number().over(order).alias("_no"), F.lead("month").over(order).alias("_next"))


def employment_span(snapshots: DataFrame) -> DataFrame:
    """Per user the first month seen and the first later month the user is missing (else null).

    Months are bits of whole numbers, so rows are combined before they move and none is sorted.
    """
    calendar = F.broadcast(_calendar(snapshots))
    placed = snapshots.select("user", "month").join(calendar, "month")
    bit = F.expr(f"shiftleft(1L, _no % {_BITS})")
    seen = placed.groupBy("user", F.expr(f"_no div {_BITS}").alias("_part")).agg(
        F.bit_or(bit).alias("_seen"), F.min("_no").alias("_first"))
    # a month ends a run if the following one, which may be the first of the next part, is not seen
    parts = Window.partitionBy("user").orderBy("_part")
    joined = F.coalesce((F.lead("_part").over(parts) == F.col("_part") + 1).cast("long") * F.lead("_seen").over(parts).bitwiseAND(F.lit(1)), F.lit(0))
    ends = seen.withColumn("_follows", joined).withColumn(
        "_ends", F.expr(f"_seen & ~(shiftright(_seen, 1) | shiftleft(_follows, {_BITS - 1}))"))
    last = F.when(F.col("_ends") != 0, F.col("_part") * _BITS + F.expr("bit_count((_ends & -_ends) - 1)"))
    spans = ends.groupBy("user").agg(F.min("_first").alias("_first"), F.min(last).alias("_last"))
    first, end = (calendar.select(F.col("_no").alias(no), F.col(c).alias(name))
                  for no, c, name in (("_first", "month", "wstart"), ("_last", "_next", "wend")))
    return spans.join(F.broadcast(first), "_first").join(F.broadcast(end), "_last").select("user", "wstart", "wend")


def first_profile(snapshots: DataFrame) -> DataFrame:
    """Profile columns from the first month a user appears in. Only the rows of that month are compared as a whole."""
    profile = F.min_by(F.struct(*PROFILE), F.struct("month", *PROFILE)).alias("_p")
    placed = snapshots.join(F.broadcast(_calendar(snapshots).drop("_next")), "month", "left").withColumn("_no", F.coalesce("_no", F.lit(0)))
    first = F.col("_no") == F.min("_no").over(Window.partitionBy("user"))
    return placed.withColumn("_is_first", first).where("_is_first").groupBy("user").agg(profile).select("user", "_p.*")


def directory(snapshots: DataFrame, traits: DataFrame | None = None) -> DataFrame:
    """First profile, employment span and, where scores exist, the five personality traits."""
    people = first_profile(snapshots).join(employment_span(snapshots), "user")
    if traits is None:
        return people
    return people.join(traits.select("user", *TRAITS), "user", "left")


def resolve_supervisor(people: DataFrame) -> DataFrame:
    """Supervisor name → id of the first user of that name; null where nobody has it."""
    by_name = people.groupBy(F.col("uname").alias("sup_name")).agg(F.min("user").alias("sup"))
    return people.join(by_name, "sup_name", "left")


def user_pcs(activity_weeks: DataFrame) -> DataFrame:
    """Computers a user worked on in week 0 and also in week 1."""
    in_both = (
        activity_weeks.where(F.col("week").isin(0, 1))
        .groupBy("user", "pc")
        .agg(F.max((F.col("week") == 0).cast("int")).alias("_a"), F.max((F.col("week") == 1).cast("int")).alias("_b"))
        .where((F.col("_a") == 1) & (F.col("_b") == 1))
    )
    return in_both.groupBy("user").agg(F.sort_array(F.collect_list("pc")).alias("pcs"))


def primary_pc(pcs: DataFrame) -> DataFrame:
    """The only computer of a user, or among several the one with the fewest multi-computer
    users (first by name on a tie). Users without one keep null."""
    several = pcs.where(F.size("pcs") > 1).select("user", F.explode("pcs").alias("_pc"))
    sharing = several.groupBy("_pc").agg(F.count(F.lit(1)).alias("_n"))
    least = several.join(sharing, "_pc").groupBy("user").agg(F.min(F.struct("_n", "_pc")).alias("_least"))
    chosen = F.when(F.size("pcs") == 1, F.col("pcs")[0]).otherwise(F.col("_least._pc"))
    return pcs.join(least, "user", "left").select("user", "pcs", chosen.alias("pc"))


def shared_pcs(chosen: DataFrame, roles: DataFrame) -> DataFrame:
    """The computers left after the primary one; none for administrators and single-computer users."""
    rest = F.array_except("pcs", F.array("pc"))
    keep = (F.size("pcs") > 1) & ~F.col("role").eqNullSafe(ADMIN_ROLE)
    return chosen.join(roles.select("user", "role"), "user", "left").select(
        "user", "pc", F.when(keep, rest).alias("sharedpc")
    )


def insider_index(answers: DataFrame, dataset: str = DATASET) -> DataFrame:
    """Scenario and active interval per insider of one data set; the last start wins."""
    start, end = (calendar.parse_log_time(F.col(c)) for c in ("start", "end"))
    rows = answers.where(F.col("dataset").cast("string") == dataset).select(
        "user", F.struct(start.alias("mstart"), end.alias("mend"),
                         F.col("scenario").cast("int").alias("malscene"), "details").alias("_m"))
    return rows.groupBy("user").agg(F.max("_m").alias("_m")).select("user", "_m.*")


def malicious_pairs(insiders: DataFrame, details: DataFrame) -> DataFrame:
    """(user, action id) pairs named in each insider's own detail file."""
    own = insiders.select("user", F.col("malscene").cast("string").alias("scenario"), "details")
    return details.join(own, ["user", "scenario", "details"]).select("user", "id").distinct()


def with_insider_interval(people: DataFrame, insiders: DataFrame) -> DataFrame:
    joined = people.join(insiders.drop("details"), "user", "left")
    return joined.withColumn("malscene", F.coalesce("malscene", F.lit(0)))


def ordinal_codes(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct values of a string column with their position in sorted order (null has none)."""
    values = df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("value")).distinct()
    return ordering.text_index(values, ["value"], "code", limit, bound=df)


def ordinal_encode(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Replace string columns by their codes; null becomes -1."""
    out = df
    for c in columns:
        codes = ordinal_codes(df, c, limit).select(F.col("value").alias(c), F.col("code").alias("_code"))
        out = out.join(codes, c, "left").withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_code")
    return out


def user_index(people: DataFrame, limit: int | None = None) -> DataFrame:
    """user → dense integer in user order."""
    return ordering.text_index(people.select("user"), ["user"], "user_int", limit, bound=people)


def user_static(people: DataFrame) -> DataFrame:
    """Static user columns as numbers: five codes, the administrator flag and the traits."""
    flag = F.col("role").eqNullSafe(ADMIN_ROLE).cast("int").alias("ITAdmin")
    base = people.select("user", *[F.coalesce(c, F.lit("nan")).alias(c) for c in STATIC_COLUMNS], flag, *TRAITS)
    return ordinal_encode(base, STATIC_COLUMNS)


def user_table(people: DataFrame, activity_weeks: DataFrame, answers: DataFrame) -> DataFrame:
    """Everything a row of activity needs to know about its user, one row per user.

    ``people`` is the directory with resolved supervisors; stage it first, it is read several times.
    """
    machines = shared_pcs(primary_pc(user_pcs(activity_weeks)), people)
    base = people.join(machines, "user", "left")
    own = machines.select(F.col("user").alias("sup"), F.col("pc").alias("sup_pc"))
    static = user_static(people).select(
        "user", *[F.col(c).alias(f"{c}_code") for c in STATIC_COLUMNS], "ITAdmin"
    )
    return (
        with_insider_interval(base.join(own, "sup", "left"), insider_index(answers))
        .join(user_index(people), "user")
        .join(static, "user")
    )

"""Sharding by a Feistel permutation of global row numbers (operator 7).

Rows are numbered 0..n-1 in the order of (id, text hash, size). A Feistel network over Z_a x Z_b with
a * b just above n permutes these numbers; a number that lands at n or above walks on along its cycle until it
is below n. The permuted number p gives shard ``p % shards`` and slot ``p // shards``, so counts differ by one at
most, slots have no gaps, and any row's place can be computed from its number and the seed alone.

Only narrow rows (id, size, crc32) are moved; texts never leave their scan.

Cases: a null text has size 1 and crc32 0; null ids come first; rows that agree in id, size and crc32 are
interchangeable and get different slots; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import partitions
from sessionlens.session import stage

ROUNDS = 6


def sides(rows: int) -> tuple[int, int]:
    """a and b with a * b >= rows and a * b - rows < a, both near the square root."""
    a = max(1, int(rows**0.5))
    return a, max(1, -(-rows // a))


def feistel(number: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over 0..a*b-1."""
    start = F.struct(F.call_function("div", number, F.lit(b)).alias("l"), (number % b).alias("r"))

    def turn(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        even = F.struct(((left + F.pmod(F.xxhash64(right, i, F.lit(seed)), F.lit(a))) % a).alias("l"), right.alias("r"))
        odd = F.struct(left.alias("l"), ((right + F.pmod(F.xxhash64(left, i, F.lit(seed)), F.lit(b))) % b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def permuted(df: DataFrame, number: str, rows: int, seed: int, name: str = "permuted") -> DataFrame:
    """Adds the permuted number of each row number below ``rows``.

    The longest walk outside 0..rows-1 is measured first, on the at most a points outside, so that no walk is cut.
    """
    if not rows:  # no number is below 0, so a walk would never end
        return df.withColumn(name, F.col(number))
    spark = df.sparkSession
    a, b = sides(rows)
    walks, outside = 0, spark.range(rows, a * b, 1, partitions(spark)).toDF("x")
    while outside.head(1):
        walks += 1
        outside = stage(outside.select(feistel(F.col("x"), a, b, seed).alias("x")).where(F.col("x") >= rows), "walk")
    once = feistel(F.col(number), a, b, seed)
    again = F.aggregate(
        F.array_repeat(F.lit(0), walks), once, lambda x, _: F.when(x < rows, x).otherwise(feistel(x, a, b, seed))
    )
    return df.withColumn(name, again if walks else once)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Rows with their global number in ``order``, and how many there are.

    A range exchange on the order (ties dealt out by a seeded draw) sorts the rows; numbers inside partitions come
    from the row position, and one count per partition gives the offsets.
    """
    spark = df.sparkSession
    parts = partitions(spark)
    placed = (
        df.withColumn("_draw", F.rand(17))
        .repartitionByRange(parts, *(F.col(c).asc_nulls_first() for c in order), "_draw")
        .sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order), "_draw")
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_draw")
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = stage(placed, "numbered")
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total, offsets = 0, []
    for part, n in counts:  # one row per partition
        offsets.append((part, total))
        total += n
    offset = spark.createDataFrame(offsets, "_part long, _offset long")
    return (
        placed.join(F.broadcast(offset), "_part").withColumn(name, F.col("_offset") + F.col("_at")).drop("_part", "_offset", "_at"),
        total,
    )


def shard(df: DataFrame, shards: int = 8, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row."""
    narrow = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )
    rows, total = numbered(narrow, ["doc_id", "text_crc32", "size"])
    placed = permuted(rows, "row_number", total, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number",
        (F.col("permuted") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("permuted"), F.lit(shards)).cast("long").alias("slot"),
    )

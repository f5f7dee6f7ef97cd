"""Joins of many rows with one row per key, where one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.operators import ordering
from sessionlens.session import stage

#: Rows of the key table that are broadcast without a look at the keys.
SMALL = 20_000
SALT = "_salt"


def broadcasts(df: DataFrame) -> bool:
    """Whether the session allows broadcasts at all."""
    return not str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m")).startswith("-")


def join_by_key(rows: DataFrame, table: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Left join of ``rows`` with ``table``, which is stored and holds each key once.

    A table of at most ``SMALL`` rows is broadcast. Beyond that rows per key are counted, and the rows of a key above
    ``limit`` are dealt over salts of about half that many rows; its table row is copied once per salt. Whoever aggregates the
    result by other keys does so partially in these tasks, before anything moves, so the rows of the key never meet in one task.
    Null keys match nothing and are salted like any key.
    """
    limit = ordering.ROWS_PER_SLICE if limit is None else limit
    if broadcasts(rows) and table.count() <= SMALL:
        return rows.join(F.broadcast(table), key, "left")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = stage(counts.select(F.col(key).alias("_key"), F.ceil(2 * F.col("_n") / limit).cast("int").alias("_salts")), "hot-keys")
    if hot.isEmpty():
        n = rows.count()
        return ordering.dealt(rows, [key], n).join(ordering.dealt(table, [key], n), key, "left")
    # rows / limit keys at most
    same = F.col(key).eqNullSafe(F.col("_key"))
    draw = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn(SALT, draw).drop("_key", "_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    spread = table.join(F.broadcast(hot), same, "left").withColumn(SALT, copies).drop("_key", "_salts")
    return dealt.join(spread, [key, SALT], "left").drop(SALT)


#: Bits of a sieve for each key, and at most (32 MB). Beyond that more rows pass, and the join that follows sorts them out.
SIEVE_BITS, MOST_SIEVE_BITS = 16, 1 << 28
#: Bits of one bitmap.
BITMAP = 1 << 15


def sifted(df: DataFrame, key: Column, wanted: DataFrame, name: str = "_maybe", most: int = MOST_SIEVE_BITS) -> DataFrame:
    """``df`` with the boolean ``name``: true wherever ``key``, a 64-bit hash, is in the one column of ``wanted`` (a
    written table of such hashes), and by chance for about one other row in sixteen.

    The bits that the wanted keys set are broadcast, at most 32 MB whatever the number of keys, so rows that can't
    have a partner stay out of the shuffle of a join that is too large to be broadcast itself.
    """
    bits = min(most, max(BITMAP, 1 << (SIEVE_BITS * wanted.count()).bit_length()))
    slots = wanted.select(F.pmod(F.col(wanted.columns[0]), F.lit(bits)).alias("slot"))
    slots = slots.select(F.floor(F.col("slot") / BITMAP).alias("_sieve"), (F.col("slot") % BITMAP).alias("slot"))
    maps = stage(slots.repartition("_sieve").groupBy("_sieve").agg(F.bitmap_construct_agg("slot").alias("_sieve_bits")), "sieve")
    slot = F.pmod(key, F.lit(bits))
    rows = df.withColumn("_sieve_slot", slot).withColumn("_sieve", F.floor(F.col("_sieve_slot") / BITMAP))
    byte = F.conv(F.hex(F.substring("_sieve_bits", (F.floor(F.col("_sieve_slot") % BITMAP / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (F.col("_sieve_slot") % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(maps), "_sieve", "left").withColumn(name, found).select(*df.columns, name)

"""Mixing sources to target weights by pivotal dependent rounding (operator 13).

Sources share a multiple of all sizes by weight; a target stops at ``MOST`` times its source's size and the excess is shared
again by weight until no target is above. The targets are min(MOST * size, level * weight) for one level, which rises from round to
round and is found by aggregates over the sources; nothing but sums comes to the driver.

A document of a source with rate r = target / size is copied floor(r) times and once more with probability r - floor(r).
These probabilities are rounded in pairs: one duel moves mass (probability times size) from one document to the other,
in a direction drawn so that both probabilities hold on average, until one of them is 0 or 1; the other goes on. Mass is kept in every
duel, so of the whole source only the last document's rounding is off.

* Leaves: the documents of a source are dealt over leaves of about ``LEAF`` rows by hash and duel in the order of falling
  size, so what is left of a leaf is a short document. A task holds one document, however large its leaf.
* Tree: what is left of ``FAN`` leaves duels on, level by level, until one document per source is left, which goes to the nearer
  of 0 and 1. A hot source has more leaves, no larger ones.

Draws are hashes of the seed and of the two documents, so reruns agree and a lost task gives the same rows again.

Cases: a null text has size 0; a null source is one source, the last in order; documents of size 0 are never taken and never duel; a
source of size 0 has target 0; null ids take part; rows that agree in id, source, size and text are interchangeable; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.common import add_columns, field, partitions
from sessionlens.llm.sharding import numbered
from sessionlens.session import stage

#: Weights of the sources in their order, repeating; what they share, as a multiple of all sizes; most copies.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents of a leaf, and nodes that a node of the tree joins.
LEAF, FAN = 512, 64
SEED = 42


def word_sizes(df: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """Adds the number of words of each text; white space is space and tab to carriage return."""

    def make():
        space = np.zeros(256, dtype=bool)
        space[[32, *range(9, 14)]] = True

        def compute(texts):
            texts = texts.fill_null("")
            if not len(texts):
                return [pa.array([], pa.int64())]
            _, offsets, data = texts.buffers()
            at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
            at = at - at[0]
            inside = ~space[raw]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            edges = at[:-1][at[:-1] < at[1:]]
            begins[edges] = inside[edges]
            before = np.concatenate([[0], np.cumsum(begins)])
            return [pa.array(before[at[1:]] - before[at[:-1]])]

        return compute

    return add_columns(df, [field(name, T.LongType())], make, text)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of every source of a (source, source_size) table."""
    ordered, _ = numbered(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("_rank") % len(weights)) + 1).cast("int"))
    weighed = stage(ordered.select("source", "source_size", weight.alias("weight")), "weights")
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    cap = most * F.col("source_size").cast("double")
    level, above = 0.0, -1
    while True:  # sums over the sources that are above the level and below it
        full = cap <= F.lit(level) * F.col("weight")
        row = weighed.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if row[2] == above or not row[1]:
            break
        level, above = (total - (row[0] or 0.0)) / row[1], row[2]
    return weighed.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def draw(seed: int, *keys: int) -> float:
    """A number from 0 to below 1 for some 64-bit keys."""
    return xxhash.xxh64_intdigest(np.array(keys, dtype=np.int64).tobytes(), seed) / 2.0**64


def duel(p: float, x: int, q: float, y: int, u: float) -> tuple[float, float]:
    """New probabilities of two documents of sizes x and y: mass is kept, one of the two becomes 0 or 1, ``u`` decides which way."""
    up, down = min((1 - p) * x, q * y), min(p * x, (1 - q) * y)  # mass that may go to the first, and to the second
    if u * (up + down) < down:
        return (1.0, q - up / y) if (1 - p) * x <= q * y else (p + up / x, 0.0)
    return (0.0, q + down / y) if p * x <= (1 - q) * y else (p - down / x, 1.0)


ROWS = ("doc_id", "size", "source_size", "target", "copies", "chance", "rank", "node", "key")
#: Chances nearer than this to 0 or 1 are integral.
TINY = 1e-12


def settle(df: DataFrame, seed: int) -> DataFrame:
    """The rows of ``df`` with duels fought inside each node: ``open`` marks the one of a node that is still fractional."""
    dealt = df.repartition(partitions(df.sparkSession), "rank", "node").sortWithinPartitions("rank", "node", F.col("size").desc(), "key", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        held: list | None = None  # the fractional row of the node at hand
        for batch in batches:
            kind = batch.schema
            out = []
            at = {n: i for i, n in enumerate(kind.names)}
            i_size, i_copies, i_chance, i_rank, i_node, i_key = (at[n] for n in ("size", "copies", "chance", "rank", "node", "key"))
            for row in map(list, zip(*(c.to_pylist() for c in batch.columns))):
                if held is not None and (held[i_rank], held[i_node]) != (row[i_rank], row[i_node]):
                    out.append([*held, True])
                    held = None
                if not TINY < row[i_chance] < 1 - TINY:
                    row[i_copies] += round(row[i_chance])
                    row[i_chance] = 0.0
                    out.append([*row, False])
                elif held is None:
                    held = row
                else:
                    u = draw(seed, held[i_key], row[i_key])
                    pair = duel(held[i_chance], held[i_size], row[i_chance], row[i_size], u)
                    left = None
                    for own, chance in zip((held, row), pair):
                        if TINY < chance < 1 - TINY:
                            own[i_chance] = chance
                            left = own
                        else:
                            own[i_copies] += round(chance)
                            own[i_chance] = 0.0
                            out.append([*own, False])
                    held = left
            if out:
                yield rows(out, kind)
        if held is not None:
            yield rows([[*held, True]], kind)

    def rows(out, kind):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), [*kind, pa.field("open", pa.bool_())])]
        return pa.RecordBatch.from_arrays(columns, names=[*kind.names, "open"])

    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, field("open", T.BooleanType())]))


def mixed(
    df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, copies (how often the mix has the document) and taken (copies times size) of every row."""
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized = word_sizes(narrow.withColumn("key", F.xxhash64("doc_id", "text")))
    docs = stage(sized.select("doc_id", "source", "size", "key"), "sizes")
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("_docs"))
    per_source = stage(per_source, "source-sizes")
    aims = targets(per_source.select("source", "source_size"), weights, share, most)
    counts = per_source.select(F.col("source").alias("_source"), "_docs", F.xxhash64("source").alias("rank"))
    rates = stage(aims.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("source"), "targets")
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    leaf: Column = F.pmod(F.xxhash64("key", F.lit(seed)), F.call_function("div", F.col("_docs"), F.lit(LEAF)) + 1)
    open_rows = joined.withColumn("rate", rate).select(
        "doc_id", "size", "source_size", "target", F.floor("rate").cast("long").alias("copies"),
        (F.col("rate") - F.floor("rate")).alias("chance"), "rank", leaf.alias("node"), "key",
    )
    settled = None
    while True:
        done = stage(settle(open_rows, seed), "duels")
        closed = done.where("not open").drop("open")
        settled = closed if settled is None else settled.unionByName(closed)
        open_rows = done.where("open").drop("open")
        if open_rows.groupBy("rank").count().where("count > 1").isEmpty():
            break
        open_rows = open_rows.withColumn("node", F.call_function("div", F.col("node"), F.lit(FAN)).cast("long"))
    settled = settled.unionByName(open_rows.withColumn("copies", F.col("copies") + F.round("chance").cast("long")))
    return settled.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

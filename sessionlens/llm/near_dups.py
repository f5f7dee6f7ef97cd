"""SimHash near-duplicates by deletion-variant signatures (operator 6).

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Fingerprints that differ in at
most ``k`` bits are found by equality alone: the 64 bits are cut into ``k // 2 + 1`` segments, so of two such
fingerprints one segment differs in at most one bit; every segment is indexed as it is and once per bit with that
bit struck out, and equal keys bring the candidates together, which are then verified.

* Only distinct fingerprints are indexed, so copies meet in one row, however many there are.
* A bucket answers with one link per member to the first of its group, never with its pairs.
* Buckets above ``BUCKET`` members aren't compared: their members are indexed again under a different cut of the
  bits within the bucket, until every bucket is small (above ``HELD`` they aren't even held). Nothing is capped.
* Links become components by star contraction; every round is a written table.

Cases: a text without words has fingerprint zero and is linked like any other; null ids take part, but an id is
never null in a component that has another; repeated rows share their component; an empty table gives an empty
result; other columns are kept by :func:`simhash` and not read elsewhere.
"""

from __future__ import annotations

import random
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.common import add_columns, field, mix, partitions, sifted
from sessionlens.session import stage

SEED = 42
#: Words of a shingle of a fingerprint.
WORDS = 3
#: Members of a bucket that are compared with each other in one step.
BUCKET = 1024
#: Members of a bucket that a task holds to see whether they must be compared at all.
HELD = 1 << 20
#: Hash values whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of every shingle of ``words`` words, repeats included; of the whole text if it is shorter."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, SEED)]
    ends = list(accumulate((len(w) + 1 for w in found)))
    starts = [0, *ends[:-words]]
    return [digest(joined[i : j - 1], SEED) for i, j in zip(starts, ends[words - 1 :])]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bitwise majority of each run of ``counts[i]`` values; zero for an empty run."""
    ends = np.cumsum(counts)
    ones = np.zeros((len(counts), 64), dtype=np.int64)
    for start in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[start : start + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        stop = start + len(bits)
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, stop, side="left"))
        runs = np.arange(first, last + 1)
        runs = runs[counts[runs] > 0]
        cuts = np.maximum(ends[runs] - counts[runs] - start, 0)
        ones[runs] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints_of(texts: list[str | None], words: int) -> pa.Array:
    found = [shingle_hashes(t, words) for t in texts]
    counts = np.array([len(x) for x in found], dtype=np.int64)
    every = np.array([h for x in found for h in x], dtype=np.uint64)
    return pa.array(majorities(every, counts).view(np.int64), pa.int64())


def simhash(df: DataFrame, words: int = WORDS, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the 64-bit fingerprint as a long."""

    def make():
        return lambda texts: [fingerprints_of(texts.to_pylist(), words)]

    return add_columns(df, [field(name, T.LongType())], make, text)


def cut_masks(bits: int, level: int) -> list[tuple[int, int]]:
    """(mask, struck bit or -1) of every key: each segment whole, and with each of its bits struck out.

    Level 0 cuts the 64 bits in their order; deeper levels cut a shuffled order.
    """
    order = list(range(64))
    if level:
        random.Random(level).shuffle(order)
    parts = bits // 2 + 1
    out = []
    for s in range(parts):
        own = order[64 * s // parts : 64 * (s + 1) // parts]
        whole = sum(1 << b for b in own)
        out.append((whole, -1))
        out.extend((whole ^ (1 << b), b) for b in own)
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def bucket_links(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(first, other) for every member that a chain of links inside the bucket joins to an earlier one."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    out, left = [], np.ones(len(fps), dtype=bool)
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & left)
            left[front] = False
            out.extend((root, int(i)) for i in front)
    return out


def link_level(members: DataFrame, bits: int, level: int) -> DataFrame:
    """From (bucket, fp) rows: links (kind 0: a, b) and members of large buckets (kind 1: bucket, fp)."""
    masks = cut_masks(bits, level)
    struck = np.array([b for _, b in masks], dtype=np.int64)
    literal = "array(" + ",".join(f"{signed(m)}L" for m, _ in masks) + ")"
    low = (1 << max(8, len(masks).bit_length())) - 1
    keyed = members.select(
        "fp", F.explode(F.expr(f"transform({literal}, (m, i) -> (xxhash64(bucket, i, fp & m) & ~{low}L) | i)")).alias("key")
    )
    dealt = keyed.repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key", "fp")

    def run(batches):
        held_key, held_fp = np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
        large: int | None = None  # key of a bucket whose members pass through
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(batch.schema.get_field_index("key")).to_numpy()
            fp = batch.column(batch.schema.get_field_index("fp")).to_numpy().view(np.uint64)
            if large is not None:
                n = int(np.searchsorted(key, large, side="right"))
                yield rows(1, key[:n], fp[:n])
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                large = None
            key, fp = np.concatenate([held_key, key]), np.concatenate([held_fp, fp])
            tail = int(np.searchsorted(key, key[-1], side="left"))
            yield from finished(key[:tail], fp[:tail])
            held_key, held_fp = key[tail:], fp[tail:]
            if len(held_key) > HELD:
                yield rows(1, held_key, held_fp)
                large, held_key, held_fp = int(held_key[0]), held_key[:0], held_fp[:0]
        yield from finished(held_key, held_fp)

    def rows(kind, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"]
        )

    def finished(key, fp):
        if len(key) < 2:
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        bit = struck[(key[starts] & low)]
        value = (fp >> np.maximum(bit, 0)[np.repeat(np.arange(len(starts)), sizes)].astype(np.uint64)) & np.uint64(1)
        ones = np.add.reduceat(value.astype(np.int64), starts)
        # with a bit struck out, only members that differ in it are new: equal segments meet under the whole segment
        use = (sizes > 1) & ((bit < 0) | ((ones > 0) & (ones < sizes)))
        big = use & (sizes > BUCKET)
        for k in np.flatnonzero(big):
            yield rows(1, key[starts[k] : starts[k] + sizes[k]], fp[starts[k] : starts[k] + sizes[k]])
        pairs = starts[use & (sizes == 2)]
        pairs = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= bits] if len(pairs) else pairs
        first, other = [fp[pairs]], [fp[pairs + 1]]
        for k in np.flatnonzero(use & (sizes > 2) & ~big):
            own = fp[starts[k] : starts[k] + sizes[k]]
            found = np.array(bucket_links(own, bits), dtype=np.int64).reshape(-1, 2)
            first.append(own[found[:, 0]])
            other.append(own[found[:, 1]])
        if sum(map(len, first)):
            yield rows(0, np.concatenate(first), np.concatenate(other))

    return dealt.mapInArrow(run, "kind int, a long, b long")


def links(fingerprints: DataFrame, bits: int = 2, fp: str = "fingerprint") -> DataFrame:
    """(a, b) between fingerprints, whose components are those of all links of at most ``bits`` bits."""
    members = fingerprints.select(F.lit(0).cast("long").alias("bucket"), F.col(fp).alias("fp")).where("fp is not null").distinct()
    found, level = [], 0
    while True:
        done = stage(link_level(members, bits, level), "links")
        found.append(done.where("kind = 0").select("a", "b"))
        members = done.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("fp"))
        if members.isEmpty():
            break
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that isn't the smallest of its component, from edges (a, b).

    Large-star and small-star steps in turn, until nothing moves; each step is a written table.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(df: DataFrame, bits: int = 2, doc_id: str = "doc_id", fp: str = "fingerprint") -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest id in reach over links of at most ``bits`` bits."""
    rows = stage(df.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fingerprint")), "fingerprints")
    distinct = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct, bits))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(rooted.join(smallest, "root").select("fingerprint", "component_id"), "classes")
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


#: Words of a shingle and the least Jaccard similarity of the verified form.
SHINGLE, ALIKE = 5, 0.8
#: Bands and least-hash values per band: texts of similarity s share a band with probability 1 - (1 - s^4)^20.
BANDS, PER_BAND = 20, 4
#: Bits of 64 in which the sketches of a pair may differ: texts of similarity 0.8 differ in 6.4, with deviation 2.4.
SKETCH_APART = 20
#: Odd factors, one per least-hash value.
FACTORS = mix(np.arange(1, BANDS * PER_BAND + 1, dtype=np.uint64)) | np.uint64(1)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of ``hashes`` under each of the ``FACTORS``."""
    out = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 8192):
        np.minimum(out, np.multiply.outer(FACTORS, hashes[start : start + 8192]).min(axis=1), out=out)
    return mix(out)


def signatures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``bands`` (one key per band over the least hashes of the five-word shingles), ``sketch`` (a bit of each of
    64 least hashes), ``width``, the number of distinct shingles, and the ``fingerprint`` of :func:`simhash`; all in one pass,
    as a second one would hold twice as many Python workers."""

    def make():
        def compute(texts):
            bands, sketch, width = [], [], []
            texts = texts.to_pylist()
            for t in texts:
                own = np.unique(np.array(shingle_hashes(t, SHINGLE), dtype=np.uint64))
                least = least_hashes(own if len(own) else np.zeros(1, dtype=np.uint64))
                key = np.arange(BANDS, dtype=np.uint64)
                for k in range(PER_BAND):
                    key = mix(key + least[k::PER_BAND])
                bands.append(key.view(np.int64))
                sketch.append(int(np.packbits((least[:64] & np.uint64(1)).astype(np.uint8)).view(np.int64)[0]))
                width.append(len(own))
            return [
                pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.int64()), pa.array(width, pa.int64()), fingerprints_of(texts, WORDS)
            ]

        return compute

    fields = [field("bands", T.ArrayType(T.LongType())), field("sketch", T.LongType()), field("width", T.LongType()), field("fingerprint", T.LongType())]
    return add_columns(df, fields, make, text)


def shingle_sets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``shingles``, the distinct five-word shingles as 64-bit hashes."""

    def make():
        return lambda texts: [pa.array([np.unique(np.array(shingle_hashes(t, SHINGLE), dtype=np.uint64)).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))]

    return add_columns(df, [field("shingles", T.ArrayType(T.LongType()))], make, text)


def verified(nodes: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose whole texts have a similarity of ``ALIKE`` or more; written.

    ``firsts`` has (node, id) of the first row of every text, so of copies only one is shuffled and shingled."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stage(firsts.join(wanted, "node", "left_semi").select(F.col("node").alias("_node"), F.col("id").alias("_id")), "wanted")
    rows = sifted(nodes, F.xxhash64("node", "id"), wanted.select(F.xxhash64("_node", "_id").alias("key"))).where("_maybe")
    rows = rows.join(wanted, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    own = rows.groupBy("node").agg(F.first("text").alias("text"))
    sets = stage(shingle_sets(own).select("node", "shingles"), "shingle-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return stage(both.where(shared >= ALIKE * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "alike")


def verified_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(node, id) of every row, and (node, root) for texts (``node``: XXH64 of the text) that five-word shingles of similarity ``ALIKE`` or more
    join to another text, directly or in a chain; ``root`` is the text of the group with the smallest id.

    Copies are one node. Candidates share a class of :func:`near_duplicates`, so fingerprints, segments and links of
    operator 6 bring them together, or a band of least hashes: a pair of similarity 0.8 has more bits apart than the links
    allow, but shares a band, whatever the kind of edit, with probability 1 - (1 - 0.8^4)^20 = 0.99997. First every text is
    verified against the first one of its class and of each of its bands, which joins large groups by one pair per member and
    key. Then, in every class or band that still holds texts of several components, all pairs across components are verified,
    so no failed check leaves a partner untried; texts outside the component of the first one meet all others, and pairs
    inside a component are not made.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    nodes = df.select(F.xxhash64(whole).alias("node"), F.col(doc_id).alias("id"), whole.alias("text"))
    kept = ("bands", "sketch", "width", "fingerprint")
    signed_nodes = stage(signatures(nodes).select("node", "id", *kept), "signatures")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "node")
    texts = stage(signed_nodes.groupBy("node").agg(F.min(order).alias("at"), *(F.first(n).alias(n) for n in kept)), "texts")
    classes = near_duplicates(texts, doc_id="node").select(F.col("doc_id").alias("node"), F.xxhash64(F.lit("class"), "component_id").alias("key"))
    own = texts.select("node", "sketch", "width")
    spread = texts.select("node", "sketch", "width", F.explode("bands").alias("key")).union(own.join(classes, "node").select(*own.columns, "key"))
    heads = stage(spread.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head"), "heads")
    shared = sifted(spread, F.col("key"), heads.select("key")).where("_maybe").drop("_maybe")
    members = stage(shared.join(heads, "key"), "members")
    first = stage(members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "candidates")
    firsts = texts.select("node", "at.id")
    alike = verified(nodes, firsts, first)
    known = components(alike)
    rooted = (
        members.join(known.withColumnRenamed("root", "own"), "node", "left")
        .join(known.select(F.col("node").alias("head"), F.col("root").alias("of_head")), "head", "left")
        .select("key", "node", "sketch", "width", F.coalesce("own", "node").alias("own"), F.coalesce("of_head", "head").alias("of_head"))
    )
    rooted = stage(rooted, "rooted")
    others = rooted.where("own <> of_head").select("key", *(F.col(n).alias(f"{n}_a") for n in ("node", "sketch", "width", "own")))
    near = f"bit_count(sketch ^ sketch_a) <= {SKETCH_APART} and least(width, width_a) >= {ALIKE} * greatest(width, width_a)"
    met = rooted.join(others, "key").where(f"own <> own_a and (own = of_head or node_a < node) and {near}")
    more = met.select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")).distinct()
    more = stage(more.join(first, ["a", "b"], "left_anti"), "candidates")
    if not more.isEmpty():
        known = components(alike.union(verified(nodes, firsts, more)))
    grouped = texts.select("node", "at").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = grouped.groupBy("root").agg(F.min("at").alias("best"), F.count("*").alias("n")).where("n > 1")
    groups = stage(grouped.join(smallest, "root").select("node", F.col("best.node").alias("root")), "groups")
    return signed_nodes.select("node", "id"), groups


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with one document left of every group of copies and verified near copies: the smallest id.

    Rows that agree in id and text are one document; the first of them stays.
    """
    rows, groups = verified_groups(df, doc_id, text)
    lost = groups.where("node <> root").select("node", F.lit(True).alias("_lost"))
    per_id = rows.groupBy("node", "id").agg(F.count("*").alias("n"))
    per_text = per_id.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "n")).alias("best"), F.sum("n").alias("all"))
    many = per_text.where("all > 1").select("node", F.lit(True).alias("_many"), F.col("best.id").alias("_id"), F.col("best.n").alias("_n"))
    status = stage(lost.join(many, "node", "full").withColumnRenamed("node", "_node"), "status")
    whole = F.coalesce(F.col(text), F.lit(""))
    sifting = sifted(df.withColumn("_node", F.xxhash64(whole)), F.col("_node"), status.select("_node"))
    alone = sifting.where("not _maybe").select(*df.columns)
    joined = sifting.where("_maybe").drop("_maybe").join(status, "_node", "left")
    kept = joined.where(F.col("_lost").isNull() & (F.col("_many").isNull() | F.col(doc_id).eqNullSafe(F.col("_id"))))
    if not status.where("_lost is null and _n > 1").isEmpty():  # rows that repeat id and text
        kept = kept.where("_n is null or _n = 1").union(kept.where("_n > 1").dropDuplicates(["_node"]))
    return alone.union(kept.select(*df.columns))

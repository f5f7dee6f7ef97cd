"""Document fingerprints by a homomorphic multiset hash (operator 9).

Every paragraph (a line) is hashed to a wide vector, and the fingerprint of a text is the sum of its paragraphs'
vectors: eight lanes modulo 2^64 from a cryptographic hash of the whole paragraph, and 256 lanes modulo 2^16 that
take +1 or -1 from each three-word shingle inside the paragraph. So the order of paragraphs doesn't matter, equal
multisets of paragraphs have equal fingerprints, and a paragraph is inserted or deleted by adding or subtracting
its vector. The second kind of lanes is short enough to compare: the squared length of a difference estimates how
many shingles two texts don't share.

Cases: a null text counts as empty, that is one empty paragraph; a paragraph of fewer than three words is one
shingle; repeated rows have equal fingerprints; an empty table gives an empty result; a column named like the
output is replaced, others stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.common import add_columns, field, mix, partitions, slices

EXACT, LANES = 8, 256
#: Bytes of text whose words are hashed at once.
SEGMENT = 1 << 20
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and how many line ends lie before it."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = SPACES[raw]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(begins):
        return np.array([], dtype=np.uint64), np.array([], dtype=np.int64)
    at = np.arange(len(raw)) - begins[np.maximum(np.searchsorted(begins, np.arange(len(raw)), side="right") - 1, 0)]
    factors = mix(np.arange(1, int(at.max()) + 2, dtype=np.uint64)) | np.uint64(1)
    values = np.where(space, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * factors[at])
    return mix(np.add.reduceat(values, begins)), np.cumsum(raw == 10)[begins]


def segments(data: bytes):
    """Pieces of at most about ``SEGMENT`` bytes, cut after white space."""
    start = 0
    while len(data) - start > SEGMENT:
        stop = max((data.rfind(bytes([c]), start, start + SEGMENT) for c in (32, 10))) + 1
        if stop <= start:  # one very long word
            found = [x for x in (data.find(b" ", start + SEGMENT), data.find(b"\n", start + SEGMENT)) if x >= 0]
            if not found:
                break
            stop = min(found) + 1
        yield data[start:stop]
        start = stop
    yield data[start:]


def sketches(texts: list[str]) -> np.ndarray:
    """The comparable lanes of each text, as int64 before reduction."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, lines, before = [], [], 0
    for piece in segments(b"\n".join(data)):
        h, line = words_of(piece)
        hashes.append(h)
        lines.append(line + before)
        before += piece.count(b"\n")
    word, line = np.concatenate(hashes), np.concatenate(lines)
    out = np.zeros((len(texts), LANES), dtype=np.int64)
    if not len(word):
        return out
    ends = np.cumsum([d.count(b"\n") + 1 for d in data])  # lines of each text
    n = len(word)
    second, third = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    same2 = np.zeros(n, dtype=bool)
    same3 = np.zeros(n, dtype=bool)
    same2[:-1] = line[1:] == line[:-1]
    same3[:-2] = line[2:] == line[:-2]
    second[:-1] = word[1:]
    third[:-2] = word[2:]
    starts = np.concatenate([[True], line[1:] != line[:-1]])
    use = same3 | starts
    shingle = word + np.where(same2, second, np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.where(same3, third, np.uint64(2)) * np.uint64(0xC2B2AE3D27D4EB4F)
    shingle = mix(shingle[use])
    text = np.searchsorted(ends, line[use], side="right")
    lane = (shingle & np.uint64(LANES - 1)).astype(np.int64)
    sign = ((shingle >> np.uint64(20)) & np.uint64(1)).astype(np.float64) * 2 - 1
    return np.bincount(text * LANES + lane, weights=sign, minlength=len(texts) * LANES).astype(np.int64).reshape(-1, LANES)


def exact(text: str) -> np.ndarray:
    """The exact lanes: sums of a cryptographic hash of each paragraph."""
    parts = text.encode("utf-8", "surrogatepass").split(b"\n")
    digests = b"".join([hashlib.blake2b(p, digest_size=8 * EXACT).digest() for p in parts])
    return np.frombuffer(digests, dtype="<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)


def fingerprint(texts: list[str]) -> list[bytes]:
    """Lanes of each text as bytes, little-endian: the exact ones, then the comparable ones."""
    wide = sketches(texts).astype("<u2") if texts else []
    return [exact(t).astype("<u8").tobytes() + w.tobytes() for t, w in zip(texts, wide)]


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """Inserts (or with sign -1 deletes) the paragraphs of ``b`` in ``a``."""
    cut = 8 * EXACT
    x, y = (np.frombuffer(v[:cut], dtype="<u8") for v in (a, b))
    s, t = (np.frombuffer(v[cut:], dtype="<u2") for v in (a, b))
    return (x + y if sign > 0 else x - y).tobytes() + (s + t if sign > 0 else s - t).tobytes()


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """0 to 1 for each pair: 1 for equal fingerprints, else by the squared lengths of difference and parts."""
    if not a:
        return np.zeros(0)
    cut = 8 * EXACT
    x, y = (np.frombuffer(b"".join(v[cut:] for v in side), dtype="<i2").reshape(-1, LANES).astype(np.float64) for side in (a, b))
    apart = (((x - y + 32768) % 65536 - 32768) ** 2).sum(axis=1)
    whole = (x**2).sum(axis=1) + (y**2).sum(axis=1)
    found = np.clip(1 - apart / np.maximum(whole, 1), 0, 1) * (whole > 0)
    return np.where([p == q for p, q in zip(a, b)], 1.0, found)


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as binary."""

    def make():
        return lambda texts: [pa.array(fingerprint([t or "" for t in texts.to_pylist()]), pa.binary())]

    return add_columns(df, [field(name, T.BinaryType())], make, text)


def place(value: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are below ``value``: first among every 32nd, then inside that block."""
    if not bounds:
        return F.lit(0)
    blocks = [bounds[i : i + 32] for i in range(0, len(bounds), 32)]
    heads = F.array(*(F.lit(b[-1]) for b in blocks))
    inner = F.array(*(F.array(*(F.lit(x) for x in b)) for b in blocks))
    below = lambda items: F.size(F.filter(items, lambda x: x < value))
    block = below(heads)
    found = F.least(block * 32 + F.coalesce(below(F.get(inner, block)), F.lit(0)), F.lit(len(bounds)))
    return F.when(value.isNull(), 0).otherwise(found).cast("int")


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in one partition per range of ids, by descending id, each range ended by the row that follows it.

    The ranges end at ids that exist, so the row that must be sent twice (column ``tail``) is known from its id
    alone: the largest of a range also ends the range above, and the largest of all follows the last.
    """
    spark = df.sparkSession
    parts = partitions(spark)
    shares = [k / parts for k in range(1, parts)] or [0.5]
    df = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = df.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)).alias("at"), F.max("doc_id").alias("top")).first()
    bounds = sorted({x for x in found["at"] or [] if x < found["top"]})
    own = place(F.col("doc_id"), bounds)
    at = {b: i + 1 for i, b in enumerate(bounds)} | {found["top"]: 0}
    again = F.element_at(F.create_map(*(F.lit(x) for pair in at.items() for x in pair)), F.col("doc_id")) if found["top"] is not None else F.lit(0)
    copies = F.when(again.isNull(), F.array(F.struct(own.alias("part"), F.lit(False).alias("tail")))).otherwise(
        F.array(F.struct(own.alias("part"), F.lit(False).alias("tail")), F.struct(again.cast("int").alias("part"), F.lit(True).alias("tail")))
    )
    rows = df.select("doc_id", "text", F.explode(copies).alias("_at")).select("_at.part", "_at.tail", "doc_id", "text")
    return rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: the text with its last third replaced from the next row by descending id, both fingerprints,
    and the likeness of the row's fingerprint to that of the edited text and of the next row."""
    schema = "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    ids = df.schema[doc_id].dataType.simpleString()
    schema = schema.replace("doc_id long", f"doc_id {ids}")

    def emit(rows):
        """``rows``: (id, text, fingerprint), the last only as the next of the one before."""
        own, follow = rows[:-1], rows[1:]
        edited = []
        for (_, t, _), (_, nxt, _) in zip(own, follow):
            k = len(t) // 3
            edited.append(t[: len(t) - k] + nxt[:k])
        prints = fingerprint(edited)
        mine, theirs = [r[2] for r in own], [r[2] for r in follow]
        return pa.RecordBatch.from_pydict({
            "doc_id": [r[0] for r in own], "n_chars": pa.array([len(r[1]) for r in own], pa.int64()), "edited": edited, "fingerprint": mine,
            "edited_fingerprint": prints, "near_edited": likeness(mine, prints), "near_next": likeness(mine, theirs),
        })

    def run(batches):
        held, part, over = [], None, False
        for batch in batches:
            for piece in slices(batch, 3, SEGMENT):
                columns = [c.to_pylist() for c in piece.columns]
                texts = [t or "" for t in columns[3]]
                for p, tail, i, t, f in zip(columns[0], columns[1], columns[2], texts, fingerprint(texts)):
                    if p != part:
                        part, held, over = p, [], False
                    if over:
                        continue  # further copies of the row that ended this range
                    held.append((i, t, f))
                    over = tail
                    if tail and len(held) > 1:
                        yield emit(held)
                        held = []
                if len(held) > 1:
                    yield emit(held)
                    held = held[-1:]

    return with_next(df, doc_id, text).mapInArrow(run, schema)

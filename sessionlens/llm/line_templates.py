"""Line dedup by a log-template tree (operator 8).

Every line goes down a tree of fixed depth: the number of its tokens, then its leading tokens, then the template.
Variable fields are generalised in two ways: tokens that hold a digit become ``<*>`` before anything else, and a
line of ``FREE_FROM`` tokens or more also takes part in ``BLOCKS`` templates in which one block of its tokens after
the leading ones (every ``BLOCKS``-th token) is free. So lines that differ in one field meet under a template, and
meeting is equality of a hash: no leaf is ever gathered or compared line by line.

A template that occurs in at least two documents recurs, and the line is dropped from all of them but the first
(least id), where its first occurrence stays. Lines of fewer than ``LEAST`` tokens are keyed by their exact tokens;
they say little, so they recur only from ``SHORT_RECURS`` documents on, and with fewer than ``LETTERS`` letters (a
bracket, a heading, an answer of one word) never.
A template with wildcards counts only if at least ``LITERAL`` of its tokens and half of them are fixed words (tokens
with a letter): rows of numbers and of other fields recur only as they are.
Tokens are parted by white space; in scripts that put no spaces between words, two characters are a token.

Keys are made for a whole slice of texts at once: every token has a hash of its code points, and a template's key
is a sum over its tokens, each mixed with its place, where free tokens count as one fixed value.

Documents are told apart by id and text, so rows that repeat both are one document. Cases: a null text stays null;
an empty line stays; null ids come first; a text all of whose lines are dropped becomes empty; an empty table gives
an empty result; columns named like an output are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.common import add_columns, code_points, field, mix, sifted
from sessionlens.session import stage

LEAST, FREE_FROM, LEADING, BLOCKS, LITERAL = 5, 10, 3, 4, 3
#: Documents in which a template recurs, the same for lines below ``LEAST`` tokens, and the letters such a line needs.
RECURS, SHORT_RECURS, LETTERS = 2, 4, 12
#: First and last code points of Thai and Lao, Myanmar, Khmer, kana and Han, which put no spaces between words.
SPACELESS = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
             (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
SPACE, NEWLINE, OTHER, DENSE = range(4)
#: Code points whose tokens are hashed at once; a longer line stands alone.
AT_ONCE = 1 << 20
FACTOR, FREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def kinds() -> np.ndarray:
    """What every code point is: white space, the end of a line, part of a word, or part of words without spaces."""
    kind = np.full(0x110000, OTHER, dtype=np.uint8)
    kind[[9, 11, 12, 13, 32]] = SPACE
    kind[10] = NEWLINE
    for first, last in SPACELESS:
        kind[first : last + 1] = DENSE
    return kind


def pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """The texts in runs of about ``AT_ONCE`` code points with the text each piece is of, longer texts cut at line ends."""
    run, owner, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at <= len(text):
            cut = text.find("\n", at + AT_ONCE) if len(text) - at > AT_ONCE else -1
            cut = len(text) if cut < 0 else cut
            run.append(text[at:cut] + "\n")
            owner.append(i)
            held, at = held + cut - at, cut + 1
            if held >= AT_ONCE:
                yield run, owner
                run, owner, held = [], [], 0
    if run:
        yield run, owner


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def tokens_of(points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash, number of letters and whether it holds a digit, of every token."""
    at = np.arange(len(points), dtype=np.int64)
    begins = (kind >= OTHER) & np.r_[True, kind[1:] != kind[:-1]]
    begins |= (kind == DENSE) & ((at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0)
    starts = np.flatnonzero(begins)
    place = at - np.maximum.accumulate(np.where(begins, at, 0))
    place[kind < OTHER] = 0
    powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, FACTOR))
    value = np.where(kind >= OTHER, mix(points.astype(np.uint64) + FREE) * powers[place], np.uint64(0))
    lower = points | 32
    letter = (kind >= OTHER) & ((points >= 0x80) | ((lower >= 97) & (lower <= 122)))
    digit = (points >= 48) & (points <= 57)
    return starts, mix(sums(value, starts)), sums(letter.astype(np.int64), starts), sums(digit.astype(np.int64), starts) > 0


def template_keys(texts: list[str], kind_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of every template of every line; lines are numbered over all ``texts``, which end with a line end.
    The last bit of a key tells lines below ``LEAST`` tokens."""
    points, _ = code_points(texts)
    kind = kind_of[points]
    starts, hashed, letters, digit = tokens_of(points, kind)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    line, first, n = np.unique(np.cumsum(kind == NEWLINE)[starts], return_index=True, return_counts=True)
    row = np.repeat(np.arange(len(line)), n)
    place = np.arange(len(starts)) - first[row]
    where = mix(place.astype(np.uint64) + FACTOR)
    free = mix(FREE ^ where)
    worded = lambda words: (words >= LITERAL) & (2 * words >= n)
    general = (n >= LEAST) & worded(sums(((letters > 0) & ~digit).astype(np.int64), first))
    open_ = digit & general[row]
    value, word = np.where(open_, free, mix(hashed ^ where)), (letters > 0) & ~open_
    short = n < LEAST
    size = n.astype(np.uint64)
    lines, keys = [line[~short | (sums(letters, first) >= LETTERS)]], []
    whole = mix(sums(value, first) + mix(size)) & ~np.uint64(1) | short.astype(np.uint64)
    keys.append(whole[~short | (sums(letters, first) >= LETTERS)])
    for block in range(BLOCKS):
        inside = (place >= LEADING) & ((place - LEADING) % BLOCKS == block)
        taken = (n >= FREE_FROM) & worded(sums((word & ~inside).astype(np.int64), first))
        key = mix(sums(np.where(inside, free, value), first) + mix(size + np.uint64((block + 1) << 32))) & ~np.uint64(1)
        lines.append(line[taken])
        keys.append(key[taken])
    return np.concatenate(lines), np.concatenate(keys).view(np.int64)


def with_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``keys``: line number, template key and whether the text has it here first, of every template of every line."""

    def make():
        kind_of = kinds()

        def compute(texts):
            texts = [t or "" for t in texts.to_pylist()]
            found, lines, keys, before = [], [], [], np.zeros(len(texts), dtype=np.int64)
            for run, owner in pieces(texts):
                own, held = np.array(owner), np.array([t.count("\n") for t in run])
                line, key = template_keys(run, kind_of)
                ends = np.cumsum(held)
                piece = np.searchsorted(ends, line, side="right")
                earlier = before[own[piece]]  # lines of the text in earlier runs; inside a run a text is one piece
                found.append(own[piece])
                lines.append(line - (ends - held)[piece] + earlier)
                keys.append(key)
                np.add.at(before, own, held)
            none = np.zeros(0, dtype=np.int64)
            found, lines, keys = (np.concatenate([none, *x]) for x in (found, lines, keys))
            order = np.lexsort((lines, keys, found))
            found, lines, keys = found[order], lines[order], keys[order]
            first = np.r_[True, (keys[1:] != keys[:-1]) | (found[1:] != found[:-1])][: len(keys)]
            parts = [pa.array(lines, pa.int32()), pa.array(keys, pa.int64()), pa.array(first, pa.bool_())]
            ends = np.searchsorted(found, np.arange(len(texts) + 1))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["line", "key", "first"]))]

        return compute

    kind = T.ArrayType(T.StructType([field("line", T.IntegerType()), field("key", T.LongType()), field("first", T.BooleanType())]))
    return add_columns(df, [field("keys", kind)], make, text)


def once(docs: DataFrame) -> DataFrame:
    """(id, hash, text) with one row for rows that repeat all three; only such rows are shuffled with their texts."""
    twice = stage(docs.groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").select("id", "hash"), "repeated")
    if twice.isEmpty():
        return docs
    same = [F.col("hash") == F.col("_hash"), F.col("id").eqNullSafe(F.col("_id"))]
    twice = twice.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    sifting = sifted(docs, F.col("hash"), twice.select("_hash"))
    some = sifting.where("_maybe").drop("_maybe")
    mixed = some.join(twice, same, "left_anti").union(some.join(twice, same, "left_semi").dropDuplicates(["id", "hash"]))
    return sifting.where("not _maybe").drop("_maybe").union(mixed)


def recurring_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, lines): for each document the numbers of its lines to drop."""
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(doc_id).alias("id"), F.xxhash64(whole).alias("hash"), whole.alias("text"))
    lines = stage(with_keys(once(docs)).select("id", "hash", F.explode("keys").alias("k")).select("id", "hash", "k.line", "k.key", "k.first"), "lines")
    seen = lines.where("first").groupBy("key").agg(F.min(F.struct("id", "hash", "line")).alias("first"), F.count("*").alias("n"))
    enough = f"n >= if(key & 1 = 1, {SHORT_RECURS}, {RECURS})"
    recurring = stage(seen.where(enough).select("key", F.col("first").alias("at")), "recurring")
    some = sifted(lines, F.col("key"), recurring.select("key")).where("_maybe")
    again = some.join(recurring, "key").where("at.id is distinct from id or at.hash <> hash or at.line <> line")
    return stage(again.groupBy("id", "hash").agg(F.collect_set("line").alias("lines")), "dropped-lines")


def without_recurring_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", dropped: str = "n_dropped") -> DataFrame:
    """``df`` with the texts freed of recurring lines, and how many lines each text lost."""
    found = recurring_lines(df, doc_id, text).select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("lines").alias("_lines"))
    rows = df.withColumn("_own", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = rows.join(found, (F.col("_own") == F.col("_hash")) & F.col(doc_id).eqNullSafe(F.col("_id")), "left").drop("_own", "_hash", "_id")
    kept = [f.name for f in joined.schema.fields if f.name not in ("_lines", text, dropped)]
    schema = T.StructType([joined.schema[n] for n in kept] + [field(text, T.StringType()), field(dropped, T.LongType())])

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            texts, counts = [], []
            for t, gone in zip(batch.column(at[text]).to_pylist(), batch.column(at["_lines"]).to_pylist()):
                if t is not None and gone:
                    out = set(gone)
                    t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in out])
                texts.append(t)
                counts.append(len(gone or ()))
            columns = [*(batch.column(at[n]) for n in kept), pa.array(texts, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, text, dropped])

    return joined.mapInArrow(run, schema)

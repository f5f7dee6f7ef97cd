"""Cross-tokenizer alignment with corpus-wide pair counts by minimal perfect hashing (operator 11).

A text after one space is cut by a byte-level BPE (A) and by a piece BPE with byte fallback (B). Both cut the same bytes,
so a token of A and a token of B are linked where their byte ranges overlap, and offsets at which both end part the text
into groups. Neither vocabulary has a token that goes on over a space after a visible character, so texts are cut
there and each distinct chunk is aligned once per worker, however often it occurs.

1. The first pass aligns all texts and sums, per task, in how many documents each id pair is linked.
2. The distinct pairs get a minimal perfect hash: groups of about ``GROUP`` keys, each a chain of bit arrays in which a key is
   placed at the first level where it is alone; a key's slot is the rank of its bit, 3 to 4 bits a key in all.
3. The sums become dense count vectors indexed by the slot, one per group and task, which are added up in a tree of
   ``FAN`` vectors a node. Each slot keeps its key, and a look-up counts only if the key is the one asked for.
4. The second pass aligns the texts again and looks the counts of their links up.

Texts never leave their scan. What a pass broadcasts is bounded by ``ROUND`` slots (16 bytes and some bits each) whatever the
number of pairs: more slots are taken in rounds, each of which aligns the texts again and adds its part. The highest
count of an A id is one number per entry of vocabulary A.

Cases: a null or empty text, or one whose joined token bytes differ from the space and the text, has no tokens: zeros and an
empty ``groups``; strings of special tokens are plain text; repeated rows are documents each; null ids stay; an empty
table gives an empty result; columns named like an output are replaced, others stay.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.bpe import PIECES, byte_letters
from sessionlens.llm.common import add_columns, field, gather, mix, partitions, slices
from sessionlens.session import stage

#: Chunks, and bytes of chunks, remembered per Python worker; only speed depends on it.
REMEMBERED, REMEMBERED_BYTES = 300_000, 32 << 20
#: Chunks in a line that library B encodes as one; much longer lines cost it more.
LINE = 64
#: Bytes of text that a task aligns at once.
SLICE = 4 << 20
#: Distinct pairs that a task of the first pass holds before it passes sums on.
HELD = 1 << 21
#: Keys of a hash group, slots of a round, and vectors that a node of the tree adds up.
GROUP, ROUND, FAN = 1 << 14, 1 << 22, 32
#: Bits of a level per key that is left.
SPARE = 1.5
#: A chunk ends before a space that follows a visible character.
BORDER = re.compile(r"(?<=\S)(?= )")


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Aligner:
    """Tokens of both vocabularies, aligned chunk by chunk and remembered under a number per chunk."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        with open(path_a, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        known = {**{t["id"]: t["content"].encode() for t in content["added_tokens"]}, **{i: bytes(letters[c] for c in t) for t, i in content["model"]["vocab"].items()}}
        bytes_a = [known.get(i, b"") for i in range(1 + max(known))]
        self.ids_a = self.coder_a(path_a, content, bytes_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.parted = not any("▁" in p.lstrip("▁") for _, p in pieces)  # else no border holds for B
        self.space_b = self.b.piece_to_id("▁")
        self.size_a, self.size_b = len(bytes_a), len(bytes_b)
        self.bytes = [self.layout(bytes_a), self.layout(bytes_b)]
        numbers_a, numbers_b = [str(i) for i in range(self.size_a)], [str(i) for i in range(self.size_b)]
        #: Decimal ids with what follows them: inside A, at the end of A, inside B, at the end of B.
        self.shown = [f"{n}{mark}" for numbers, mark in ((numbers_a, ","), (numbers_a, "|"), (numbers_b, ","), (numbers_b, ";")) for n in numbers]
        self.generation, self.shows = 0, True
        self.forget()

    @staticmethod
    def coder_a(path: str, content: dict, tokens: list[bytes]) -> Callable[[str], list[int]]:
        """Encodes a text by vocabulary A without special tokens.

        Where ids follow the order of the merges, as they do in a vocabulary of ranks, the faster library gives the same ids.
        """
        vocab = content["model"]["vocab"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in content["model"]["merges"]]
        made = [vocab[m] for m in merges]
        if made == sorted(set(made)) and max(vocab[c] for c in byte_letters()) < made[0]:
            import tiktoken

            ranks = {tokens[i]: i for i in vocab.values()}
            special = {tokens[t["id"]] for t in content["added_tokens"]}
            ranks = {b: i for b, i in ranks.items() if b not in special}
            return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        own.encode_special_tokens = True
        return lambda text: own.encode(text, add_special_tokens=False).ids

    def ids_b(self, text: str) -> list[int]:
        """Ids by vocabulary B of a text that begins with the space which B adds."""
        return self.b.encode(text[1:], num_threads=1) or [self.space_b]

    def together_a(self, chunks: list[str]) -> list[int]:
        return self.ids_a("".join(chunks))

    def together_b(self, chunks: list[str]) -> list[int]:
        lines = ["".join(chunks[i : i + LINE])[1:] for i in range(0, len(chunks), LINE)]
        return list(chain.from_iterable(self.b.encode(lines, num_threads=1)))

    def apart(self, chunk: str) -> bool:
        """Whether a chunk must be encoded alone: a border after it may not hold, or B won't give its bytes back."""
        return not self.parted or chunk[-1].isspace() or "▁" in chunk

    @staticmethod
    def layout(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes

    def forget(self) -> None:
        self.generation += 1
        self.held_bytes = 0
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.valid = np.zeros(0, dtype=bool)
        #: Rows: tokens of A, tokens of B, groups, links.
        self.counts = np.zeros((4, 0), dtype=np.int64)
        self.links, self.link_starts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def learn(self, new: list[str]) -> None:
        """Align chunks, each of which begins with a space, and append them to the memory."""
        alone = list(map(self.apart, new))
        together = alone.count(False)
        if together < len(new):
            new = [c for c, x in zip(new, alone) if not x] + [c for c, x in zip(new, alone) if x]
        raw = [c.encode() for c in new]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        self.held_bytes += int(size.sum())
        valid = np.ones(len(new), dtype=bool)
        flats, counts = [], []
        for encode, many, (data, starts, sizes) in zip((self.ids_a, self.ids_b), (self.together_a, self.together_b), self.bytes):
            flat, count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            if together:  # chunks whose borders hold are encoded in one go; their token ends say where each stops
                flat = np.array(many(new[:together]), dtype=np.int64)
                ends, stops = np.cumsum(sizes[flat]), np.cumsum(size[:together])
                last = np.searchsorted(ends, stops)
                if gather(data, starts, sizes, flat).tobytes() == b"".join(raw[:together]) and np.array_equal(ends[last], stops):
                    count = np.diff(last, prepend=-1)
                else:
                    flat = flat[:0]
            apart = [encode(c) for c in new[len(count) :]]
            more = np.array([len(x) for x in apart], dtype=np.int64)
            rest = np.fromiter(chain.from_iterable(apart), dtype=np.int64, count=int(more.sum()))
            flat, counted = np.concatenate([flat, rest]), np.concatenate([count, more])
            if apart:
                owner = np.repeat(np.arange(len(apart)), more)
                at = np.cumsum(np.bincount(owner, weights=sizes[rest], minlength=len(apart)).astype(np.int64)).tolist()
                text = gather(data, starts, sizes, rest).tobytes()
                valid[len(count) :] &= np.array([text[i:j] == r for i, j, r in zip([0, *at], at, raw[len(count) :])], dtype=bool)
            flats.append((flat, np.repeat(np.arange(len(new)), counted), sizes))
            counts.append(counted)
        ends, tokens = [], []
        base = np.cumsum(np.where(valid, size, 0))
        for flat, owner, sizes in flats:
            keep = valid[owner]
            tokens.append(flat[keep])
            ends.append(np.cumsum(sizes[flat[keep]]))
        both = distinct(np.concatenate(ends))
        links = tokens[0][np.searchsorted(ends[0], both)] * self.size_b + tokens[1][np.searchsorted(ends[1], both)] if len(both) else np.zeros(0, dtype=np.int64)
        n_links = np.bincount(np.searchsorted(base, both), minlength=len(new)) if len(both) else np.zeros(len(new), dtype=np.int64)
        shared = ends[0][np.searchsorted(ends[1], ends[0], side="right") > np.searchsorted(ends[1], ends[0])]
        n_groups = np.bincount(np.searchsorted(base, shared), minlength=len(new)) if len(shared) else np.zeros(len(new), dtype=np.int64)
        if self.shows:
            in_group = [np.searchsorted(shared, e) for e in ends]
            last = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, dtype=bool) for g in in_group]
            codes = np.concatenate([tokens[0] + self.size_a * last[0], 2 * self.size_a + tokens[1] + self.size_b * last[1]])
            order = np.argsort(np.concatenate([2 * in_group[0], 2 * in_group[1] + 1]), kind="stable")
            shown = list(map(self.shown.__getitem__, codes[order].tolist()))
            at = np.cumsum(np.where(valid, counts[0] + counts[1], 0)).tolist()
            self.groups.extend("".join(shown[i:j]) for i, j in zip([0, *at], at))
        self.number.update(zip(new, range(len(self.valid), len(self.valid) + len(new))))
        self.link_starts = np.concatenate([self.link_starts, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, links])
        self.valid = np.concatenate([self.valid, valid])
        rows = np.stack([np.where(valid, counts[0], 0), np.where(valid, counts[1], 0), n_groups, n_links])
        self.counts = np.concatenate([self.counts, rows], axis=1)

    def numbers(self, texts: pa.Array, shows: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk numbers of all texts, the text that each belongs to, and which texts have tokens.

        ``shows``: the chunks' groups are wanted as text.
        """
        if shows != self.shows:
            self.shows = shows
            self.forget()
        if len(self.number) > REMEMBERED or self.held_bytes > REMEMBERED_BYTES:
            self.forget()
        parts = [(BORDER.split(" " + t) if self.parted else [" " + t]) if t else [] for t in texts.to_pylist()]
        new = list(set().union(*parts).difference(self.number))
        if new:
            self.learn(new)
        count = np.array([len(p) for p in parts], dtype=np.int64)
        codes = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(count.sum()))
        owner = np.repeat(np.arange(len(parts)), count)
        good = count > 0
        good[owner[~self.valid[codes]]] = False
        keep = good[owner]
        return codes[keep], owner[keep], good

    def pair_sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs, ascending, and in how many of the texts each is linked."""
        codes, owner, _ = self.numbers(texts, shows=False)
        seen = distinct(owner * len(self.valid) + codes)
        owner, codes = np.divmod(seen, max(1, len(self.valid)))
        sizes = self.counts[3]
        pairs, inverse = np.unique(gather(self.links, self.link_starts, sizes, codes), return_inverse=True)
        held = distinct(np.repeat(owner, sizes[codes]) * len(pairs) + inverse)
        return pairs, np.bincount(held % max(1, len(pairs)), minlength=len(pairs)).astype(np.int64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker for two tokenizer files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def added(pairs: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of several lists of pairs put together."""
    every, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    return every, np.bincount(inverse, weights=np.concatenate(sums), minlength=len(every)).astype(np.int64)


def partial_sums(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(pair, n): per task, in how many of its texts each pair is linked. First pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        pairs, sums, held = [], [], 0
        for batch in batches:
            for piece in slices(batch, 0, SLICE):
                found, n = own.pair_sums(piece.column(0))
                pairs.append(found)
                sums.append(n)
                held += len(found)
                if held > HELD:
                    found, n = added(pairs, sums)
                    pairs, sums, held = [found], [n], len(found)
                    if held > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])
                        pairs, sums, held = [], [], 0
        if pairs:
            found, n = added(pairs, sums)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])

    return df.select(text).mapInArrow(run, "pair long, n long")


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def perfect_levels(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes in bits (multiples of 64), all bits as words, and the keys by slot, for distinct keys."""
    sizes, words, order = [], [], []
    left = keys
    while len(left):
        size = -(-int(SPARE * len(left) + 1) // 64) * 64
        at = (level_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        order.append(left[mine][np.argsort(at[mine])])
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = left[~mine]
    return sizes, np.concatenate([np.zeros(0, dtype=np.uint64), *words]), np.concatenate([keys[:0], *order])


class PerfectHash:
    """Slots of the keys of some neighbouring groups, 0 to ``len(keys) - 1``; -1 for any other key."""

    def __init__(self, rows: list[tuple[int, list[int], bytes, bytes]], groups: int):
        """``rows``: (group, level sizes, bits, keys by slot), ascending groups without gaps."""
        self.groups, self.first, self.last = groups, rows[0][0], rows[-1][0]
        depth = max(1, *(len(r[1]) for r in rows))
        self.size = np.zeros((len(rows), depth), dtype=np.int64)
        for k, r in enumerate(rows):
            self.size[k, : len(r[1])] = r[1]
        self.start = (np.cumsum(self.size.ravel()) - self.size.ravel()).reshape(self.size.shape)
        self.words = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum([len(r[3]) // 8 for r in rows])])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        group = group_of(keys, self.groups)
        left = np.flatnonzero((group >= self.first) & (group <= self.last))
        group = group - self.first
        for level in range(self.size.shape[1]):
            size = self.size[group[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.start[group[left], level] + (level_hash(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        found = out >= 0
        out[found] = np.where(self.keys[out[found]] == keys[found], out[found], -1)
        return out


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches sorted by ``column``, cut into runs of equal values."""
    value, held = None, []
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(column)).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for i, j in zip(cuts, cuts[1:]):
            if held and keys[i] != value:
                yield value, held
                held = []
            value = int(keys[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield value, held


HASH = "g long, n long, sizes array<int>, bits binary, keys binary"


def perfect_hash(sums: DataFrame) -> tuple[DataFrame, int]:
    """One row per group of the minimal perfect hash over the distinct pairs of ``sums``; and how many groups it has."""
    keys = stage(sums.select("pair").distinct(), "pairs")
    groups = max(1, -(-keys.count() // GROUP))

    def keyed(batches):
        for batch in batches:
            pairs = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(group_of(pairs, groups)), batch.column(0)], names=["g", "pair"])

    def build(batches):
        for g, parts in runs(batches, "g"):
            sizes, words, order = perfect_levels(np.concatenate([p.column(1).to_numpy() for p in parts]))
            row = {"g": g, "n": len(order), "sizes": sizes, "bits": words.tobytes(), "keys": order.tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("keys", pa.binary())])
    dealt = keys.mapInArrow(keyed, "g long, pair long").repartition(partitions(sums.sparkSession), "g").sortWithinPartitions("g", "pair")
    return stage(dealt.mapInArrow(build, HASH), "perfect-hash"), groups


def rounds(table: DataFrame) -> list[tuple[int, int]]:
    """Ranges of groups of at most ``ROUND`` slots (or one group) each."""
    out, slots = [], 0
    for g, n in table.select("g", "n").orderBy("g").toLocalIterator():  # one number per GROUP pairs
        if not out or slots + n > ROUND:
            out.append((g, g))
            slots = 0
        out[-1] = (out[-1][0], g)
        slots += n
    return out


def fetched(table: DataFrame, first: int, last: int, *more: str) -> list[tuple]:
    """The rows of the groups of one round, to be broadcast."""
    return [tuple(r) for r in table.where(F.col("g").between(first, last)).orderBy("g").select("g", "sizes", "bits", "keys", *more).collect()]


VECTORS = "g long, node long, counts binary"


def dense(sums: DataFrame, table: DataFrame, first: int, last: int, groups: int) -> DataFrame:
    """One count vector per task and group of a round, from partial sums."""
    spark = sums.sparkSession
    shared = spark.sparkContext.broadcast(PerfectHash(fetched(table, first, last), groups))

    def run(batches):
        own = shared.value
        total = np.zeros(len(own.keys), dtype=np.int64)
        node = None
        for batch in batches:
            if not batch.num_rows:
                continue
            node = int(batch.column(2)[0].as_py())
            pairs = batch.column(0).to_numpy()
            slots = own.slots(pairs)
            asked = group_of(pairs, groups)
            if ((slots < 0) & (asked >= own.first) & (asked <= own.last)).any():
                raise ValueError("a pair is missing from the perfect hash")
            inside = slots >= 0
            np.add.at(total, slots[inside], batch.column(1).to_numpy()[inside])
        if node is not None:
            for k, (i, j) in enumerate(zip(own.base, own.base[1:])):
                vector = total[i:j]
                if vector.any():
                    yield pa.RecordBatch.from_arrays([pa.array([own.first + k]), pa.array([node]), pa.array([vector.tobytes()], pa.binary())], names=["g", "node", "counts"])

    return sums.withColumn("node", F.spark_partition_id().cast("long")).mapInArrow(run, VECTORS)


def tree_sum(vectors: DataFrame) -> DataFrame:
    """One vector per group: ``FAN`` neighbouring nodes are added up at a time, level by level."""

    def add(batches):
        for (g, node), vector in summed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([node]), pa.array([vector.tobytes()], pa.binary())], names=["g", "node", "counts"])

    def summed(batches):
        key, total = None, None
        for batch in batches:
            for g, node, raw in zip(*(c.to_pylist() for c in batch.columns)):
                vector = np.frombuffer(raw, dtype=np.int64)
                if key != (g, node):
                    if key is not None:
                        yield key, total
                    key, total = (g, node), vector.copy()
                else:
                    total += vector
        if key is not None:
            yield key, total

    nodes = (vectors.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        nodes = -(-nodes // FAN)
        vectors = vectors.withColumn("node", F.call_function("div", F.col("node"), F.lit(FAN)).cast("long"))
        dealt = vectors.repartition(partitions(vectors.sparkSession), "g", "node").sortWithinPartitions("g", "node")
        vectors = dealt.mapInArrow(add, VECTORS)
        if nodes <= 1:
            return vectors.select("g", "counts")


def counted_pairs(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> tuple[DataFrame, int]:
    """The perfect hash with the corpus-wide count of every slot, one row per group; and how many groups it has."""
    sums = stage(partial_sums(df, path_a, path_b, text), "pair-sums")
    table, groups = perfect_hash(sums)
    made = None
    for first, last in rounds(table):
        vectors = stage(dense(sums, table, first, last, groups), "count-vectors")
        part = tree_sum(vectors)
        made = part if made is None else made.union(part)
    if made is None:
        return table.withColumn("counts", F.lit(b"")), groups
    return stage(table.join(made, "g"), "pair-counts"), groups


def pair_counts(counted: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n_docs): every linked id pair and in how many documents it is linked."""

    def run(batches):
        size_b = aligner(path_a, path_b).size_b
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = np.divmod(np.frombuffer(keys, dtype=np.int64), size_b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.frombuffer(counts, dtype=np.int64))], names=["a", "b", "n_docs"])

    return counted.select("keys", "counts").mapInArrow(run, "a long, b long, n_docs long")


def highest_counts(counted: DataFrame, path_a: str, path_b: str) -> np.ndarray:
    """For every A id the highest count of its pairs, 0 if it has none."""
    best = pair_counts(counted, path_a, path_b).groupBy("a").agg(F.max("n_docs").alias("n")).collect()  # at most the vocabulary
    out = np.zeros(max((r["a"] for r in best), default=-1) + 1, dtype=np.int64)
    for r in best:
        out[r["a"]] = r["n"]
    return out


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, n_best and count_sum (long) and ``groups`` (string: ``a1,a2|b1;a3|b2,b3``).

    ``n_best`` counts the links whose pair has the highest count of its A id, ``count_sum`` adds the counts of all links.
    """
    spark = df.sparkSession
    counted, groups = counted_pairs(df, path_a, path_b, text)
    best = spark.sparkContext.broadcast(highest_counts(counted, path_a, path_b))
    ranges = rounds(counted)
    long = T.LongType()

    def looked_up(shared):
        """Per slice: how many links of each text are best ones, and the sum of the counts of its links."""
        own = aligner(path_a, path_b)
        memory = {"generation": None}

        def compute(texts):
            codes, owner, good = own.numbers(texts)
            if memory["generation"] != own.generation:
                memory.update(generation=own.generation, done=0, links=0, sums=np.zeros((2, 0), dtype=np.int64))
            if shared is not None and memory["done"] < len(own.valid):
                new = own.links[memory["links"] :]
                chunk = np.repeat(np.arange(len(own.valid) - memory["done"]), own.counts[3, memory["done"] :])
                perfect, counts = shared.value
                slots = perfect.slots(new)
                here = slots >= 0
                n = counts[slots[here]]
                top = n == best.value[new[here] // own.size_b]
                size = len(own.valid) - memory["done"]
                rows = [np.bincount(chunk[here], weights=w, minlength=size).astype(np.int64) for w in (top, n)]
                memory.update(done=len(own.valid), links=len(own.links), sums=np.concatenate([memory["sums"], np.stack(rows)], axis=1))
            add = lambda values: pa.array(np.bincount(owner, weights=values, minlength=len(texts)).astype(np.int64))
            sums = [add(memory["sums"][k][codes]) if shared is not None else pa.array(np.zeros(len(texts), dtype=np.int64)) for k in (0, 1)]
            return codes, owner, add, sums

        return own, compute

    def make_first(shared):
        def make():
            own, compute = looked_up(shared)

            def run(texts):
                codes, owner, add, sums = compute(texts)
                at = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
                chunks = list(map(own.groups.__getitem__, codes.tolist()))
                shown = pa.array(["".join(chunks[i:j])[:-1] for i, j in zip(at, at[1:])], pa.string())
                return [*(add(own.counts[k][codes]) for k in range(4)), *sums, shown]

            return run

        return make

    def make_more(shared):
        def make():
            _, compute = looked_up(shared)
            return lambda texts: compute(texts)[3]

        return make

    def share(first, last):
        rows = fetched(counted, first, last, "counts")
        counts = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.int64)
        return spark.sparkContext.broadcast((PerfectHash([r[:4] for r in rows], groups), counts))

    shared = share(*ranges[0]) if ranges else None
    fields = [*(field(n, long) for n in (*NUMBERS, "n_best", "count_sum")), field("groups", T.StringType())]
    out = add_columns(df, fields, make_first(shared), text, SLICE)
    for span in ranges[1:]:
        out = stage(out, "aligned")  # so that only one round is held
        shared.unpersist()
        shared = share(*span)
        names = ["__more_best", "__more_sum"]
        out = add_columns(out, [field(n, long) for n in names], make_more(shared), text, SLICE)
        out = out.withColumns({"n_best": F.col("n_best") + F.col(names[0]), "count_sum": F.col("count_sum") + F.col(names[1])}).drop(*names)
    return out

"""BPE encoding and decoding by a pair occurrence index (operator 2).

All distinct pieces that a batch adds are laid out in one symbol array. An index maps each mergeable pair,
named by its rank, to all its positions; ranks that are active are taken in ascending order, every position of
a rank is merged, and the pairs that a merge makes go to the lists of their own ranks. Results per piece are
kept in a bounded memory, so a frequent piece is merged once.

Cases: a null text counts as empty and gives no ids and an empty text back; a text of special tokens only gives
their ids; repeated rows are encoded alike; an empty table gives an empty result; a column named like the
output is replaced, all other columns stay.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sessionlens.llm.common import add_columns, field, gather

#: Fixed value: the pattern that cuts a text before merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks remembered per Python worker; only speed depends on it.
REMEMBERED = 250_000
#: Bytes of text that a task encodes at once.
SLICE = 4 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairIndexCoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocab: dict[str, int] = content["model"]["vocab"]
        letters = byte_letters()
        self.special: dict[str, int] = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.end = 1 + max([*vocab.values(), *self.special.values()])
        self.base = self.end + 1
        token_bytes = [b""] * self.end
        for token, i in vocab.items():
            token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.sizes = np.array([len(b) for b in token_bytes], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        by_byte = {b: vocab[c] for c, b in letters.items()}
        self.first = np.array([by_byte[b] for b in range(256)], dtype=np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in content["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = self.left * self.base + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.cut = regex.compile(PIECES)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Chunks between single spaces; None for one that begins or ends in white space, or is empty.
        self.heads: dict[str, tuple[int, ...] | None] = {}
        self.chunks: dict[str, tuple[int, ...] | None] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that don't merge."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word, all words merged together through one index from pairs to their positions."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words])  # one mark after each word
        n = int(ends[-1])
        symbol = np.full(n + 1, self.end, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[ends - 1] = False
        symbol[:n][inside] = self.first[raw]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray) -> None:
            """Put pairs that merge into the lists of their ranks."""
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            keep = rank >= 0
            rank, positions = rank[keep], positions[keep]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, positions = rank[order], positions[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, group in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(active, r)

        add(np.flatnonzero(inside))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            a, b, made = self.left[rank], self.right[rank], self.made[rank]
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]  # an earlier merge may have taken one of the two
            if a == b and len(at) > 1:
                at = leftmost(at, after)
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            symbol[at], symbol[gone] = made, -1
            after[at], before[follow] = follow, at
            ahead = before[at]
            add(np.concatenate([at, ahead[ahead >= 0]]))
        left = symbol[:n] >= 0
        kept = symbol[:n][left]
        stops = np.flatnonzero(kept == self.end)
        flat, out, start = kept.tolist(), [], 0
        for stop in stops.tolist():
            out.append(tuple(flat[start:stop]))
            start = stop + 1
        return out

    def add_pieces(self, pieces: Iterable[str]) -> None:
        new = [p for p in set(pieces) if p not in self.pieces]
        self.pieces.update(zip(new, self.merge([p.encode() for p in new])))

    def learn(self, wanted: Iterable[str], memory: dict[str, tuple[int, ...] | None], lead: str) -> None:
        """Put the ids of the ``wanted`` chunks that are new (each after ``lead``) into ``memory``."""
        cuts = {}
        for chunk in wanted:
            if chunk in memory:
                continue
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                memory[chunk] = None
            else:
                cuts[chunk] = self.cut.findall(lead + chunk)
        self.add_pieces(chain.from_iterable(cuts.values()))
        known = self.pieces
        for chunk, parts in cuts.items():
            memory[chunk] = known[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(known.__getitem__, parts)))

    def whole(self, text: str) -> tuple[int, ...]:
        """Ids of one text, cut by special tokens and the pattern alone."""
        ids: list[int] = []
        for k, part in enumerate(self.split.split(text) if self.split is not None else [text]):
            if k % 2:
                ids.append(self.special[part])
            else:
                pieces = self.cut.findall(part)
                self.add_pieces(pieces)
                ids.extend(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
        return tuple(ids)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text (null: none).

        Single spaces are borders of pieces unless white space is beside them, so texts are cut there and each
        distinct chunk is looked up once. Texts with other spaces or special tokens are cut by the pattern.
        """
        for memory in (self.heads, self.chunks, self.pieces):
            if len(memory) > REMEMBERED:
                memory.clear()
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        odd = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        borders = lists.offsets.to_numpy().astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        borders = borders - borders[0]
        first = borders[:-1]
        chunks = coded.dictionary.to_pylist()
        self.learn(chunks, self.chunks, " ")
        heads = [chunks[c] for c in codes[first].tolist()]
        self.learn(heads, self.heads, "")
        found = [self.chunks[c] for c in chunks]
        odd |= np.logical_or.reduceat(np.array([x is None for x in found])[codes], first)
        alone = [self.whole(texts[k].as_py()) if o else self.heads[h] for k, (o, h) in enumerate(zip(odd.tolist(), heads))]
        found = [x or () for x in found] + [x or () for x in alone] + [()]
        codes[np.repeat(odd, np.diff(borders))] = len(found) - 1
        codes[first] = len(chunks) + np.arange(len(texts))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[borders]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gather(flat, np.cumsum(sizes) - sizes, sizes, codes), pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids (null: null); bytes that aren't UTF-8 become the replacement character."""
        flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        data = gather(self.bytes, self.starts, self.sizes, flat)
        ends = np.concatenate([[0], np.cumsum(self.sizes[flat])])[np.concatenate([[0], np.cumsum(counts)])]
        made = pa.StringArray.from_buffers(len(ids), pa.array(ends, pa.int32()).buffers()[1], pa.py_buffer(data.tobytes()))
        try:
            made.validate(full=True)
        except pa.ArrowInvalid:
            raw, at = data.tobytes(), ends.tolist()
            made = pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(at, at[1:])], pa.string())
        return pc.if_else(ids.is_valid(), made, None) if ids.null_count else made


def leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping pairs of one symbol, those that a scan from the left takes."""
    taken, free = [], -1
    follow = after[at].tolist()
    for i, j in zip(at.tolist(), follow):
        if i != free:
            taken.append(i)
            free = j
    return np.array(taken, dtype=np.int64)


_CODERS: dict[str, PairIndexCoder] = {}


def coder(path: str) -> PairIndexCoder:
    """The coder of this Python worker for a tokenizer file."""
    if path not in _CODERS:
        _CODERS[path] = PairIndexCoder(path)
    return _CODERS[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of whole texts as an array of int."""

    def make():
        own = coder(path)
        return lambda texts: [own.encode(texts)]

    return add_columns(df, [field(ids, T.ArrayType(T.IntegerType()))], make, text, SLICE)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the token ids and the text that they decode to, in one pass over the rows."""

    def make():
        own = coder(path)

        def compute(texts):
            found = own.encode(texts)
            return [found, own.decode(found)]

        return compute

    return add_columns(df, [field(ids, T.ArrayType(T.IntegerType())), field(decoded, T.StringType())], make, text, SLICE)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids; a null array gives null. An id that the vocabulary lacks is an error."""
    kept = [f.name for f in df.schema.fields if f.name != text]
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [field(text, T.StringType())])

    def run(batches):
        own = coder(path)
        for batch in batches:
            made = own.decode(batch.column(batch.schema.get_field_index(ids)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), made], names=[*kept, text])

    return df.mapInArrow(run, schema)

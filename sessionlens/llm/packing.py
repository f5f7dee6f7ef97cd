"""Order-preserving packing by dynamic programming (operator 5).

Documents keep their order (ascending ids) and are laid end to end as tokens. Cuts go to document ends (free), any
sentence end (a small penalty) or, only inside very long sentences, between words of a sentence (a larger one).
The best cuts minimise padding plus penalties: with x the position of a cut and f its least cost,
f(i) = x_i-penalty + min over j of f(j) + (window - (x_i - x_j)), a sliding minimum of f(j) + x_j that a monotone
queue gives in constant time; sequences whose length is a power of two need no padding, which adds one look-up per
power. The plan runs over stretches of ``STRETCH`` tokens: what the last sequences of a stretch hold goes into the
next, so memory is bounded and only the end of a partition can be short.

Ids are those of the tokenizers library. Where the file's rules are the known ones and all its tokens are whole
(checked as it is loaded), distinct chunks of characters that normalisation leaves alone get the same ids from a coder
that merges by rank, a slice at a time; all other chunks are encoded by the library and remembered.

One range exchange on the ids brings neighbours together; tokens are made, cut and digested in the same task and
never shuffled.

Cases: a null or empty text is one end token; null ids come first; repeated rows are packed each; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.bpe import byte_letters
from sessionlens.llm.common import gather, partitions, slices

WINDOW = 4096
STRETCH = 1 << 18
#: In tokens of padding: what a cut inside a document, and inside a sentence, counts.
SENTENCE_CUT, WORD_CUT = 8, 64
#: Cuts inside a sentence are offered at this distance.
WORD_STEP = 256
SLICE = 2 << 20
REMEMBERED = 400_000
#: Chunks that the library encodes in one call; its results are large while they live.
CALL = 4096
#: A letter, the marks that close its word, and the space after them (RE2).
CLOSING = r"(\pL)([.,!?;:|*#$%&]+) "
#: How the last chunk of a sentence ends, and where sentences end inside a chunk, in scripts that put no space there.
CLOSERS = """["'”’»)）」』】\\]]*"""
SENTENCE_END = "[.!?。！？｡।؟]" + CLOSERS + "$"
INNER_END = "[。！？｡।؟]" + CLOSERS
#: Chunks whose inner ends are remembered.
INNER_REMEMBERED = 20_000

#: What ``PlainCoder`` takes over from a tokenizer file: how texts are normalised, parted and closed.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
#: Characters that normalisation leaves as they are, alone and beside each other, capitals aside: printable ones of Latin,
#: letters of Greek, Cyrillic, kana, Han and Hangul, and their marks of punctuation.
PLAIN = r"^[!-~\x{a1}-\x{ac}\x{ae}-\x{24f}\x{3ac}-\x{3ce}\x{430}-\x{45f}\x{2010}-\x{2027}\x{2030}-\x{203a}\x{3001}-\x{3003}\x{3008}-\x{3011}\x{3041}-\x{3094}\x{30a1}-\x{30fa}\x{30fc}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}\x{ff01}-\x{ff0f}\x{ff1a}-\x{ff1f}]*$"
CAPITAL = r"[\p{Lu}\p{Lt}]"
#: Written after each word; it isn't printable, so no plain chunk holds it.
WORD_END = "\x01"


def whole(merges: list[tuple[int, int]], first: int) -> bool:
    """Whether every merged token comes about from its own letters; then any two neighbours that spell a token are its pair.

    Merge k joins a pair of ids into ``first + k``. A token fails if, before its two halves are whole, others meet on
    their border: the halves are taken apart from there, the latest merge first.
    """
    rank = {pair: first + k for k, pair in enumerate(merges)}
    for made, (x, y) in enumerate(merges, first):
        if max(x, y) >= made:
            return False
        until_x = until_y = made  # which merges end the tokens on both sides
        while max(x, y) >= first:
            if x > y:
                until_x, x = x, merges[x - first][1]
            else:
                until_y, y = y, merges[y - first][0]
            met = rank.get((x, y), made)
            if met < until_x and met <= until_y:  # of equal pairs the left one goes first
                return False
    return True


class PlainCoder:
    """Ids of many plain chunks in one call of a coder that merges by the rank of the token made.

    The end of a word is a byte of its own that the first ranks join to the byte before it.
    """

    def __init__(self, content: dict):
        import tiktoken

        vocab, letters = content["model"]["vocab"], byte_letters()
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b]) + WORD_END.encode(): 256 + b for b in range(256)}
        self.ids = np.zeros(1 + max(vocab.values()), dtype=np.uint32)
        for c, b in letters.items():
            self.ids[b], self.ids[256 + b] = vocab[c], vocab[c + SUFFIX]
        for a, b in content["model"]["merges"]:
            token = a + b
            self.ids[vocab[token]] = vocab[token]
            body, end = (token[: -len(SUFFIX)], WORD_END) if token.endswith(SUFFIX) else (token, "")
            ranks[bytes(letters[c] for c in body) + end.encode()] = vocab[token]
        self.closes = np.zeros(len(self.ids), dtype=bool)
        self.closes[[i for token, i in ranks.items() if token.endswith(WORD_END.encode())]] = True
        self.coder = tiktoken.Encoding("plain", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={})
        self.special = [t["content"] for t in content["added_tokens"]]

    @staticmethod
    def fits(content: dict) -> bool:
        """Whether the rules of a tokenizer file are those that this class follows, and its tokens are whole."""
        parts = (content.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = content["model"]
        if (
            (content.get("normalizer") or {}).get("normalizers") != NORMALIZER
            or [p["type"] for p in parts] != ["Split", "ByteLevel"]
            or [parts[0].get(k) for k in ("pattern", "behavior", "invert")] != [{"Regex": WORDS}, "Removed", True]
            or [parts[1].get(k) for k in ("add_prefix_space", "use_regex")] != [False, False]
            or [model.get(k) for k in ("type", "end_of_word_suffix")] != ["BPE", SUFFIX]
            or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix"))
            or not all(isinstance(m, list) for m in model["merges"])
        ):
            return False
        vocab, merges = model["vocab"], model["merges"]
        made = [vocab[a + b] for a, b in merges]
        letters = byte_letters()
        mark = next(c for c, b in letters.items() if b == ord(WORD_END))
        base = {*letters, *(c + SUFFIX for c in letters)}
        return (
            bool(made)
            and made == list(range(made[0], made[0] + len(made)))
            and made[0] >= len(base)
            and len(vocab.keys() & base) == len(base)
            and max(vocab[t] for t in base) < made[0]
            and not any(mark in a or mark in b or SUFFIX in a for a, b in merges)
            and whole([(vocab[a], vocab[b]) for a, b in merges], made[0])
        )

    def takes(self, chunks: pa.Array) -> np.ndarray:
        """Which chunks are plain."""
        plain = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring_regex(chunks, CAPITAL))
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(chunks, token))
        return plain.to_numpy(zero_copy_only=False)

    def encode(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and how many each has."""
        several = pc.invert(pc.match_substring_regex(chunks, r"^\pL+$"))
        parted = pc.replace_substring_regex(chunks.filter(several), f"({WORDS})", rf"\1{WORD_END}")
        words = pc.replace_with_mask(pc.binary_join_element_wise(chunks, WORD_END, ""), several, parted)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py()
        found = self.coder.encode_to_numpy(text, disallowed_special=())
        ends = np.append(0, np.flatnonzero(self.closes[found]) + 1)  # of words
        ends = ends[np.cumsum(pc.count_substring(words, WORD_END).to_numpy())]
        return self.ids[found], np.diff(ends, prepend=0)


class ChunkTokens:
    """Ids of the tokenizers library for a vocabulary that drops white space, remembered per chunk between spaces.

    Plain chunks are encoded together by ``PlainCoder``, if the file allows it.

    Texts are put in lower case and the marks that close a word are parted from it first. The library does both
    itself, so ids stay the same, but far fewer chunks differ.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.plain = PlainCoder(content) if PlainCoder.fits(content) else None
        # ids as bytes of unsigned 32-bit numbers: small, joined at once, and no object of its own for each id
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.inner: dict[str, list[int]] = {}

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk."""
        if len(self.known) > REMEMBERED:  # what was used since the last time stays
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = list(map(known.get, chunks))
        missing = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            ids = found[k] = before.get(chunks[k])
            if ids is None:
                missing.append(k)
            else:
                known[chunks[k]] = ids
        for at in range(0, len(missing), CALL):
            part = missing[at : at + CALL]
            new = [chunks[k] for k in part]
            coded = self.call(new)
            known.update(zip(new, coded))
            for k, ids in zip(part, coded):
                found[k] = ids
        return found

    def call(self, new: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)  # without offsets
        found = [c.ids for c in coded]
        ends = (4 * np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))).tolist()
        flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32).tobytes()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def ends_inside(self, chunk: str) -> list[int]:
        """Numbers of the tokens of a chunk after which a sentence ends, but for its last token."""
        if chunk not in self.inner:
            if len(self.inner) >= INNER_REMEMBERED:
                self.inner = {}
            ends = {m.end() for m in re.finditer(INNER_END, chunk)}
            until = [j for _, j in self.tokenizer.encode(chunk, add_special_tokens=False).offsets]
            # one character can be several tokens with the same end
            self.inner[chunk] = [k for k in range(len(until) - 1) if until[k] in ends and until[k + 1] > until[k]]
        return self.inner[chunk]

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        plain = pc.utf8_lower(texts)
        count = lambda part, token: pc.sum(pc.count_substring(part, token)).as_py()
        # the only letter whose lower case depends on who asks; special tokens must not come about
        if count(texts, "\u0130") or any(count(texts, t) != count(plain, t) for t in self.special):
            plain = texts
        return pc.split_pattern(pc.replace_substring_regex(plain, CLOSING, r"\1 \2 "), " ")

    def distinct(self, chunks: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks in any order, where those of each begin and how many there are; ``end`` is the last."""
        plain = self.plain.takes(chunks) if self.plain else np.zeros(len(chunks), dtype=bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain), [len(chunks)]])
        ids, counts = self.plain.encode(chunks.filter(pa.array(plain))) if plain.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        found = [*self.learn(chunks.filter(pa.array(~plain)).to_pylist()), np.uint32(end).tobytes()]
        sizes = np.empty(len(order), dtype=np.int64)
        sizes[order] = np.concatenate([counts, np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4])
        starts = np.empty_like(sizes)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([ids, np.frombuffer(b"".join(found), dtype=np.uint32)]), starts, sizes

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end``; the tokens of each text; 1 where a sentence ends after an id."""
        lists = self.chunks(texts)
        borders = lists.offsets.to_numpy().astype(np.int64)
        borders = borders - borders[0]
        coded = pc.list_flatten(lists).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        stop = np.append(pc.match_substring_regex(coded.dictionary, SENTENCE_END).to_numpy(zero_copy_only=False), True)
        flat, starts, sizes = self.distinct(coded.dictionary, end)
        codes = np.insert(codes, borders[1:], len(sizes) - 1)
        borders = borders + np.arange(len(borders))
        ends = np.cumsum(sizes[codes])
        ids = gather(flat, starts, sizes, codes)
        marks = np.zeros(len(ids), dtype=bool)
        marks[ends[stop[codes] & (sizes[codes] > 0)] - 1] = True
        several = np.flatnonzero(pc.match_substring_regex(coded.dictionary, INNER_END + ".").to_numpy(zero_copy_only=False))
        for k in several[np.isin(several, codes)].tolist():
            inside = np.array(self.ends_inside(coded.dictionary[k].as_py()), dtype=np.int64)
            starts = ends[codes == k] - sizes[k]
            marks[(starts[:, None] + inside).ravel()] = True
        return ids, np.diff(np.concatenate([[0], ends])[borders]), marks


_TOKENS: dict[str, ChunkTokens] = {}


def chunk_tokens(path: str) -> ChunkTokens:
    """The tokens of this Python worker for a tokenizer file."""
    if path not in _TOKENS:
        _TOKENS[path] = ChunkTokens(path)
    return _TOKENS[path]


def best_cuts(at: list[int], penalty: list[int], window: int) -> list[int]:
    """Ends of the sequences (indexes into ``at``, ascending) with the least padding plus penalties.

    ``at`` are the allowed cuts, ascending from 0, no two more than ``window`` apart; the last must be a cut.
    """
    exact: dict[int, list[int]] = {}  # cuts at a distance that needs no padding
    places = np.array(at)
    for p in [1 << k for k in range(window.bit_length()) if 1 << k < window]:
        found = np.searchsorted(places, places - p)
        for i in np.flatnonzero((places >= p) & (places[found] == places - p)).tolist():
            exact.setdefault(i, []).append(int(found[i]))
    cost, last = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f + x, index), ascending
    for i in range(1, len(at)):
        x = at[i]
        while at[queue[0][1]] < x - window:
            queue.popleft()
        key, j = queue[0]
        least = key + window - x
        for k in exact.get(i, ()):
            if cost[k] < least:
                least, j = cost[k], k
        least += penalty[i]
        cost[i], last[i] = least, j
        key = least + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    out, i = [], len(at) - 1
    while i:
        out.append(i)
        i = last[i]
    return out[::-1]


def allowed_cuts(sizes: np.ndarray, marks: np.ndarray, tail: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a stretch of documents may be cut, from 0, and the penalty of each.

    In the last ``tail`` tokens any position will do, so that they can fall into lengths that need no padding.
    """
    ends = np.cumsum(sizes)
    places = np.unique(np.concatenate([[0], ends, np.flatnonzero(marks) + 1]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > WORD_STEP)
    inner = [np.arange(places[k] + WORD_STEP, places[k + 1], WORD_STEP) for k in wide]
    inner.append(np.arange(max(0, ends[-1] - tail), ends[-1]))
    every = np.unique(np.concatenate([places, *inner]))
    penalty = np.full(len(every), WORD_CUT)
    penalty[np.searchsorted(every, places)] = SENTENCE_CUT
    penalty[np.searchsorted(every, np.concatenate([[0], ends]))] = 0
    return every, penalty


def packed(df: DataFrame, path: str, end: int = 2, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
           finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """Pieces with their tokens: doc_id, start, ids, doc_tokens, sequence_id, offset.

    ``finish`` maps each batch of pieces to what is wanted of it (of the given ``schema``) inside the task that made
    it, for users who need no token outside.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    rows = (
        df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .withColumn("_draw", F.rand(23))
        .repartitionByRange(partitions(df.sparkSession), F.col("doc_id").asc_nulls_first(), "_draw")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .select("doc_id", "text")
    )

    def run(batches):
        tokens = chunk_tokens(path)
        base, made = TaskContext.get().partitionId() << 32, 0
        # rows that aren't packed yet: (id, tokens before this stretch, tokens in it, tokens of the document)
        docs: list[tuple] = []
        ids, marks, waiting = [], [], 0

        def pack(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, ids, marks, made, waiting
            flat, mark = np.concatenate(ids), np.concatenate(marks)
            sizes = np.array([d[2] for d in docs], dtype=np.int64)
            at, penalty = allowed_cuts(sizes, mark, window if final else 0)
            cuts = np.array([at[i] for i in best_cuts(at.tolist(), penalty.tolist(), window)], dtype=np.int64)
            if not final and len(cuts) > 2:
                cuts = cuts[:-2]  # the last ones may do better with what follows
            elif not final:
                cuts = cuts[:0]
            stop = int(cuts[-1]) if len(cuts) else 0
            ends = np.cumsum(sizes)
            begins = ends - sizes
            done = int(np.searchsorted(begins, stop))  # documents that begin before the last cut
            borders = np.unique(np.concatenate([[0], cuts, ends[ends <= stop], begins[:done]]))
            borders = borders[borders <= stop]
            if len(borders) > 1:
                start, after = borders[:-1], borders[1:]
                doc = np.searchsorted(ends, start, side="right")
                sequence = np.searchsorted(cuts, start, side="right")
                heads = np.concatenate([[0], cuts])[sequence]
                lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(flat[:stop].astype(np.int32)))
                pieces = pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[k][0] for k in doc.tolist()]).cast(id_type),
                        pa.array(start - begins[doc] + np.array([d[1] for d in docs], dtype=np.int64)[doc]),
                        lists,
                        pa.array(np.array([d[3] for d in docs], dtype=np.int64)[doc]),
                        pa.array(base + made + sequence.astype(np.int64)),
                        pa.array(start - heads),
                    ],
                    names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"],
                )
                yield finish(pieces) if finish else pieces
            made += len(cuts)
            first = int(np.searchsorted(ends, stop, side="right"))  # the first document with tokens after the last cut
            rest = []
            for k in range(first, len(docs)):
                i, before, n, total = docs[k]
                gone = max(0, stop - int(begins[k]))
                rest.append((i, before + gone, n - gone, total))
            docs, ids, marks, waiting = rest, [flat[stop:]], [mark[stop:]], len(flat) - stop

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for piece in slices(batch, 1, SLICE):
                flat, sizes, mark = tokens.encode(piece.column(1), end)
                taken = 0
                for i, n in zip(piece.column(0).to_pylist(), sizes.tolist()):
                    for begin in range(0, n, STRETCH):  # a very long document joins stretch by stretch
                        size = min(STRETCH, n - begin)
                        docs.append((i, begin, size, n))
                        ids.append(flat[taken : taken + size])
                        marks.append(mark[taken : taken + size])
                        taken += size
                        waiting += size
                        if waiting >= STRETCH:
                            yield from pack(False)
        if docs:
            yield from pack(True)

    return rows.mapInArrow(run, schema or f"doc_id {kind}, start long, ids array<int>, doc_tokens long, sequence_id long, offset long")

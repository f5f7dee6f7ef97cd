"""Spelling variants by finite-state composition (operator 12).

The vocabulary is a minimised acceptor; composed with a transducer of exactly one inserted, deleted or replaced code
point and with itself, it accepts the pairs of near words. The composition is parted by the state that a prefix
leads to, so that no task holds more than one part of it:

* words that share a prefix of 0, 3, 6, ... code points stand in one part. At most ``PART`` words: their tails are minimised
  and composed whole.
* A larger part is cut: an edit in the next three code points leaves what follows equal, so those pairs are the accepted
  pairs of the short acceptors of three code points (or of two, shifted by the edit) that end in the same rest; an edit
  further on is found in the parts of the longer prefixes. A short acceptor holds at most the strings of three letters.

Of a pair the edit's place is that of the first difference, so it is accepted once. Per part and word only a count and the best
partner leave; all parts of a word are then aggregated. Forms lead to words of five times the count, so chains are short; they
are followed by doubling.

Cases: a null text has no words; a null id counts as an empty one; repeated rows count each; ties go to the smaller word
in code-point order; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import partitions
from sessionlens.session import stage

#: Least length and number of occurrences of a word, and how many times a form is as frequent as its variants.
LENGTH, OCCURS, RATIO = 6, 5, 5
#: Code points that a longer prefix adds, and words of a part that is composed whole.
STEP, PART = 3, 4096
#: Distinct words that a task holds before it passes counts on.
HELD = 500_000
#: Of the pairs of document and run, one in so many loses a code point.
DAMAGED = 199
RUN = f"[A-Za-zÀ-ÿ]{{{LENGTH},}}"


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """(word, n): words of ``LENGTH`` code points or more, with their occurrences in all texts.

    A word is a run of letters with A-Z in lower case. Where ``damaged`` divides the crc32 of ``<doc_id>:<run>``, the run loses
    the code point at that crc32 modulo its length (0: no run does).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, crc32, counts = re.compile(RUN).findall, zlib.crc32, Counter()
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = find(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if t else []
                counts.update(words)
                start = crc32(f"{key or ''}:".encode())
                hit = [w for w in set(words) if not crc32(w.encode(), start) % damaged] if damaged else ()
                for w in hit:
                    n, k = words.count(w), crc32(w.encode(), start) % len(w)
                    counts[w] -= n
                    if len(w) > LENGTH:
                        counts[w[:k] + w[k + 1 :]] += n
                if len(counts) > HELD:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    def rows(counts):
        some = [(w, n) for w, n in counts.items() if n]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

    found = df.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acyclic acceptor of distinct strings in ascending order; state 0 is what follows a whole string alone."""

    def __init__(self, strings: list[str]):
        #: Of each state: where its symbols lead, and whether a string may end there. Targets have smaller numbers.
        self.next: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        # the states on the path of the last string, root first, that may still grow
        path: list[tuple[str, dict[str, int], bool]] = [("", {}, False)]

        def close(down_to: int) -> None:
            while len(path) > down_to:
                symbol, to, final = path.pop()
                key = (final, *to.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.next)
                    self.next.append(to)
                    self.final.append(final)
                if path:
                    path[-1][1][symbol] = state
                else:
                    self.root = state

        last = ""
        for s in strings:
            k = 0
            for a, b in zip(s, last):
                if a != b:
                    break
                k += 1
            close(k + 1)
            path.extend((c, {}, False) for c in s[k:])
            path[-1] = (*path[-1][:2], True)
            last = s
        close(0)

    def language(self, state: int) -> list[str]:
        """All strings that lead from a state to an end."""
        out, todo = [], [(state, "")]
        while todo:
            at, s = todo.pop()
            if self.final[at]:
                out.append(s)
            todo.extend((to, s + c) for c, to in self.next[at].items())
        return out

    def common(self, a: int, b: int, begin: str | None = None) -> list[str]:
        """All strings that lead from both states to an end; none that begins with ``begin``."""
        out, todo = [], [(a, b, "")]
        while todo:
            a, b, s = todo.pop()
            if begin is not None:
                to_a, to_b, out = self.next[a], self.next[b], [""] if self.final[a] and self.final[b] else []
                todo = [(to_a[c], to_b[c], c) for c in to_a if c != begin and c in to_b]
                begin = None
                continue
            if a == b:
                out.extend(s + x for x in self.language(a))
                continue
            if self.final[a] and self.final[b]:
                out.append(s)
            of_b = self.next[b]
            todo.extend((to, of_b[c], s + c) for c, to in self.next[a].items() if c in of_b)
        return out

    def edits_at(self, state: int, follows: str) -> list[tuple[str, str]]:
        """Pairs of strings from a state that differ by one edit in their first symbol; ``follows`` comes after them."""
        out, symbols = [], list(self.next[state].items())
        for i, (c, to) in enumerate(symbols):
            for d, other in symbols[:i]:
                out.extend((c + s, d + s) for s in self.common(to, other))
            # c deleted; if the same symbol follows, the first difference is further on
            out.extend((c + s, s) for s in self.common(to, state, c) if s or follows[:1] != c)
        return out

    def one_edit(self, follows: str = "") -> Iterator[tuple[str, str]]:
        """The pairs that the composition with the one-edit transducer and with itself accepts; each once."""
        edits = [self.edits_at(k, follows) for k in range(len(self.next))]
        useful = []
        for k, to in enumerate(self.next):
            useful.append(bool(edits[k]) or any(useful[t] for t in to.values()))
        todo = [(self.root, "")]
        while todo:
            state, s = todo.pop()
            for x, y in edits[state]:
                yield s + x, s + y
            todo.extend((to, s + c) for c, to in self.next[state].items() if useful[to])


PART_ROWS = "head string, tail string, local string, n long, whole boolean"
NEAR = "word string, n long, n_near long, form_n long, form string"


def parts(vocabulary: DataFrame) -> DataFrame:
    """Every word in each part that it belongs to: ``head`` + ``local`` + ``tail``; not ``whole``: shifted by one."""
    open_words, out, depth = vocabulary.select("word", "n"), [], 0
    while True:
        headed = open_words.withColumn("head", F.substring("word", 1, depth))
        large = stage(headed.groupBy("head").agg(F.count("*").alias("size")).where(F.col("size") > PART).select("head"), "large-parts")
        rest = F.substring(F.col("word"), depth + 1, 1 << 30)
        local = F.expr(f"substring(word, {depth + 1}, {STEP})")
        tail = lambda at: F.expr(f"substring(word, {depth + at + 1})")
        small = headed.join(large, "head", "left_anti")
        out.append(small.select("head", F.lit("").alias("tail"), rest.alias("local"), "n", F.lit(True).alias("whole")))
        if large.isEmpty():
            break
        open_words = stage(headed.join(large, "head", "left_semi"), "open-words")
        out.append(open_words.select("head", tail(STEP).alias("tail"), local.alias("local"), "n", F.lit(True).alias("whole")))
        shifted = open_words.where(F.length("word") >= depth + STEP)
        out.append(shifted.select("head", tail(STEP - 1).alias("tail"), F.substring(local, 1, STEP - 1).alias("local"), "n", F.lit(False).alias("whole")))
        open_words, depth = open_words.select("word", "n"), depth + STEP
    return reduce(DataFrame.unionByName, out)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, form_n, form) per part in which a word has near words: how many, and the most frequent one."""
    dealt = parts(vocabulary).repartition(partitions(vocabulary.sparkSession), "head", "tail").sortWithinPartitions("head", "tail", "local")

    def run(batches):
        found: list[tuple] = []
        for head, tail, members in groups(batches):
            if len(members) < 2:
                continue
            own = {local: (n, whole) for local, n, whole in members}
            best: dict[str, list] = {}
            for x, y in Acceptor([m[0] for m in members]).one_edit(tail):
                if not (own[x][1] or own[y][1]):
                    continue  # found where the rest is shorter by one
                for a, b in ((x, y), (y, x)):
                    n = own[b][0]
                    state = best.get(a)
                    if state is None:
                        best[a] = [1, n, b]
                    else:
                        state[0] += 1
                        if n > state[1] or (n == state[1] and b + tail < state[2] + tail):
                            state[1:] = n, b
            found.extend((head + a + tail, own[a][0], k, n, head + b + tail) for a, (k, n, b) in best.items())
            if len(found) > 20_000:
                yield rows(found)
                found = []
        if found:
            yield rows(found)

    def groups(batches):
        key, members = None, []
        for batch in batches:
            for head, tail, local, n, whole in zip(*(c.to_pylist() for c in batch.columns)):
                if (head, tail) != key:
                    if members:
                        yield *key, members
                    key, members = (head, tail), []
                members.append((local, n, whole))
        if members:
            yield *key, members

    def rows(found):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["word", "n", "n_near", "form_n", "form"])

    return dealt.mapInArrow(run, NEAR)


def variants(vocabulary: DataFrame) -> DataFrame:
    """(word, form, n, n_near, form_n) of every word of a (word, n) table of distinct words."""
    none = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    best = F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form"))
    near = none.unionByName(near_words(vocabulary)).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
    enough = -F.col("best.m") >= RATIO * F.col("n")
    return near.select("word", F.when(enough, F.col("best.form")).alias("form"), "n", "n_near", F.when(enough, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: the last one that the forms lead to."""
    links = stage(formed.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stage(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def spelling_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", damaged: int = 0) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word with ``OCCURS`` occurrences or more."""
    vocabulary = stage(word_counts(df, doc_id, text, damaged).where(F.col("n") >= OCCURS), "vocabulary")
    formed = stage(variants(vocabulary), "variants")
    rooted = formed.join(roots(formed), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

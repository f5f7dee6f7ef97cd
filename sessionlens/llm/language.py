"""Language identification by bit-sliced n-gram filters (operator 10).

Letter trigrams (with word borders) that are typical of a language are put into Bloom filters of all languages at
once: a slot holds one bit per language, so looking up a trigram gives the mask of all languages that may contain
it. A text's counts per language are the population counts of its trigrams' masks, corrected for the share of
false positives that each language's own fill implies; the largest corrected share decides.

Learning reads a sample of about ``PER_LANGUAGE`` texts for each language; what the driver gets is the filter alone,
whose size is fixed by ``SLOTS``.

Cases: a null text, or one without a letter, is ``und`` with score 0; if nothing was learned every text is ``und``;
ties go to the language that sorts first; a text none of whose trigrams is known goes to the most frequent language
with score 0; repeated rows agree; an empty table gives an empty result; columns named like the output are replaced,
others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.common import add_columns, characters, code_points, field, mix

SLOTS = 1 << 18
HASHES = 2
#: Texts per language that are learned from (about).
PER_LANGUAGE = 4000
#: A trigram belongs to the languages that use it at least half as often as the one that uses it most.
TYPICAL = 0.5
LEAST_COUNT = 3


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all trigrams around letters, the borders of each text among them, and the letters of each text."""
    points, starts = code_points(texts)
    letter = characters("alpha")[points]
    low = np.where(letter, characters("lower")[points], 0).astype(np.uint64)
    before, after = np.zeros_like(low), np.zeros_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    inner = starts[(starts > 0) & (starts < len(points))]
    before[inner], after[inner - 1] = 0, 0
    codes = (before << np.uint64(42)) | (low << np.uint64(21)) | after
    upto = np.concatenate([[0], np.cumsum(letter)])
    return codes[letter], upto[starts], np.diff(upto[starts])


def slots_of(codes: np.ndarray) -> list[np.ndarray]:
    offsets = [np.uint64((1 + k) * 0x9E3779B97F4A7C15 % 2**64) for k in range(HASHES)]
    return [(mix(codes + offset) % np.uint64(SLOTS)).astype(np.int64) for offset in offsets]


class Filters:
    """The filters of all languages; ``words`` has one row of 64-bit masks per 64 languages."""

    def __init__(self, languages: list[str], words: np.ndarray, usual: str | None):
        self.languages, self.words, self.usual = languages, words, usual
        fill = np.array([((words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false = fill**HASHES

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each language in each text, and the letters of each text."""
        codes, borders, letters = trigrams(texts)
        at = slots_of(codes)
        out = np.zeros((len(texts), len(self.languages)))
        for w, filters in enumerate(self.words):
            mask = filters[at[0]]
            for more in at[1:]:
                mask = mask & filters[more]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1))])
                out[:, i] = np.diff(hits[borders])
        share = out / np.maximum(letters, 1)[:, None]
        return np.clip((share - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1), letters

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [t or "" for t in texts]
        if not self.languages:
            return ["und"] * len(found), np.zeros(len(found))
        shares, letters = self.shares(found)
        total = shares.sum(axis=1)
        best = shares.argmax(axis=1)
        names = [("und" if not n else self.languages[b] if s else self.usual) for n, b, s in zip(letters.tolist(), best.tolist(), total.tolist())]
        return names, np.where(letters > 0, shares.max(axis=1) / np.maximum(total, 1e-12), 0.0)


def fit(df: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Filters:
    """Filters from the rows that ``usable`` allows and whose text and language are known."""
    known = df.where(usable).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row per language
    languages = sorted(counts)
    if not languages:
        return Filters([], np.zeros((0, SLOTS), dtype=np.uint64), None)
    number = F.create_map(*(F.lit(x) for i, name in enumerate(languages) for x in (name, i)))
    chance = F.create_map(*(F.lit(x) for name in languages for x in (name, int(min(1.0, per_language / counts[name]) * 1_000_000))))
    sample = known.where(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < chance[F.col(lang)]).select(number[F.col(lang)].alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_numpy()
            codes, borders, letters = trigrams(batch.column(1).to_pylist())
            for i in np.unique(langs):
                grams, n = np.unique(codes[np.repeat(langs == i, letters)], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(grams), i), pa.int32()), "gram": grams.view(np.int64), "n": n.astype(np.int64)})

    grams = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = F.broadcast(grams.groupBy("lang").agg(F.sum("n").alias("all")))  # one row per language
    of_gram = grams.where(F.col("n") >= LEAST_COUNT).join(totals, "lang").groupBy("gram").agg(F.collect_list(F.struct("lang", (F.col("n") / F.col("all")).alias("p"))).alias("langs"))
    typical = of_gram.select("gram", F.explode(F.expr(f"filter(langs, x -> x.p >= {TYPICAL} * array_max(langs.p)).lang")).alias("lang"))

    def bits(batches):
        for batch in batches:
            gram, i = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            mask = (np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64)
            for at in slots_of(gram):
                yield pa.RecordBatch.from_pydict({"word": pa.array(i // 64, pa.int32()), "slot": at, "mask": mask})

    filled = typical.mapInArrow(bits, "word int, slot long, mask long").groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    words = np.zeros((-(-len(languages) // 64), SLOTS), dtype=np.uint64)
    words[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    return Filters(languages, words, max(languages, key=lambda x: (counts[x], x)))


def identify(df: DataFrame, filters: Filters, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language of each whole text and how far it stands out (0 to 1)."""
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def make():
        own = shared.value

        def compute(texts):
            names, scores = own.decide(texts.to_pylist())
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return compute

    return add_columns(df, [field(name, T.StringType()), field(score, T.DoubleType())], make, text)

"""Quality classifier: a generalised additive model with pairwise interactions (operator 4).

The score of a text is a sum of look-up tables, one per feature and one per chosen pair of features, through a
logistic link. Tables are learned by cyclic boosting: round after round every feature in turn gets a shallow tree
over its bins, fitted to the current residuals and shrunk; then the pairs with the largest remaining gain get trees
over two features in the same way. Scoring looks up bins and adds.

Features come from the text alone. The fit takes at most ``SAMPLE`` labelled rows (the first by hash of the id);
scoring covers every row.

Cases: a null text counts as empty and gets a score too; without labels the score is 0.5, with labels of one class
only it is that class's smoothed share; repeated rows agree; an empty table gives an empty result; columns named
like the output are replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field as member

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.common import add_columns, characters, code_points, field

#: Labelled rows of the fit, at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, CALM = 200, 60, 0.1, 1.0
FEATURES = [
    "words", "word_length", "lines", "line_words", "upper", "digits", "spaces", "symbols", "bangs", "pipes", "marks",
    "distinct_words", "distinct_pairs", "adjacent", "distinct_lines",
]
MARKS = np.array([ord(c) for c in "#$%&*"], dtype=np.uint32)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    found = [t or "" for t in texts]
    points, starts = code_points(found)
    upper, digit, space, alpha = (characters(k)[points] for k in ("upper", "digit", "space", "alpha"))

    def per_text(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[starts]).astype(np.float64)

    chars, letters = np.diff(starts).astype(np.float64), per_text(alpha)
    counted = []
    for t in found:
        words, lines = t.split(), [x for x in t.split("\n") if x]
        n = len(words)
        counted.append((
            n, sum(map(len, words)), len(lines), len(set(words)), len(set(zip(words, words[1:]))),
            sum(map(str.__eq__, words, words[1:])), len(set(lines)),
        ))
    n, length, lines, distinct, pairs, adjacent, distinct_lines = np.array(counted, dtype=np.float64).reshape(-1, 7).T
    over = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([
        np.log1p(n), over(length, n), np.log1p(lines), over(n, lines), over(per_text(upper), letters), over(per_text(digit), chars),
        over(per_text(space), chars), over(per_text(~(alpha | digit | space)), chars), over(per_text(points == ord("!")), n),
        over(per_text(points == ord("|")), n), over(per_text(np.isin(points, MARKS)), n), over(distinct, n),
        over(pairs, n - 1), over(adjacent, n), over(distinct_lines, lines),
    ])


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = member(default_factory=list)
    tables: list[np.ndarray] = member(default_factory=list)
    pairs: list[tuple[int, int]] = member(default_factory=list)
    coarse: list[np.ndarray] = member(default_factory=list)
    pair_tables: list[np.ndarray] = member(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of feature rows: bins of all rows at once, then table look-ups added up."""
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        bins = {k: np.searchsorted(self.coarse[k], x[:, k], side="right") for pair in self.pairs for k in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders between about ``bins`` equally filled bins, midway between values that occur."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.array([])
    wanted = np.quantile(values, np.arange(1, bins) / bins, method="nearest")
    at = np.unique(np.clip(np.searchsorted(distinct, wanted), 1, len(distinct) - 1))
    return (distinct[at - 1] + distinct[at]) / 2


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins in two; place 0 if there is none. Works along the last axis."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + CALM) + right_g**2 / (right_h + CALM) - g.sum() ** 2 / (h.sum() + CALM)
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values per bin of a tree of ``depth`` levels over ordered bins, by gradients and their weights."""
    gain, cut = best_cut(g, h) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + CALM))
    return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values per cell of a tree that cuts one feature and then, in either part, the other."""
    best, values = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            parts = [(a[:cut].sum(axis=0), b[:cut].sum(axis=0)), (a[cut:].sum(axis=0), b[cut:].sum(axis=0))]
            gain = sum(best_cut(*p)[0] for p in parts)
            if gain > best:
                top, low = (shallow_tree(*p, depth=1) for p in parts)
                found = np.vstack([np.tile(top, (cut, 1)), np.tile(low, (len(a) - cut, 1))])
                best, values = gain, found.T if turned else found
    return best, values


def fit_model(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model of feature rows ``x`` and labels ``y`` (0 or 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(intercept=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    width = x.shape[1]
    model.edges = [cut_points(x[:, k], BINS) for k in range(width)]
    model.coarse = [cut_points(x[:, k], PAIR_BINS) for k in range(width)]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = residuals()
            n = len(model.tables[k])
            step = RATE * shallow_tree(np.bincount(bins[k], g, n), np.bincount(bins[k], h, n))
            model.tables[k] += step
            total += step[bins[k]]

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = residuals()
        rows, cols = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        at = coarse[a] * cols + coarse[b]
        return tuple(np.bincount(at, v, rows * cols).reshape(rows, cols) for v in (g, h))

    gains = {(a, b): pair_tree(*cells(a, b))[0] for a in range(width) for b in range(a + 1, width)}
    model.pairs = sorted((p for p in gains if gains[p] > 0), key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            step = RATE * pair_tree(*cells(a, b))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE, text: str = "text", label: str = "quality", doc_id: str = "doc_id") -> AdditiveModel:
    """The model of the labelled texts; ``usable`` says over ``doc_id`` which labels may be learned from."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.select(F.col(doc_id).alias("doc_id"), (F.col(label) > 0).cast("int").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample))  # at most ``sample`` narrow rows
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id")

    def make():
        def compute(texts):
            x = features(texts.to_pylist())
            return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))]

        return compute

    measured = add_columns(rows, [field("x", T.ArrayType(T.DoubleType()))], make).select("doc_id", "y", "x")
    found = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.hash("x")).limit(sample).toArrow()
    y = found["y"].to_numpy().astype(np.float64)
    x = np.array(found["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_model(x, y)


def classify(df: DataFrame, model: AdditiveModel, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds the score (0 to 1, higher is better) and the class (1 from 0.5)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def compute(texts):
            found = own.scores(features(texts.to_pylist()))
            return [pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32), pa.int32())]

        return compute

    return add_columns(df, [field(score, T.DoubleType()), field(predicted, T.IntegerType())], make, text)

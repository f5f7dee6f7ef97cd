"""Cascade rules, evaluation and importance summaries on probability tables."""

from pyspark.sql import functions as F

from catalog.registry import big, ctes, num, query
from catalog.sampling import PROBS
from catalog.shapes import Shapes
from sessionlens.functions.scalars import argmax
from sessionlens.operators import cascade, evaluation
from sessionlens.session import stage

_P, _E = ["p0", "p1", "p2", "p3"], ["e0", "e1", "e2"]


def cols(names):
    return [F.col(n) for n in names]


def largest(names: list[str]) -> str:
    """Index of the first largest column."""
    top = f"greatest({', '.join(names)})"
    return "CASE " + " ".join(f"WHEN {n} = {top} THEN {i}" for i, n in enumerate(names)) + " END"


FIRST = f"first AS (SELECT *, {largest(_P)} AS pred FROM pr)"


def first(s: Shapes):
    """Probabilities with the tier-one call."""
    return s.probabilities().withColumn("pred", argmax(F.array(*cols(_P))))


def rule_sql(expr: str) -> str:
    return ctes(PROBS, FIRST) + f" SELECT id, {big('y', 'y')}, {big(expr, 'final')} FROM first"


def ruled(s: Shapes, rule):
    return first(s).select("id", "y", rule.alias("final"))


@query("argmax", rule_sql("pred"))
def argmax_rows(s: Shapes):
    return ruled(s, F.col("pred"))


@query("cascade_gate_argmax", rule_sql(f"CASE WHEN q >= 0.05 THEN {largest(_E)} + 1 ELSE 0 END"))
def cascade_gate_argmax(s: Shapes):
    return ruled(s, cascade.gate_argmax(F.col("q"), cols(_E)))


def _release(t: float) -> str:
    return f"CASE WHEN q >= 0.3 THEN CASE WHEN p0 >= {t} THEN 0 ELSE {largest(_P[1:])} + 1 END ELSE 0 END"


@query("cascade_release", ctes(PROBS) + f" SELECT id, {big('y', 'y')}, {big(_release(0.9), 'at_90')}, {big(_release(0.5), 'at_50')} FROM pr")
def cascade_release(s: Shapes):
    made = {n: cascade.release(F.col("q"), cols(_P), 0.3, t) for n, t in (("at_90", 0.9), ("at_50", 0.5))}
    return s.probabilities().select("id", "y", *[c.alias(n) for n, c in made.items()])


@query("cascade_salvage_override", rule_sql(
    f"CASE WHEN pred = 0 THEN CASE WHEN x3 > 0.15 THEN 3 WHEN x2 > 0.18 THEN 2 ELSE {largest(['x0', 'x1', 'x2', 'x3'])} END ELSE pred END")
    .replace("FROM first", "FROM (SELECT *, p3 AS x0, p2 AS x1, p1 AS x2, p0 AS x3 FROM first)"))
def cascade_salvage_override(s: Shapes):
    """The expert's four probabilities are the first tier's in reverse order."""
    return ruled(s, cascade.salvage_override(F.col("pred"), cols(_P[::-1])))


@query("cascade_salvage_contest", rule_sql(
    "CASE WHEN pred = 0 THEN CASE WHEN e1 >= 0.3 AND e2 >= 0.25 THEN CASE WHEN e1 > e2 THEN 2 ELSE 3 END "
    "WHEN e1 >= 0.3 THEN 2 WHEN e2 >= 0.25 THEN 3 ELSE 0 END ELSE pred END"))
def cascade_salvage_contest(s: Shapes):
    return ruled(s, cascade.salvage_contest(F.col("pred"), F.col("e1"), F.col("e2"), 0.3, 0.25))


@query("cascade_salvage_binary", ctes(PROBS, FIRST) + f" SELECT id, {big('y', 'y')}, " + ", ".join(
    big(f"CASE WHEN pred = 0 AND q >= {t} THEN 2 ELSE pred END", f"at_{int(t * 100)}") for t in cascade.SALVAGE_BINARY_THRESHOLDS) + " FROM first")
def cascade_salvage_binary(s: Shapes):
    made = {f"at_{int(t * 100)}": cascade.salvage_binary(F.col("pred"), F.col("q"), t) for t in cascade.SALVAGE_BINARY_THRESHOLDS}
    return first(s).select("id", "y", *[c.alias(n) for n, c in made.items()])


@query("cascade_salvage_max", rule_sql(
    "CASE WHEN pred = 0 THEN CASE WHEN greatest(e1, e2) >= 0.4 THEN CASE WHEN e1 >= e2 THEN 2 ELSE 3 END ELSE 0 END ELSE pred END"))
def cascade_salvage_max(s: Shapes):
    return ruled(s, cascade.salvage_max(F.col("pred"), F.col("e1"), F.col("e2"), 0.4))


@query("cascade_salvage_ordered", rule_sql(
    "CASE WHEN pred = 0 THEN CASE WHEN e1 >= 0.4 THEN 2 WHEN e2 >= 0.2 THEN 3 ELSE 0 END ELSE pred END"))
def cascade_salvage_ordered(s: Shapes):
    return ruled(s, cascade.salvage_ordered(F.col("pred"), F.col("e1"), F.col("e2"), 0.4, 0.2))


_pass = {1: "CASE WHEN p1 >= 0.3 THEN p1 ELSE -1 END", 2: "CASE WHEN p2 >= 0.2 THEN p2 ELSE -1 END", 3: "CASE WHEN p3 >= 0.25 THEN p3 ELSE -1 END"}
_best = f"greatest({', '.join(_pass.values())})"


@query("per_class_threshold", rule_sql(
    f"CASE WHEN {_best} < 0 THEN 0 WHEN {_pass[1]} = {_best} THEN 1 WHEN {_pass[2]} = {_best} THEN 2 ELSE 3 END"))
def per_class_threshold(s: Shapes):
    return ruled(s, cascade.per_class(cols(_P), {1: 0.3, 2: 0.2, 3: 0.25}))


@query("salvage_counts", ctes(PROBS, FIRST, "f AS (SELECT pred, CASE WHEN pred = 0 AND q >= 0.25 THEN 2 ELSE pred END AS final FROM first)")
       + f" SELECT {big('final', 'final')}, {big('count(*)', 'n')} FROM f WHERE pred <> final GROUP BY final")
def salvage_counts(s: Shapes):
    done = first(s).withColumn("final", cascade.salvage_binary(F.col("pred"), F.col("q"), 0.25))
    return cascade.salvage_counts(done, "pred", "final")


GRID = """grid AS (SELECT i / 100.0 AS threshold, sum(CASE WHEN y > 0 AND q >= i / CAST(100 AS DOUBLE) THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y = 0 AND q >= i / CAST(100 AS DOUBLE) THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS p,
  sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n FROM pr, range(1, 100) t(i) GROUP BY i)"""


@query("threshold_sweep", ctes(PROBS, GRID) + f""" SELECT {num('threshold', 'threshold')}, {big('tp', 'tp')}, {big('fp', 'fp')},
  {num('tp / CAST(p AS DOUBLE)', 'recall')}, {num('fp / CAST(n AS DOUBLE)', 'fpr')} FROM grid""")
def threshold_sweep(s: Shapes):
    return cascade.threshold_counts(s.probabilities(), "y", "q")


def _gate(t: float, clamp: bool) -> str:
    best = f"coalesce((SELECT max(threshold) FROM grid WHERE tp / CAST(p AS DOUBLE) >= {t}), 0.01)"
    return f"CASE WHEN {best} > 0.2 THEN 0.15 ELSE {best} END" if clamp else best


@query("gate_thresholds", ctes(PROBS, GRID) + " UNION ALL ".join(
    f" SELECT {num(str(t), 'target')}, {num(_gate(t, False), 'threshold')}, {num(_gate(t, True), 'clamped')}" for t in cascade.GATE_RECALL_TARGETS))
def gate_thresholds(s: Shapes):
    """The gate threshold for every known recall target, as found and clamped."""
    counts = stage(cascade.threshold_counts(s.probabilities(), "y", "q"), "sweep")
    rows = None
    for t in cascade.GATE_RECALL_TARGETS:
        clamped = cascade.gate_threshold(counts, t, clamp=True).select(F.col("threshold").alias("clamped"))
        row = cascade.gate_threshold(counts, t).select(F.lit(t).alias("target"), "threshold").withColumn("clamped", clamped.scalar())
        rows = row if rows is None else rows.unionByName(row)
    return rows


MATRIX = f"""calls AS (SELECT y AS actual, pred AS predicted FROM first),
matrix AS (SELECT actual, predicted, count(*) AS n FROM calls GROUP BY actual, predicted)"""


def report_sql(rows: str = "calls") -> str:
    return f"""classes AS (SELECT actual AS c FROM {rows} UNION SELECT predicted FROM {rows}),
scored AS (SELECT c, (SELECT count(*) FROM {rows} WHERE actual = c) AS support, (SELECT count(*) FROM {rows} WHERE predicted = c) AS called,
  (SELECT count(*) FROM {rows} WHERE actual = c AND predicted = c) AS hit FROM classes),
rated AS (SELECT CAST(c AS VARCHAR) AS name, CASE WHEN called = 0 THEN 0 ELSE hit / CAST(called AS DOUBLE) END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE hit / CAST(support AS DOUBLE) END AS recall,
  CASE WHEN support + called = 0 THEN 0 ELSE 2 * hit / CAST(support + called AS DOUBLE) END AS f1, support, hit FROM scored),
report AS (SELECT name, precision, recall, f1, support FROM rated
  UNION ALL SELECT 'accuracy', sum(hit) / CAST(sum(support) AS DOUBLE), sum(hit) / CAST(sum(support) AS DOUBLE), sum(hit) / CAST(sum(support) AS DOUBLE), sum(support) FROM rated
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rated
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rated)"""


_report = f""" SELECT name, {num('round(precision, 4)', 'precision')}, {num('round(recall, 4)', 'recall')}, {num('round(f1, 4)', 'f1')}, {big('support', 'support')} FROM report"""


@query("confusion_matrix", ctes(PROBS, FIRST, MATRIX) + f" SELECT {big('actual', 'actual')}, {big('predicted', 'predicted')}, {big('n', 'n')} FROM matrix")
def confusion_matrix(s: Shapes):
    return evaluation.confusion(first(s), "y", "pred")


@query("confusion_normalised", ctes(PROBS, FIRST, MATRIX) + f""" SELECT {big('actual', 'actual')}, {big('predicted', 'predicted')},
  {num('n / CAST(sum(n) OVER (PARTITION BY actual) AS DOUBLE)', 'share')} FROM matrix""")
def confusion_normalised(s: Shapes):
    return evaluation.confusion_share(evaluation.confusion(first(s), "y", "pred"))


@query("classification_report", ctes(PROBS, FIRST, MATRIX, report_sql()) + _report)
def classification_report(s: Shapes):
    return evaluation.classification_report(evaluation.confusion(first(s), "y", "pred"))


@query("gate_report", ctes(PROBS, "calls AS (SELECT CASE WHEN y > 0 THEN 1 ELSE 0 END AS actual, CASE WHEN q >= 0.3 THEN 1 ELSE 0 END AS predicted FROM pr)",
                           report_sql()) + _report)
def gate_report(s: Shapes):
    rows = s.probabilities().select((F.col("y") > 0).cast("int").alias("a"), (F.col("q") >= 0.3).cast("int").alias("p"))
    return evaluation.classification_report(evaluation.confusion(rows, "a", "p"))


@query("accuracy_counts", ctes(PROBS, FIRST) + f""" SELECT {big('count(*)', 'total')}, {big('sum(CASE WHEN y = pred THEN 1 ELSE 0 END)', 'correct')},
  {big('sum(CASE WHEN y = pred THEN 0 ELSE 1 END)', 'incorrect')}, {num('avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM first""")
def accuracy_counts(s: Shapes):
    return evaluation.accuracy_counts(first(s), "y", "pred")


def auc_sql(pairs: str) -> str:
    """Area from average ranks of ``(grp, score, pos)`` rows."""
    return f"""auc0 AS ({pairs}),
auc1 AS (SELECT grp, pos, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS r FROM auc0),
auc2 AS (SELECT grp, (sum(CASE WHEN pos = 1 THEN r ELSE 0 END) - sum(pos) * (sum(pos) + 1) / 2.0)
  / (sum(pos) * CAST(count(*) - sum(pos) AS DOUBLE)) AS auc FROM auc1 GROUP BY grp)"""


@query("auc_ovr", ctes(PROBS, auc_sql(" UNION ALL ".join(
    f"SELECT {c} AS grp, p{c} AS score, CASE WHEN y = {c} THEN 1 ELSE 0 END AS pos FROM pr" for c in range(4))))
    + f" SELECT {big('grp', 'cls')}, {num('auc', 'auc')} FROM auc2")
def auc_ovr(s: Shapes):
    return evaluation.auc_one_vs_rest(s.probabilities(), "y", _P)


@query("auc_mu", ctes(PROBS, auc_sql(" UNION ALL ".join(
    f"SELECT '{i}-{j}' AS grp, p{i} - p{j} AS score, CASE WHEN y = {i} THEN 1 ELSE 0 END AS pos FROM pr WHERE y IN ({i}, {j})"
    for i in range(4) for j in range(i)))) + f" SELECT {num('avg(auc)', 'auc_mu')} FROM auc2")
def auc_mu(s: Shapes):
    return evaluation.auc_mu(s.probabilities(), "y", _P)


@query("log_loss", ctes(PROBS, FIRST) + f""" SELECT {num('avg(-ln(greatest(least(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END, 1 - 1e-15), 1e-15)))', 'log_loss')},
  {num('avg(CASE WHEN y <> pred THEN 1.0 ELSE 0.0 END)', 'error')} FROM first""")
def log_loss(s: Shapes):
    return evaluation.log_loss(s.probabilities(), "y", _P)


# --- importance -----------------------------------------------------------------------------------

IMPORTANCE = """imp AS (SELECT l_returnflag || l_linestatus || '_' || CAST(l_partkey % 30 AS VARCHAR) || '_t-' || CAST(l_linenumber % 5 AS VARCHAR) AS feature,
  l_suppkey % 4 AS cls, l_quantity AS value FROM lineitem),
rolled AS (SELECT regexp_extract(feature, '^(.*)_t-', 1) AS base_feature, sum(value) AS importance FROM imp GROUP BY 1),
rolledc AS (SELECT cls, regexp_extract(feature, '^(.*)_t-', 1) AS base_feature, sum(value) AS importance FROM imp GROUP BY 1, 2),
ranked_c AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY importance DESC, base_feature) AS rank FROM rolledc)"""


@query("importance_rollup", ctes(IMPORTANCE) + f" SELECT base_feature, {num('importance', 'importance')} FROM rolled")
def importance_rollup(s: Shapes):
    return evaluation.importance_rollup(s.importance())


@query("importance_topk", ctes(IMPORTANCE) + f" SELECT base_feature, {num('importance', 'importance')} FROM rolled ORDER BY rolled.importance DESC, base_feature LIMIT 20")
def importance_topk(s: Shapes):
    return evaluation.top_features(evaluation.importance_rollup(s.importance()), 20)


@query("topk_per_class", ctes(IMPORTANCE) + f" SELECT {big('cls', 'cls')}, base_feature, {num('importance', 'importance')}, {big('rank', 'rank')} FROM ranked_c WHERE rank <= 40")
def topk_per_class(s: Shapes):
    return evaluation.top_per_class(evaluation.importance_rollup(s.importance(), by=["cls"]), "cls", 40)


@query("topk_union", ctes(IMPORTANCE) + " SELECT DISTINCT base_feature FROM ranked_c WHERE rank <= 40")
def topk_union(s: Shapes):
    rolled = evaluation.importance_rollup(s.importance(), by=["cls"])
    return evaluation.top_per_class(rolled, "cls", 40).select("base_feature").distinct()


@query("attribution_mean_abs", ctes(IMPORTANCE) + f" SELECT {big('cls', 'cls')}, feature, {num('avg(abs(value - 25))', 'importance')} FROM imp GROUP BY cls, feature")
def attribution_mean_abs(s: Shapes):
    signed = s.importance().withColumn("value", F.col("value") - 25)
    return evaluation.mean_absolute(signed, ["cls", "feature"])

"""Balancing, neighbours and synthetic rows."""

from pyspark.sql import functions as F

from catalog.preparation import SPLIT
from catalog.registry import big, ctes, num, query
from catalog.shapes import Shapes
from sessionlens.functions import scalars
from sessionlens.operators import evaluation, sampling
from sessionlens.operators.neighbours import nearest_in_class

_H = "md5(CAST({0} AS VARCHAR) || '-42')"
_h = _H.format("vec_id")
PROBS = """probs AS (
  SELECT vec_id AS id, label % 4 AS y, """ + ", ".join(f"exp(8 * CAST(embedding[{i + 1}] AS DOUBLE)) AS x{i}" for i in range(8)) + """
  FROM embeddings),
pr AS (SELECT id, y, """ + ", ".join(f"x{i} / (x0 + x1 + x2 + x3) AS p{i}" for i in range(4)) + ", " + ", ".join(
    f"x{i + 4} / (x4 + x5 + x6) AS e{i}" for i in range(3)) + ", 1 / (1 + 1 / x7) AS q FROM probs)"
# rows of embeddings by label: 0 is the majority stand-in, target 20
VEC = """vec AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY """ + _h + """, vec_id) AS r,
  count(*) OVER (PARTITION BY label) AS m FROM embeddings)"""


@query("undersample", ctes(VEC) + f" SELECT vec_id, {big('label', 'label')} FROM vec WHERE label <> 0 OR r <= 20")
def undersample(s: Shapes):
    return sampling.undersample(s.table("embeddings").select("vec_id", "label"), "label", "vec_id", {0: 20})


@query("balance_one_to_one", ctes(PROBS, f"""g AS (SELECT id, y, row_number() OVER (PARTITION BY y = 0 ORDER BY {_H.format('id')}, id) AS r FROM pr)""")
       + f" SELECT id, {big('y', 'y')} FROM g WHERE y <> 0 OR r <= (SELECT count(*) FROM pr WHERE y <> 0)")
def balance_one_to_one(s: Shapes):
    return sampling.balance_one_to_one(s.probabilities().select("id", "y"), "y", "id")


@query("balance_to_rest", ctes(PROBS, f"""g AS (SELECT id, y, row_number() OVER (PARTITION BY y = 0 ORDER BY {_H.format('id')}, id) AS r FROM pr WHERE y IN (0, 2, 3))""")
       + f" SELECT id, {big('y', 'y')} FROM g WHERE y <> 0 OR r <= (SELECT count(*) FROM pr WHERE y IN (2, 3))")
def balance_to_rest(s: Shapes):
    rows = s.probabilities().select("id", "y").where(F.col("y").isin(0, 2, 3))
    return sampling.balance_to(rows, "y", "id", F.col("y").isin(2, 3))


@query("hard_negatives", ctes(PROBS, f"""g AS (SELECT id, y, q, row_number() OVER (PARTITION BY y = 0 ORDER BY {_H.format('id')}, id) AS r,
  count(*) OVER (PARTITION BY y = 0) AS n FROM pr)""") + f"""
SELECT id, {big('y', 'y')}, {num('q', 'q')} FROM g WHERE y > 0 OR q >= 0.7 OR r <= floor(CAST(0.3 AS DOUBLE) * n)""")
def hard_negatives(s: Shapes):
    return sampling.hard_negatives(s.probabilities().select("id", "y", "q"), "y", "q", "id", 0.7)


@query("stratified_sample", ctes(f"""g AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
  row_number() OVER (PARTITION BY event_type = 'error' ORDER BY {_H.format('event_id')}, event_id) AS r FROM events)""")
       + f" SELECT event_id, {big('y', 'y')} FROM g WHERE y = 1 OR r <= 500")
def stratified_sample(s: Shapes):
    rows = s.table("events").select("event_id", (F.col("event_type") == "error").cast("int").alias("y"))
    return sampling.stratified_sample(rows, "y", "event_id", 500)


@query("random_subset", f"SELECT event_id FROM events ORDER BY {_H.format('event_id')}, event_id LIMIT 500")
def random_subset(s: Shapes):
    return sampling.random_subset(s.table("events").select("event_id"), "event_id", 500)


@query("shuffle_rows", f"SELECT event_id, {big('row_number() OVER (ORDER BY ' + _H.format('event_id') + ', event_id) - 1', 'position')} FROM events")
def shuffle_rows(s: Shapes):
    return sampling.shuffle_rows(s.table("events").select("event_id"), "event_id")


@query("head_sample", ctes(*SPLIT) + ' SELECT "user", sessionid FROM session_rows ORDER BY "user", starttime, sessionid LIMIT 1000')
def head_sample(s: Shapes):
    """The first 1000 rows in user and time order."""
    return s.sessions.orderBy("user", "starttime", "sessionid").limit(1000).select("user", "sessionid")


KNN = """knn0 AS (
  SELECT a.vec_id, a.label, b.vec_id AS nn_id,
         list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
  FROM {0} a JOIN {0} b ON a.label = b.label AND a.vec_id <> b.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nn_id) AS nn_rank FROM knn0)"""


@query("knn_same_class", ctes(KNN.format("embeddings")) + f"""
SELECT vec_id, {big('nn_rank', 'nn_rank')}, nn_id, {num('distance', 'distance')} FROM knn WHERE nn_rank <= 5""")
def knn_same_class(s: Shapes):
    return nearest_in_class(s.vectors(), "label", "vec_id", "x", 5)


@query("knn_in_rounds", ctes(KNN.format("embeddings")) + f"""
SELECT vec_id, {big('nn_rank', 'nn_rank')}, nn_id, {num('distance', 'distance')} FROM knn WHERE nn_rank <= 5""")
def knn_in_rounds(s: Shapes):
    """The same neighbours over cells and shells of about 20 rows, whose blocks are visited in rounds."""
    return nearest_in_class(s.vectors(), "label", "vec_id", "x", 5, block_rows=20)


def _made(target: str, raw: int | None = None) -> list[str]:
    """SMOTE with targets as a CASE over label; ``raw`` leading entries are interpolated."""
    source = "embeddings" if raw is None else f"(SELECT vec_id, label, embedding[1:{raw}] AS embedding FROM embeddings)"
    return [
        f"pool AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY label) AS m, {target} AS t FROM {source}) WHERE t > m)",
        f"poolr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h}, vec_id) - 1 AS r FROM pool)",
        KNN.format("pool"),
        """plan AS (SELECT *, unnest(range(CAST(ceil((t - m - r) / CAST(m AS DOUBLE)) AS BIGINT))) AS copy FROM poolr WHERE t - m > r)""",
        """made AS (SELECT p.vec_id, p.copy, p.label, p.embedding AS x, q.embedding AS nn,
  CAST('0x' || substr(md5(CAST(p.vec_id AS VARCHAR) || '-' || CAST(p.copy AS VARCHAR) || '-42'), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM plan p JOIN knn k ON p.vec_id = k.vec_id AND k.nn_rank = p.copy % 2 + 1 JOIN embeddings q ON q.vec_id = k.nn_id)""",
    ]


def _vector(i: int, made: bool, raw: int | None = None) -> str:
    if not made:
        return f"CAST(embedding[{i}] AS DOUBLE)"
    if raw is not None and i > raw:
        return "CAST(0 AS DOUBLE)"
    return f"CAST(x[{i}] AS DOUBLE) + u * (CAST(nn[{i}] AS DOUBLE) - CAST(x[{i}] AS DOUBLE))"


def _smote_sql(target: str, raw: int | None = None) -> str:
    total = " + ".join("({0})".format(_vector(i, True, raw)) for i in range(1, 65))
    cols = lambda made: ", ".join(num(_vector(i, made, raw), f"x{i}") for i in (1, 2, 40))
    return ctes(*_made(target, raw)) + f"""
SELECT vec_id, {big('-1', 'copy')}, {big('label', 'label')}, {cols(False)}, {num('list_sum(CAST(embedding AS DOUBLE[]))', 'total')} FROM embeddings
UNION ALL SELECT vec_id, {big('copy', 'copy')}, {big('label', 'label')}, {cols(True)}, {num(total, 'total')} FROM made"""


TARGETS = {1: 400, 2: 400, 3: 450}
_target = "CASE label WHEN 1 THEN 400 WHEN 2 THEN 400 WHEN 3 THEN 450 END"


def shown(df):
    return df.select("vec_id", "copy", "label", *[F.get("x", F.lit(i - 1)).alias(f"x{i}") for i in (1, 2, 40)],
                     F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("smote", _smote_sql(_target))
def smote(s: Shapes):
    """Classes that are at their target or above stay as they are, whatever the size of the table."""
    return shown(sampling.smote(s.vectors(), "label", "vec_id", "x", TARGETS, checked=False))


@query("smote_partial", _smote_sql(_target, 32))
def smote_partial(s: Shapes):
    return shown(sampling.smote_partial(s.vectors(), "label", "vec_id", "x", 32, TARGETS, checked=False))


@query("balanced_union", ctes(*_made(_target)) + f"""
SELECT {big('label', 'label')}, {big('count(*)', 'n')}, {big('sum(synthetic)', 'synthetic')} FROM
  (SELECT label, 0 AS synthetic FROM embeddings UNION ALL SELECT label, 1 FROM made) GROUP BY label""")
def balanced_union(s: Shapes):
    """Class sizes after original and synthetic rows are put together."""
    return sampling.smote(s.vectors(), "label", "vec_id", "x", TARGETS, checked=False).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("copy") >= 0).cast("int")).alias("synthetic"))


@query("round_categorical", f"SELECT event_id, {num('round(value)', 'value')} FROM events")
def round_categorical(s: Shapes):
    return sampling.round_columns(s.table("events").select("event_id", "value"), ["value"])


@query("cluster_sample", f"""
WITH g AS (SELECT vec_id, label % 4 AS y, vec_id % 12 AS cluster, row_number() OVER (PARTITION BY label % 4 = 0, vec_id % 12 ORDER BY {_h}, vec_id) AS r FROM embeddings)
SELECT vec_id, {big('y', 'y')}, {big('CASE WHEN y = 0 THEN cluster ELSE -1 END', 'cluster')} FROM g WHERE y <> 0 OR r <= 5""")
def cluster_sample(s: Shapes):
    """At most five rows of each cluster of the majority class; the clusters are given by the id."""
    rows = s.vectors().withColumn("y", F.col("label") % 4)
    given = lambda df: df.withColumn("cluster", (F.col("vec_id") % 12).cast("int"))
    return sampling.cluster_sample(rows, "y", "vec_id", "x", 12, 60, assign=given).select("vec_id", "y", "cluster")


# --- labels -------------------------------------------------------------------------------------

@query("tier2_subset", ctes(PROBS) + f" SELECT id, {big('y', 'y')} FROM pr WHERE y IN (0, 2, 3)")
def tier2_subset(s: Shapes):
    return s.probabilities().where(F.col("y").isin(0, 2, 3)).select("id", "y")


@query("label_remap", ctes(PROBS) + f""" SELECT id, {big('y', 'y')}, {big('CASE y WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END', 'mapped')},
  {big('y', 'back')} FROM pr WHERE y <> 1""")
def label_remap(s: Shapes):
    forward = {0: 0, 2: 1, 3: 2}
    mapped = scalars.remap(F.col("y"), forward)
    return s.probabilities().where(F.col("y") != 1).select("id", "y", mapped.alias("mapped"),
                                    scalars.remap(mapped, {v: k for k, v in forward.items()}).alias("back"))


@query("label_one_hot", ctes(PROBS) + " SELECT id, " + ", ".join(
    num(f"CASE WHEN y = {c} THEN 1 ELSE 0 END", f"y{c}") for c in range(4)) + " FROM pr")
def label_one_hot(s: Shapes):
    hot = scalars.one_hot_label(F.col("y"), 4)
    return s.probabilities().select("id", *[hot[c].alias(f"y{c}") for c in range(4)])


@query("class_weights", ctes(PROBS) + f""" SELECT {big('y', 'cls')}, {big('count(*)', 'n')},
  {num('(SELECT count(*) FROM pr) / CAST((SELECT count(DISTINCT y) FROM pr) * count(*) AS DOUBLE)', 'weight')},
  {num('((SELECT count(*) FROM pr) - count(*)) / CAST(count(*) AS DOUBLE)', 'ratio')} FROM pr GROUP BY y""")
def class_weights(s: Shapes):
    return evaluation.class_weights(s.probabilities(), "y")


@query("sample_weights", ctes(PROBS) + f" SELECT id, {num('CASE y WHEN 1 THEN 1.5 WHEN 2 THEN 3 ELSE 1 END', 'weight')} FROM pr")
def sample_weights(s: Shapes):
    return s.probabilities().select("id", scalars.weight_of(F.col("y"), {0: 1, 1: 1.5, 2: 3, 3: 1}).alias("weight"))

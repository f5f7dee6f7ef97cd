"""Exact sample sizes, neighbours against brute force, synthetic rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import evaluation, sampling
from sessionlens.operators.neighbours import nearest_in_class


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        cls = 0 if i < 250 else 1 + i % 2
        centre = rng.integers(0, 4) * 10.0
        x = [float(round(v, 2)) for v in centre + rng.normal(size=3)]
        rows.append((i, cls, rows[-1][2] if i % 40 == 7 else x))
    return spark.createDataFrame(rows, "id long, y int, x array<double>").cache()


@pytest.mark.parametrize("block", [30, 5_000])
def test_neighbours_are_exact_when_cells_are_pruned_and_split(points, block):
    got = nearest_in_class(points, "y", "id", "x", 3, block_rows=block).orderBy("id", "nn_rank").collect()
    rows = points.collect()
    want = []
    for r in rows:
        near = sorted((float(np.sqrt(((np.array(o.x) - np.array(r.x)) ** 2).sum())), o.id)
                      for o in rows if o.y == r.y and o.id != r.id)[:3]
        want += [(r.id, k + 1, n[1]) for k, n in enumerate(near)]
    assert [(r["id"], r["nn_rank"], r["nn_id"]) for r in got] == want


def test_rounds_prune_visits_and_stay_exact(spark, monkeypatch):
    """Clustered points: later rounds are dropped by the bound of the earlier ones, and visits carry no vector."""
    from sessionlens.operators import neighbours

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 30
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6))
    df = spark.createDataFrame([(i, 0, [float(v) for v in p]) for i, p in enumerate(x)], "id long, y int, x array<double>")
    done, plain = [], neighbours._across_blocks

    def counted(visits, *rest):
        assert "x" not in visits.columns
        done.append(visits.count())
        return plain(visits, *rest)

    monkeypatch.setattr(neighbours, "_across_blocks", counted)
    got = nearest_in_class(df, "y", "id", "x", 4, block_rows=60).collect()
    blocks = 1500 / 60
    assert len(done) >= 2 and sum(done) < 0.3 * 1500 * (blocks - 1)
    near = {(r["id"], r["nn_rank"]): r["nn_id"] for r in got}
    assert len(near) == 4 * 1500
    apart = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    order = np.argsort(apart, axis=1, kind="stable")[:, :4]
    assert all(near[i, r + 1] == order[i, r] for i in range(1500) for r in range(4))


def test_equal_points_are_parted_by_hash(spark):
    df = spark.createDataFrame([(i, 0, [1.0, 2.0]) for i in range(90)] + [(100 + i, 0, [5.0, float(i)]) for i in range(5)], "id long, y int, x array<double>")
    got = {(r["id"], r["nn_rank"]): r["nn_id"] for r in nearest_in_class(df, "y", "id", "x", 2, block_rows=10).collect()}
    assert got[50, 1] == 0 and got[50, 2] == 1 and got[0, 1] == 1 and got[103, 1] == 102


def test_undersample_is_exact_and_repeatable(points):
    first = sampling.undersample(points, "y", "id", {0: 60})
    counts = {r["y"]: r["count"] for r in first.groupBy("y").count().collect()}
    assert counts == {0: 60, 1: 75, 2: 75}
    again = sampling.undersample(points.repartition(5), "y", "id", {0: 60})
    assert first.select("id").exceptAll(again.select("id")).isEmpty()


def test_undersample_above_the_class_size_is_an_error(points):
    with pytest.raises(Exception, match="sample larger"):
        sampling.undersample(points, "y", "id", {0: 251}).count()


def test_smote_reaches_its_targets_between_neighbours(points):
    made = sampling.smote(points, "y", "id", "x", {1: 200, 2: 80}, k=2)
    counts = {r["y"]: r["count"] for r in made.groupBy("y").count().collect()}
    assert counts == {0: 250, 1: 200, 2: 80}
    partial = sampling.smote_partial(points, "y", "id", "x", 1, {1: 100}).where(F.col("copy") >= 0).collect()
    assert len(partial) == 25 and all(list(r["x"])[1:] == [0.0, 0.0] for r in partial)
    with pytest.raises(Exception, match="target below"):
        sampling.smote(points, "y", "id", "x", {0: 10}).count()


def test_balance_and_hard_negatives(points):
    one = sampling.balance_one_to_one(points, "y", "id")
    assert one.where("y = 0").count() == one.where("y > 0").count() == 150
    scored = points.withColumn("p", (F.col("id") % 100) / F.lit(100.0))
    hard = sampling.hard_negatives(scored, "y", "p", "id", 0.95)
    ids = {r["id"] for r in hard.collect()}
    assert all(r["id"] in ids for r in scored.where("y > 0 or p >= 0.95").collect())
    base = scored.where("y = 0 and p < 0.95").count()
    assert 0 < len([r for r in hard.collect() if r["y"] == 0 and r["p"] < 0.95]) < base


def test_cluster_sample_caps_each_cluster(points):
    kept = sampling.cluster_sample(points, "y", "id", "x", clusters=4, total=80)
    sizes = {r["cluster"]: r["count"] for r in kept.groupBy("cluster").count().collect()}
    assert sizes.pop(-1) == 150 and max(sizes.values()) <= 20


@pytest.mark.parametrize("limit", [10, 100_000])
def test_auc_counts_pairs_with_ties(spark, limit):
    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(0, 40)) / 40, int(rng.integers(0, 2))) for _ in range(300)]
    df = spark.createDataFrame([(s, p, 0) for s, p in rows], "score double, pos int, g int")
    got = evaluation.rank_auc(df, ["g"], "score", "pos", limit).collect()[0]["auc"]
    up, down = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])
    assert abs(got - want) < 1e-12


@pytest.mark.parametrize("name", ["smote", "smote_partial", "balanced_union"])
def test_registered_smote_leaves_classes_above_their_target(spark, tmp_path, name):
    import __spark_entry__ as entry

    rng = np.random.default_rng(8)
    labels = [1] * 430 + [2] * 380 + [3] * 20 + [0] * 30
    rows = [(i, [float(v) for v in rng.normal(size=64)], c) for i, c in enumerate(labels)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = entry.queries()[name](spark, str(tmp_path))
    if name != "balanced_union":
        made = made.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("copy") >= 0).cast("int")).alias("synthetic"))
    assert {r["label"]: (r["n"], r["synthetic"]) for r in made.collect()} == {0: (30, 0), 1: (430, 0), 2: (400, 20), 3: (450, 430)}


def test_vectors_travel_by_bundles_and_not_by_blocks(spark, monkeypatch):
    """Points in many dimensions, where nearly every row visits every block: a row goes to a bundle once a round."""
    from sessionlens.operators import neighbours

    x = np.random.default_rng(6).normal(size=(600, 16))
    df = spark.createDataFrame([(i, 0, [float(v) for v in p]) for i, p in enumerate(x)], "id long, y int, x array<double>")
    sent, plain = [], neighbours._across_blocks

    def counted(visits, *rest):
        sent.append(visits.count())
        return plain(visits, *rest)

    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 200)
    monkeypatch.setattr(neighbours, "_across_blocks", counted)
    near = {(r["id"], r["nn_rank"]): r["nn_id"] for r in neighbours.nearest_in_class(df, "y", "id", "x", 3, block_rows=10).collect()}
    assert len(sent) <= 7 and max(sent) <= 600 * 4, sent
    apart = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    order = np.argsort(apart, axis=1, kind="stable")[:, :3]
    assert len(near) == 1800 and all(near[i, r + 1] == order[i, r] for i in range(600) for r in range(3))


def test_a_row_goes_to_a_bundle_once_in_all_rounds(spark, monkeypatch):
    """Points in many dimensions: the blocks of a bundle are visited together, so no pair of row and bundle comes again in a later round."""
    from sessionlens.operators import neighbours

    x = np.random.default_rng(8).normal(size=(900, 24))
    x[450:500] = x[400:450] + 0.01
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in p]) for i, p in enumerate(x)], "id long, y int, x array<double>")
    sent, plain = [], neighbours._across_blocks

    def counted(visits, *rest):
        sent.extend((r["cls"], r["id"], r["bundle"]) for r in visits.select("cls", "id", "bundle").collect())
        return plain(visits, *rest)

    monkeypatch.setattr(neighbours, "_across_blocks", counted)
    near = {(r["id"], r["nn_rank"]): (r["nn_id"], r["distance"]) for r in neighbours.nearest_in_class(df, "y", "id", "x", 4, block_rows=10).collect()}
    assert len(sent) == len(set(sent)) and len({b for _, _, b in sent}) >= neighbours.LEAST_BUNDLES
    apart = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    apart[np.arange(900)[:, None] % 2 != np.arange(900) % 2] = np.inf
    np.fill_diagonal(apart, np.inf)
    order = np.argsort(apart, axis=1, kind="stable")[:, :4]
    assert len(near) == 3600 and all(near[i, r + 1] == (order[i, r], apart[i, order[i, r]]) for i in range(900) for r in range(4))

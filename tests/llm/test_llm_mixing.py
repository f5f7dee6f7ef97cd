"""Mixing against plain targets, and the rounding against what it promises: mass, means, whole copies."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sessionlens.llm import mixing
from sessionlens.llm.queries import op13_mixing


def plain_targets(sizes):
    """Targets by sharing the excess again and again; ``sizes``: size of each source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, rest, open_sources = {}, 1.5 * sum(sizes.values()), set(order)
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        above = {s for s in open_sources if rest * weight[s] / total >= 2 * sizes[s]}
        if not above:
            return out | {s: rest * weight[s] / total for s in open_sources}
        out |= {s: 2.0 * sizes[s] for s in above}
        rest -= sum(out[s] for s in above)
        open_sources -= above
    return out


def corpus(rng, n, sources=("a", "b", "ä", "B", None, "c")):
    rows = []
    for i in range(n):
        words = rng.choice([0, 1, 3, 10, 40, 200])
        text = rng.choice([" ", "\n\t", "  "]).join(rng.choice(["wort", "ü", "日本", "x\xa0y"]) for _ in range(words))
        rows.append((i, rng.choice([text, f" {text}\n", text]) if i % 50 else None, rng.choice(sources) if rng.random() > 0.4 else "a"))
    return rows


def check(rows, got):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    of_source, taken = defaultdict(int), defaultdict(int)
    for i, s in source.items():
        of_source[s] += sizes[i]
    aims = plain_targets(of_source)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == of_source[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(aims[source[r["doc_id"]]], rel=1e-12)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["taken"] in ({0} if not r["size"] else {int(rate) * r["size"], min(2, int(rate) + 1) * r["size"]})
        taken[source[r["doc_id"]]] += r["taken"]
    for s in aims:
        assert abs(taken[s] - aims[s]) <= max(sizes[i] for i in source if source[i] == s) / 2 + 1e-6
    return taken, aims


KIND = "doc_id long, text string, source string"


@pytest.mark.parametrize("leaf,fan", [(512, 64), (8, 2)])
def test_mixing_meets_its_targets(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", fan)
    rows = corpus(random.Random(leaf), 900)
    df = spark.createDataFrame(rows, KIND)
    got = mixing.mixed(df).collect()
    taken, aims = check(rows, got)
    assert sum(abs(taken[s] - aims[s]) for s in aims) < 0.01 * sum(aims.values())
    again = {r["doc_id"]: r["copies"] for r in mixing.mixed(df.repartition(13)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}


def test_targets_where_excess_is_shared_in_turns(spark):
    sizes = {f"s{k:02d}": n for k, n in enumerate([10, 1000, 0, 20, 5, 300, 70, 1, 1, 900, 40, 2])} | {None: 17}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes), rel=1e-12)


def test_duels_keep_mass_and_means():
    rng = random.Random(4)
    for _ in range(300):
        p, q, x, y = rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99), rng.randint(1, 50), rng.randint(1, 50)
        up, down = min((1 - p) * x, q * y), min(p * x, (1 - q) * y)
        mean = 0.0
        for u, share in ((0.0, down / (up + down)), (1.0, up / (up + down))):
            a, b = mixing.duel(p, x, q, y, u)
            assert a * x + b * y == pytest.approx(p * x + q * y)
            assert min(a, b) >= -1e-9 and max(a, b) <= 1 + 1e-9 and (a in (0, 1) or b in (0, 1))
            mean += share * a
        assert mean == pytest.approx(p)


def test_mixing_on_odd_rows(spark, odd, none, clash):
    assert mixing.mixed(none).count() == 0
    got = mixing.mixed(clash.withColumn("key", F.lit("mine")).withColumn("taken", F.lit("mine"))).collect()
    assert len(got) == odd.count()
    rows = [(k, r["text"], r["source"]) for k, r in enumerate(odd.collect())]
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    assert sum(r["size"] for r in got) == total
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], KIND)
    assert {(r["target"], r["taken"]) for r in mixing.mixed(empty).collect()} == {(0.0, 0)}


def test_query_with_a_hot_source_and_copies(spark, tmp_path):
    rows = corpus(random.Random(3), 400)
    df = spark.createDataFrame(rows, KIND)
    many = df.union(spark.createDataFrame([(1000 + k, "the same text again", "a") for k in range(600)], KIND))
    many.write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_mixing(spark, str(tmp_path)).collect()
    check([tuple(r) for r in many.collect()], got)

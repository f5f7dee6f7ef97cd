"""Spelling variants against a version that compares all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionlens.llm import spelling
from sessionlens.llm.queries import op12_spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(counts):
    out = {}
    for w, n in counts.items():
        others = [(-m, v) for v, m in counts.items() if near(w, v)]
        m, form = min(others, default=(0, None))
        form = form if form is not None and -m >= 5 * n else None
        out[w] = [form, n, len(others), -m if form is not None else None]
    rows = {}
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows[w] = (out[w][0], root, *out[w][1:])
    return rows


def plain_counts(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def random_words(rng, n, letters="abcé", least=6, most=9):
    return list({"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("limit", [4096, 20, 2])
def test_composition_against_all_pairs(spark, monkeypatch, limit):
    """Also where parts are cut at every three code points, to the ends of the words."""
    monkeypatch.setattr(spelling, "PART", limit)
    rng = random.Random(limit)
    words = random_words(rng, 220, "ab") + random_words(rng, 150) + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abcccd" * 2, "abccd" + "abcccd", "prefixprefix" + "x", "prefixprefix", "prefixprefixxx"]
    counts = {w: rng.choice([5, 6, 30, 31, 200, 1200]) for w in dict.fromkeys(words)}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    formed = spelling.variants(vocabulary)
    roots = {r["word"]: r["root"] for r in spelling.roots(formed).collect()}
    got = {r["word"]: (r["form"], roots.get(r["word"], r["word"]), r["n"], r["n_near"], r["form_n"]) for r in formed.collect()}
    assert got == plain_groups(counts)


def test_acceptor_is_minimal_and_pairs_come_once():
    rng = random.Random(1)
    words = sorted(random_words(rng, 300, "abc", 0, 6))
    acceptor = spelling.Acceptor(words)
    assert sorted(acceptor.language(acceptor.root)) == words
    assert len({(f, *sorted(t.items())) for t, f in zip(acceptor.next, acceptor.final)}) == len(acceptor.next)
    pairs = [frozenset(p) for p in acceptor.one_edit()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_query_against_plain_version(spark, tmp_path, make):
    rng = random.Random(7)
    base = random_words(rng, 60, "abcdeß", 5, 9) + ["Straßen", "ÀÉÎÕÜß", "MiXeDcAsE"]
    docs = [(i, " ".join(rng.choice(base) + rng.choice(["", ",", "1", "\n"]) for _ in range(rng.randint(0, 400)))) for i in range(60)]
    docs += [(None, "Straßen " * 9), (3, None), (4, ""), (5, docs[5][1]), (61, "x" * 30_000 + " ")] + [(70 + k, "y" * 30_000) for k in range(5)]
    make(docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in op12_spelling(spark, str(tmp_path)).collect()}
    counts = plain_counts(docs)
    assert got == plain_groups(counts) and any(v[0] for v in got.values())


def test_spelling_on_odd_rows(spark, odd, none, clash):
    assert spelling.spelling_groups(none).count() == 0
    some = odd.union(odd).union(odd)
    got = {r["word"]: r["n"] for r in spelling.spelling_groups(clash.union(clash).union(clash)).collect()}
    counts = Counter(w for r in some.collect() for w in re.findall("[a-zÀ-ÿ]{6,}", (r["text"] or "").lower()))
    assert got == {w: n for w, n in counts.items() if n >= 5}
    chain = spark.createDataFrame([("abcdef", 5), ("abcdeg", 25), ("abcdhg", 125), ("abcihg", 625)], "word string, n long")
    formed = spelling.variants(chain)
    assert {r["word"]: r["root"] for r in spelling.roots(formed).collect()} == {w: "abcihg" for w in ("abcdef", "abcdeg", "abcdhg")}
    assert formed.where(F.col("word") == "abcihg").first()["form"] is None

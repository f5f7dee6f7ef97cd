"""Cross-tokenizer alignment against a plain version that encodes whole texts and compares all token pairs."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.llm import alignment
from sessionlens.llm.queries import op11_alignment, tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per text, by offsets of whole texts."""
    a, b = libraries
    letters = {**{chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    letters |= {chr(256 + i): c for i, c in enumerate([c for c in range(256) if chr(c) not in letters])}
    rows, holds = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        in_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        in_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(in_a) != whole or b"".join(in_b) != whole:
            rows.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in in_a]), np.cumsum([len(x) for x in in_b])
        starts_a, starts_b = ends_a - [len(x) for x in in_a], ends_b - [len(x) for x in in_b]
        links = [(ids_a[i], ids_b[j]) for i in range(len(ids_a)) for j in range(len(ids_b)) if max(starts_a[i], starts_b[j]) < min(ends_a[i], ends_b[j])]
        groups, last_a, last_b = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            i, j = ends_a.tolist().index(end) + 1, ends_b.tolist().index(end) + 1
            groups.append(",".join(map(str, ids_a[last_a:i])) + "|" + ",".join(map(str, ids_b[last_b:j])))
            last_a, last_b = i, j
        holds.update(set(links))
        rows.append((len(ids_a), len(ids_b), groups, links))
    best = Counter()
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = r
            out.append((n_a, n_b, len(groups), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), ";".join(groups)))
    return out, holds


ODD = [
    "plain words, and more words", "  leading and  double   spaces ", "tabs\tand\nlines \n\n after", "x▁y has the mark", "x▁ y", "nul\x00byte é́ 😀 日本語のテキスト",
    "<|endoftext|> <s> </s> <0x41> <unk>", "don't we'll I'M", " ", "   ", "", None, "a", "words " * 50, "aaaa" * 100, "ﬁ Å   　w \x1c z", "trailing\n", " \n x", "plain words, and more words",
]


def values(frame):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in frame.orderBy("doc_id").collect()]


def test_alignment_against_plain_version(spark, make, libraries):
    df = make(list(enumerate(ODD)))
    expected, holds = plain(ODD, libraries)
    assert values(alignment.aligned(df, A, B)) == expected
    counted, _ = alignment.counted_pairs(df.repartition(3), A, B)
    assert {(r["a"], r["b"]): r["n_docs"] for r in alignment.pair_counts(counted, A, B).collect()} == dict(holds)


def test_rounds_and_trees_give_the_same(spark, make, libraries, monkeypatch):
    """Small groups, rounds of a few slots, trees of two vectors a node."""
    texts = [t for t in ODD if t] + [f"word{i} number {i * 7} of the {i % 3} list" for i in range(60)]
    expected, _ = plain(texts, libraries)
    monkeypatch.setattr(alignment, "GROUP", 16)
    monkeypatch.setattr(alignment, "ROUND", 150)
    monkeypatch.setattr(alignment, "FAN", 2)
    assert values(alignment.aligned(make(list(enumerate(texts))).repartition(5), A, B)) == expected


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 60_000))
    group = alignment.group_of(keys, 4)
    rows = []
    for g in range(4):
        sizes, words, order = alignment.perfect_levels(keys[group == g])
        rows.append((g, sizes, words.tobytes(), order.tobytes()))
        assert 64 * len(words) < 5 * len(order)
    found = alignment.PerfectHash(rows, 4)
    assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(rng.integers(0, 1 << 40, 20_000), keys)
    assert (found.slots(others) == -1).all()
    part = alignment.PerfectHash(rows[1:3], 4)
    assert ((part.slots(keys) >= 0) == ((group == 1) | (group == 2))).all()


def test_alignment_on_odd_rows(odd, none, clash, libraries):
    assert alignment.aligned(none, A, B).count() == 0
    got = alignment.aligned(clash.withColumn("n_a", F.lit("mine")).withColumn("groups", F.lit("mine")), A, B)
    rows = got.collect()
    texts = [r["text"] for r in odd.collect()]
    expected, _ = plain([t if t is None or len(t) < 5000 else "" for t in texts], libraries)
    short = {t: e[:4] for t, e in zip(texts, expected) if t is None or len(t) < 5000}
    assert len(rows) == len(texts)
    for r in rows:
        if r["text"] in short:
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == short[r["text"]]
        else:
            assert r["n_a"] > 1000 and r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]
    assert got.columns.count("ids") == 1 and {r["ids"] for r in rows} == {"mine"}


def test_query_digests(spark, libraries, tmp_path, make):
    make(list(enumerate(ODD))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op11_alignment(spark, str(tmp_path)).collect()}
    expected, _ = plain(ODD, libraries)
    for i, e in enumerate(expected):
        assert got[i]["groups_sha256"] == (hashlib.sha256(e[6].encode()).hexdigest() if e[6] else "")

"""Privacy, quality rules, classifier, sharding and language against brute force, and the pipeline's stages."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionlens.llm import language, privacy, quality, rules, sharding

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c_d@e.f x@y..z q@r.s-t.u", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112",
    "+1 (415) 555-0100 +44 20 7946 0958 +1 + 2 +12 ", "é😀 a.b@c.de 😀 10.0.0.1", "9" * 5000, "a" * 5000 + "@", "1 " * 3000, "@@ a@ @b.c", "+1" + "(" * 3000, "x@y.z" * 50,
]


def test_base_spans_equal_python(make, odd, none):
    rng = random.Random(4)
    texts = TRICKY + ["".join(rng.choice("a1.@ +-(4)_%") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = make(list(enumerate(texts)) + [(999, None)]).select("text", privacy.base_spans(F.col("text")).alias("s")).collect()
    for r in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in r["s"]] == base(r["text"])
    found = privacy.private_spans(odd)
    assert found.count() == odd.count() and privacy.private_spans(none).count() == 0
    assert privacy.sanitised(none).count() == 0


def disclosing_corpus():
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod".split()
    rows = []
    for k in range(6):
        rows.append((k, f"Record {filler[k]} {filler[k + 1]}: Zorblaxia wrote from zx@corp.example about {filler[k + 2]} things. Zorblaxia again."))
    rows += [(10 + k, f"{filler[k % 10]} wrote about {filler[(k + 3) % 10]} things from home, no {k} names") for k in range(200)]
    rows += [(300 + k, f"copy {filler[0]} Qwertyish at q@corp.example stays") for k in range(9)]  # equal contexts are no evidence
    return rows


def test_words_that_disclose_are_masked(make):
    docs = make(disclosing_corpus())
    got = {r["doc_id"]: r["text"] for r in privacy.sanitised(docs).collect()}
    assert "Zorblaxia" not in got[0] and "zx@" not in got[0] and "[REMOVED]" in got[0] and "wrote" in got[0] and "things" in got[0]
    assert "Qwertyish" in got[300] and "[EMAIL]" in got[300]
    assert all(got[i] == t for i, t in disclosing_corpus() if 10 <= i < 300)


def test_overlapping_spans_share_a_mask(make, clash, odd):
    got = privacy.sanitised(make([(1, "ip +10.20.30.40.50 end"), (2, "x@y.z"), (3, None), (4, "")])).collect()
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[2] == "[EMAIL]" and text[3] is None and text[4] == "" and text[1].endswith(" end") and "20" not in text[1]
    assert privacy.sanitised(clash).columns == clash.columns and privacy.sanitised(clash).count() == odd.count()


def test_very_many_entities_in_one_text(make, monkeypatch):
    monkeypatch.setattr(privacy, "PART", 7)
    rng = random.Random(3)
    texts = ["é" * rng.randint(0, 40) + "".join(f" a{k}@b.cd{'ü' * rng.randint(0, 30)}" for k in range(n)) for n in (1, 2, 3, 17, 20000)]
    docs = make(list(enumerate(texts)))
    kinds = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    spans = docs.select("text", privacy.base_spans(F.col("text")).alias("s"))
    for r in spans.select("text", "s", privacy.masked(F.col("text"), F.col("s")).alias("m")).collect():
        assert [(s["start"], s["end"]) for s in r["s"]] == [m.span() for m in kinds.finditer(r["text"])]
        assert r["m"] == kinds.sub("[EMAIL]", r["text"])


def test_copies_hide_no_disclosing_word(make):
    """A word in three texts with its entity, each copied 60 times, among 300 others."""
    filler = lambda i: f"plain words number{i} about things and more things"
    rows = [(i, filler(i)) for i in range(300)]
    rows += [(1000 + i, f"wrote Zorblaxia about case {'abc'[i % 3] * 4} to zx@home.example today") for i in range(180)]
    got = {r["doc_id"]: r["text"] for r in privacy.sanitised(make(rows)).collect()}
    assert all("Zorblaxia" not in got[1000 + i] and "zx@" not in got[1000 + i] for i in range(180))
    assert all(got[i] == filler(i) for i in range(300))


def test_names_far_from_the_entity_and_repeated_footers(make):
    """A salutation whose address stands 80 words further down, after which every text has one and the same footer."""
    body = lambda i: " ".join(f"common{'abcdefghij'[k % 10]}" for k in range(80)) + f" case{i}"
    footer = "\nbest regards from the office, " * 3 + "ring Quuxley at q@home.example\n"
    rows = [(i, body(i)) for i in range(300)] + [(1000 + i, f"Dear Zorblaxia, {body(1000 + i)}{footer}") for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in privacy.sanitised(make(rows)).collect()}
    assert all("Zorblaxia" not in got[1000 + i] and "Quuxley" not in got[1000 + i] and "commona" in got[1000 + i] for i in range(5))
    assert all(got[i] == body(i) for i in range(300))


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_python(make, odd, none, clash):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", "|#"]) for _ in range(300)]
    texts += ["a b c d e " * 400, "x\ny\nx\n \n\ny", "é😀 " * 20, None, "", "\x1cfoo\x85bar  "]
    rows = rules.ledger(make(list(enumerate(texts)))).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measures(r["text"])
    assert rules.ledger(none).count() == 0
    assert rules.ledger(clash).where("key = 'mine' and n_words is not null").count() == odd.count()


def test_equal_high_bits_of_hashes(spark):
    """The comparison one by one, by words whose hashes can't be packed: one hash repeated among others."""
    words = F.array(*(F.lit(w) for w in "a b c d e f a b c d e g".split()))
    assert spark.range(1).select(rules.repeated_words(words)).first()[0] == 10
    assert spark.range(1).select(rules.repeated_words(F.array(*(F.lit("z") for _ in range(40))))).first()[0] == 40


def test_policies_and_ablation(make):
    texts = ["short", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12", "AAA!! BBB!! CCC!! DDD!! EEE!! FFF!! GGG!! HHH!! III!! JJJ!! KKK!!", "a a a a a a a a a a a a a a"]
    book = rules.ledger(make(list(enumerate(texts)))).cache()
    kept = {r[0]: r[1] for r in book.select("doc_id", rules.verdict(rules.STRICT)).collect()}
    assert kept == {0: False, 1: True, 2: False, 3: False}
    lax = rules.Policy("lax", 2, rules.STRICT.rules, allowed=1)
    assert [r[0] for r in book.where(rules.verdict(lax)).select("doc_id").orderBy("doc_id").collect()] == [0, 1]
    table = {r["rule"]: r for r in rules.ablation(book, rules.STRICT).collect()}
    assert table["few_words"]["only_by_it"] == 1 and table["repeats"]["failing"] == 1 and table["repeats"]["only_by_it"] == 0
    assert all(r["rejected"] == 3 for r in table.values())
    book.unpersist()


@pytest.mark.parametrize("rows", [1, 2, 8, 97, 1000])
def test_shards_are_a_permutation(spark, rows):
    df = spark.range(rows).selectExpr("id * 7 as doc_id", "repeat('x', cast(id % 5 as int)) as text")
    got = sharding.shard(df).collect()
    assert sorted(r["row_number"] for r in got) == list(range(rows))
    assert sorted(8 * r["slot"] + r["shard"] for r in got) == list(range(rows))
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    if rows == 1000:
        assert sum(8 * r["slot"] + r["shard"] != r["row_number"] for r in got) > 900


def plain_network(x, a, b, seed):
    """The network in plain Python: XXH64 over the half, the round and the seed."""
    left, right = divmod(x, b)
    for i in range(sharding.ROUNDS):
        h = 42
        for part in (struct.pack("<q", left if i % 2 else right), struct.pack("<i", i), struct.pack("<i", seed)):
            h = xxhash.xxh64_intdigest(part, h)
        h -= (1 << 64) if h >> 63 else 0
        left, right = (left, (right + h % b) % b) if i % 2 else ((left + h % a) % a, right)
    return left * b + right


@pytest.mark.parametrize("a,b,first", [(5, 7, 0), (31, 33, 0), (1 << 26, (1 << 26) + 3, 1 << 40), (1 << 30, 1 << 31, (1 << 61) - 900)])
def test_the_network_against_plain_python(spark, a, b, first):
    n = min(a * b, 1500) if first == 0 else 900
    got = {r["id"]: r["p"] for r in spark.range(first, first + n).select("id", sharding.feistel(F.col("id"), a, b, 42).alias("p")).collect()}
    assert got == {x: plain_network(x, a, b, 42) for x in range(first, first + n)}
    assert len(set(got.values())) == n and all(0 <= p < a * b for p in got.values())


def test_shards_against_plain_python(spark, make):
    rows = 500
    a, b = sharding.sides(rows)
    for r in sharding.shard(make([(i * 3, f"text {i}") for i in range(rows)])).collect():
        x = plain_network(r["row_number"], a, b, 42)
        while x >= rows:
            x = plain_network(x, a, b, 42)
        assert (r["shard"], r["slot"]) == (x % 8, x // 8)


def test_shards_on_odd_rows(odd, none, clash):
    got = sharding.shard(clash).collect()
    assert len(got) == odd.count() and sharding.shard(none).count() == 0
    assert max(Counter(r["shard"] for r in got).values()) - min(Counter(r["shard"] for r in got).values()) <= 1
    long = next(r for r in got if r["doc_id"] == 6)
    assert long["size"] == 84001 and long["text_crc32"] == zlib.crc32(("Lorem ipsum dolor sit amet. " * 3000).encode())


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_model(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_classifier_on_held_out_rows(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    held = quality.classify(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1")
    right, n = held.selectExpr("sum(int(predicted = quality))", "count(*)").first()
    assert n > 50 and right / n > 0.95
    scored = quality.classify(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.classify(none, model).count() == 0
    blank = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.classify(odd, blank).collect()} == {0.5}


def test_language_of_held_out_rows(spark, odd, none, clash):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    filters = language.fit(docs, ~held_out)
    held = language.identify(docs.where(held_out), filters)
    assert held.where("lang_pred = lang").count() / held.count() > 0.95
    got = {(r["doc_id"], r["text"]): r for r in language.identify(odd, filters).collect()}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for (_, t), r in got.items() if not any(c.isalpha() for c in t or ""))
    assert all(r["lang_pred"] in filters.languages and 0 <= r["score"] <= 1 for (_, t), r in got.items() if any(c.isalpha() for c in t or ""))
    assert language.identify(none, filters).count() == 0
    assert {r["lang_pred"] for r in language.identify(clash, language.fit(none, F.lit(True))).collect()} == {"und"}


def test_more_than_64_languages(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):
        a, b = alphabet[k % 26], alphabet[(k * 7 + k // 26) % 26]
        rows += [(k * 10 + j, f"{a}{b}{a}{a}{b} " * 12, f"l{k:02d}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.fit(docs, F.lit(True)))
    assert got.where("lang_pred = lang").count() / len(rows) > 0.9


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        if name == "pii":
            assert out.where("text like '%@mail%'").isEmpty()
        empty = step(spark, odd.limit(0), sf)
        assert empty.count() == 0
        assert step(spark, odd, sf).count() <= odd.count()
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.count()

"""Near-duplicates, line templates and fingerprints against brute force."""

import random
import re

import numpy as np
import pyspark.cloudpickle as cloudpickle
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionlens.llm import common, fingerprints, line_templates, near_dups


def fingerprint(text, words):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_majority_over_block_borders(monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 7)
    rng = np.random.default_rng(1)
    counts = np.array([0, 3, 20, 0, 1, 7, 7, 0])
    hashes = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    got, at = near_dups.majorities(hashes, counts), 0
    for n, value in zip(counts, got):
        own = hashes[at : at + n]
        at += n
        assert int(value) == sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > n)


def test_simhash_on_odd_rows(odd, none, clash):
    rows = near_dups.simhash(odd, 3).collect()
    for r in rows:
        assert r["fingerprint"] % 2**64 == fingerprint(r["text"], 3)
    found = near_dups.near_duplicates(near_dups.simhash(clash, 3)).collect()
    assert len(found) == len(rows)
    by_fp = {}
    for r in found:
        by_fp.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(v) == 1 for v in by_fp.values())
    assert by_fp[0] == {3}  # the empty texts, one of which has no id
    assert near_dups.near_duplicates(near_dups.simhash(none, 3)).count() == 0


@pytest.mark.parametrize(("bits", "bucket"), [(2, 1024), (2, 8), (5, 1024)])
def test_components_equal_brute_force(spark, monkeypatch, bits, bucket):
    monkeypatch.setattr(near_dups, "BUCKET", bucket)
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = [0, 2**64 - 1]
    for c in centres:
        for _ in range(14):
            v = c
            for _ in range(rng.randint(0, bits + 1)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    rows = [(i, near_dups.signed(v)) for i, v in enumerate(values)] + [(1000 + i, near_dups.signed(values[5])) for i in range(30)]
    cloudpickle.register_pickle_by_value(near_dups)
    try:
        got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, fingerprint long"), bits).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(near_dups)
    want = groups(values, lambda a, b: bin(a ^ b).count("1") <= bits)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] < 1000} == dict(enumerate(want))
    assert {r["component_id"] for r in got if r["doc_id"] >= 1000} == {want[5]}


def test_one_of_each_group_stays(spark, make, odd, none):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, want = [], set()
    for g in range(8):
        base = [word() for _ in range(150)]
        want.add(100 * g)
        for k in range(12):
            own = list(base)
            if k % 3:
                own[rng.randrange(150)] = word()
            texts.append((100 * g + k, " ".join(own)))
    alone = [(5000 + i, " ".join(word() for _ in range(80))) for i in range(30)]
    kept = near_dups.one_of_each(make(texts + alone + texts[:5])).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(want | {i for i, _ in alone})
    left = near_dups.one_of_each(odd)
    assert left.columns == odd.columns and left.count() == 10
    assert near_dups.one_of_each(none).count() == 0


def shingles(text):
    found = text.split()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_no_partner_of_a_templated_cluster_is_left_untried(make):
    """Texts of one template are about 0.67 alike; some have a partner of 0.8 or more that isn't the nearest."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    frame = [word() for _ in range(300)]
    texts = []
    for _ in range(120):
        own = frame[:240] + [word() for _ in range(60)]
        texts.append(own)
        if rng.random() < 0.4:
            at = rng.randrange(240)
            texts.append(own[:at] + [word() for _ in range(15)] + own[at + 15 :])
    texts = [" ".join(t) for t in texts]
    want = groups([shingles(t) for t in texts], alike)
    got = near_dups.one_of_each(make(list(enumerate(texts)))).collect()
    assert 0 < len(texts) - len(set(want)) and sorted(r["doc_id"] for r in got) == sorted(set(want))


def test_block_edits_near_the_limit_are_found(make):
    """A passage appended, cut off or replaced, with a similarity from 0.8 to 0.85."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for g in range(150):
        base = [word() for _ in range(300)]
        edited = [base + [word() for _ in range(rng.randint(53, 73))], base[: rng.randint(242, 255)], base[:100] + [word() for _ in range(24)] + base[124:]][g % 3]
        texts += [" ".join(base), " ".join(edited)]
        assert 0.8 <= len(shingles(texts[-2]) & shingles(texts[-1])) / len(shingles(texts[-2]) | shingles(texts[-1])) < 0.86
    got = near_dups.one_of_each(make(list(enumerate(texts)))).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(0, 300, 2))


def test_candidates_of_the_corpus_come_from_linked_fingerprints(make, monkeypatch):
    """Without any shared band: what the fingerprints of operator 6 link is verified, joined if alike, else left."""
    signatures = near_dups.signatures
    monkeypatch.setattr(near_dups, "signatures", lambda df: signatures(df).withColumn("bands", F.array(F.xxhash64("node", F.lit(1)))))
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    frame = " ".join(f"{a} {b} {c}" for a, b, c in [(word(), word(), word())] * 300)
    texts = [frame + " " + " ".join(word() for _ in range(30)) for _ in range(4)]  # one fingerprint, hardly a common shingle
    for _ in range(12):
        base = [word() for _ in range(1500)]
        texts += [" ".join(base), "  ".join(base).upper(), " ".join(base[:700] + [word()] + base[701:])]
    prints = [fingerprint(t, 3) for t in texts]
    sets = [shingles(t.lower()) for t in texts]
    near = lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2
    want = groups(range(len(texts)), lambda i, j: near(i, j) and alike(sets[i], sets[j]))
    assert near(0, 1) and want[:4] == [0, 1, 2, 3] and len(set(want[4:])) < 20
    got = near_dups.one_of_each(make(list(enumerate(texts)))).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(want))


def plain_templates(line):
    """The templates of a line as lists, by the rules of the module docstring, with (True, ...) for short lines."""
    dense = "".join(f"{chr(a)}-{chr(b)}" for a, b in line_templates.SPACELESS)
    tokens = re.findall(f"[{dense}]{{1,2}}|[^ \t-\r{dense}]+", line)
    letter, digit = re.compile("[A-Za-z\x80-\U0010ffff]"), re.compile("[0-9]")
    worded = lambda ts: sum(t is not None and bool(letter.search(t)) for t in ts) >= max(3, len(ts) / 2)
    if not tokens:
        return []
    if len(tokens) < 5:
        return [(True, *tokens)] if len(letter.findall("".join(tokens))) >= 12 else []
    free = [None if digit.search(t) else t for t in tokens]
    tokens = free if worded(free) else tokens
    out = [(False, *tokens)]
    for block in range(4 if len(tokens) >= 10 else 0):
        made = [None if i >= 3 and (i - 3) % 4 == block else t for i, t in enumerate(tokens)]
        if worded(made):
            out.append((False, block, *made))
    return out


def brute_lines(rows):
    first, docs = {}, {}
    order = lambda i, t: (i is not None, i or 0, xxhash.xxh64_intdigest((t or "").encode(), 42) - ((xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63) << 64))
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            for key in plain_templates(line):
                first[key] = min(first.get(key, (order(i, t), n)), (order(i, t), n))
                docs.setdefault(key, set()).add(order(i, t))
    out = []
    for i, t in rows:
        kept = []
        for n, line in enumerate((t or "").split("\n")):
            keys = plain_templates(line)
            if not any(len(docs[k]) >= (4 if k[0] else 2) and first[k] != (order(i, t), n) for k in keys):
                kept.append(line)
        out.append((i, None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_equal_brute_force(make, odd, none, clash):
    shared = "this very line of more than ten words stands in many documents of all"
    field = "this very line of more than ten words stands in OTHER documents of all"
    rows = [(3, f"own text one two three\n{shared}\nshort line"), (1, f"{shared}\nown text at the start here"), (2, f"{field}\nshort line"),
            (4, "order 66 was sent to house 12"), (5, "order 7 was sent to house 9999"), (None, shared), (6, None), (7, ""), (1, f"{shared}\nown text at the start here"),
            (8, "a line that repeats within one text\na line that repeats within one text")]
    got = line_templates.without_recurring_lines(make(rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == brute_lines(rows)
    kept = {r["doc_id"]: r["text"] for r in got}
    assert kept[None] == shared and kept[1] == "own text at the start here" and kept[2] == "short line" and kept[5] == ""
    assert kept[8].count("repeats") == 2  # not across documents
    assert line_templates.without_recurring_lines(none).count() == 0
    assert line_templates.without_recurring_lines(clash).where("key = 'mine'").count() == odd.count()


def test_short_and_spaceless_lines_recur_too(make):
    footer, passage, thai = "SPDX-License-Identifier: MIT", "この文書の内容は予告なく変更されることがありますのでご注意ください", "สงวนลิขสิทธิ์ตามกฎหมายห้ามทำซ้ำ"
    changed = passage.replace("変更", "改訂")  # one field of a long line
    rows = [(i, f"{footer}\nown{i}\n\n{passage}\n{thai}\nAll rights reserved.") for i in range(4)] + [(9, changed)]
    got = {r["doc_id"]: r["text"] for r in line_templates.without_recurring_lines(make(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own{i}\n" for i in range(1, 4)) and got[9] == ""


def test_code_dialogue_and_headings_stay(make):
    """Short clean lines that several texts share stay, a footer of few words goes from the fourth text on."""
    common = "    return x\n}\nYes.\nChapter 1"
    rows = [(i, f"{common}\nAll rights reserved worldwide") for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in line_templates.without_recurring_lines(make(rows[:3])).collect()}
    assert got == dict(rows[:3])
    got = {r["doc_id"]: r["text"] for r in line_templates.without_recurring_lines(make(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == common for i in range(1, 6))


@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_random_lines_equal_brute_force(make, monkeypatch, at_once):
    monkeypatch.setattr(line_templates, "AT_ONCE", at_once)
    cloudpickle.register_pickle_by_value(line_templates)
    rng = random.Random(at_once)
    words = ["alpha", "beta", "gamma", "x1", "2024", "--", "版权所有", "ไทย", "é", "word"]
    pool = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 9, 10, 14]))) for _ in range(40)]
    rows = [(rng.choice([None, *range(30)]), rng.choice(["\n", "\n\n", " \r\n"]).join(rng.choice(pool) for _ in range(rng.randrange(9)))) for _ in range(60)]
    rows = list({(i, t): (i, t) for i, t in rows}.values())
    rows += rows[:5]
    got = line_templates.without_recurring_lines(make(rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == brute_lines(rows)
    keys = line_templates.with_keys(make(rows)).collect()
    for r in keys:  # as many templates a line as the plain rules give
        lines = (r["text"] or "").split("\n")
        want = sorted(n for n, line in enumerate(lines) for _ in plain_templates(line))
        assert sorted(k["line"] for k in r["keys"]) == want
    cloudpickle.unregister_pickle_by_value(line_templates)


def test_clean_rows_of_numbers_stay(make):
    """Of 60 different rows a text in tables, schedules and logs, and one whole row that two texts share."""
    rng = random.Random(5)
    table = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(5))
    wide = lambda: " | ".join(str(rng.randrange(10**6)) for _ in range(7))
    plan = lambda: f"Mon {rng.randrange(24)}:{rng.randrange(60)} room {rng.randrange(10**4)} {rng.randrange(10**6)}"
    log = lambda: f"2024-05-{rng.randrange(31)} {rng.randrange(10**6)} INFO {rng.randrange(10**6)} {rng.randrange(10**6)} ok"
    rows = [(i, "\n".join(kind() for _ in range(60))) for i, kind in enumerate([table, table, wide, wide, plan, plan, log, log])]
    shared = rows[0][1].split("\n")[7]
    got = {r["doc_id"]: r["text"] for r in line_templates.without_recurring_lines(make(rows + [(20, f"{shared}\n1 2 3 4 5")])).collect()}
    assert all(got[i] == text for i, text in rows) and got[20] == "1 2 3 4 5"


def test_paragraphs_are_inserted_and_deleted():
    a, b, both = fingerprints.fingerprint(["one two three four", "five six\nseven", "seven\none two three four\nfive six"])
    assert fingerprints.combine(a, b) == both
    assert fingerprints.combine(both, b, -1) == a
    assert fingerprints.likeness([a, both, a], [a, a, b])[0] == 1 and 0 < fingerprints.likeness([both], [a])[0] < 1


def test_sketch_over_segment_borders(monkeypatch):
    texts = ["", "a b c d", "word " * 500, "x" * 300 + " y", "é ü\n\nß", " \t ", "l1\nl2 l2 l2 l2\n"]
    want = fingerprints.fingerprint(texts)
    monkeypatch.setattr(fingerprints, "SEGMENT", 64)
    assert fingerprints.fingerprint(texts) == want
    assert [fingerprints.fingerprint([t])[0] for t in texts] == want


@pytest.mark.parametrize("rows", [1, 2, 7, 300])
def test_edited_texts_use_the_next_document(make, rows):
    rng = random.Random(rows)
    texts = [(i * 3, "w%d x y " % i * rng.randint(0, 9)) for i in range(rows)]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(make(texts)).collect()}
    assert len(got) == rows
    order = sorted(texts, reverse=True)
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % rows][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + follow[:n]
        r = got[i]
        assert r["edited"] == edited and r["n_chars"] == len(t)
        prints = fingerprints.fingerprint([t, edited, follow])
        assert [bytes(r["fingerprint"]), bytes(r["edited_fingerprint"])] == prints[:2]
        assert np.allclose([r["near_edited"], r["near_next"]], fingerprints.likeness(prints[:1] * 2, prints[1:]))


def test_fingerprints_on_odd_rows(odd, none, clash):
    assert fingerprints.edited_fingerprints(odd).count() == odd.count()
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert fingerprints.with_fingerprint(clash).where("key = 'mine' and length(fingerprint) = 576").count() == odd.count()


@pytest.mark.parametrize("most", [1 << 15, 1 << 28])
def test_a_sieve_loses_no_wanted_row(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_SIEVE_BITS", most)
    rows = spark.range(200_000).withColumn("_slot", F.lit("mine")).withColumn("h", F.xxhash64("id"))
    wanted = rows.where("id % 40 = 0").select(F.col("h").alias("key"))
    got = common.sifted(rows, F.col("h"), wanted).groupBy((F.col("id") % 40 == 0).alias("w"), "_maybe").count()
    got = {(r["w"], r["_maybe"]): r["count"] for r in got.collect()}
    assert got[True, True] == 5000 and (True, False) not in got
    assert got[False, True] < 195_000 * (0.08 if most > 1 << 15 else 0.2)
    assert not common.sifted(rows, F.col("h"), wanted.where("false")).where("_maybe").count()

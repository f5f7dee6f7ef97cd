"""BPE against the tokenizers library; packing against coverage and an exhaustive search."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sessionlens.llm import bpe, packing
from sessionlens.llm.queries import PIECES, piece_digests, tokenizer

TEXTS = [
    "", " ", "\n", "  a  b\n\n c ", "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "x\x1cy \x85z   q  w", "aaaaaaaa aaaa aaa",
    "don't I'll 're", "日本語 テスト 😀😀 é́", "\t\ta\r\n b ", "1234567 89", "a\x00b", "mm²Ⅷ ǅ ß", "ababab abab", " x  y", "Σίσυφος ΣΑΣ",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return lambda name: Tokenizer.from_file(tokenizer(name))


def test_ids_and_texts_equal_the_library(reference):
    t, own = reference("byte_bpe_50k.json"), bpe.PairIndexCoder(tokenizer("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab c\n.é'st😀") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    coded = own.encode(pa.array(texts))
    assert coded.to_pylist() == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert own.decode(coded).to_pylist() == texts
    assert own.encode(pa.array([], pa.string())).to_pylist() == []


def test_bytes_that_are_no_text_are_replaced(reference):
    t, own = reference("byte_bpe_50k.json"), bpe.PairIndexCoder(tokenizer("byte_bpe_50k.json"))
    broken = t.encode("😀", add_special_tokens=False).ids[:1]
    assert "�" in own.decode(pa.array([broken, None, []], pa.list_(pa.int32()))).to_pylist()[0]
    assert own.decode(pa.array([None, []], pa.list_(pa.int32()))).to_pylist() == [None, ""]


def test_encode_on_odd_rows(odd, none, clash, reference):
    path = tokenizer("byte_bpe_50k.json")
    t = reference("byte_bpe_50k.json")
    rows = bpe.encode_decode(odd, path).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == t.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    assert bpe.decode(bpe.encode(odd, path), path).count() == len(rows)
    assert bpe.encode_decode(none, path).count() == 0
    assert bpe.encode_decode(clash, path).where("key = 'mine' and ids is not null").count() == len(rows)


def check_pieces(rows, texts, tokenizer_):
    ids = {i: tokenizer_.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts}
    docs, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own) and r["length"] == len(part) > 0
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(docs) == set(ids)
    for spans, total in [(docs[i], len(ids[i])) for i in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 4096 if total is None else at == total
    return sequences


def test_packing_covers_every_token_once(spark, make, none, reference):
    path = tokenizer("word_bpe_49k.json")
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    texts = [(i, " ".join(word() + rng.choice(["", "", "", ".", "\n", "<|endoftext|>"]) for _ in range(rng.randint(0, 400)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "x " * 30000), (103, TEXTS[3]), (104, TEXTS[6]), (105, "Σίσυφος ΣΑΣ É É x"), (None, "no id")]
    odd = "<|ENDOFTEXT|> Ab. <|endoftext|> AB! \u0130I \u212a \u1e9e \u01c5 It's IT'S. 'S x'. y.' z**. $5,000. a\u0301. b.\u0301 \u00c9. "
    texts += [(106, odd), (107, "word.<|endoftext|> word|> End|. \u00e9. \u00c9!\x85x. \x1c y. "), (108, odd.replace("\u0130", "")), (109, odd[14:].replace("\u0130", ""))]
    for part in [texts, *([t] for t in texts[-4:])]:
        check_pieces(packing.packed(make(part), path, finish=piece_digests, schema=PIECES).collect(), part, reference("word_bpe_49k.json"))
    assert packing.packed(none, path, finish=piece_digests, schema=PIECES).count() == 0


def test_short_stretches_give_whole_documents_too(spark, make, reference, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 9000)
    texts = [(i, "some words here. " * (i * 7)) for i in range(40)]
    import pyspark.cloudpickle as cloudpickle

    cloudpickle.register_pickle_by_value(packing)  # workers get the changed limit
    try:
        rows = packing.packed(make(texts), tokenizer("word_bpe_49k.json"), finish=piece_digests, schema=PIECES).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(packing)
    sequences = check_pieces(rows, texts, reference("word_bpe_49k.json"))
    filled = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(filled) / sum(n if n & (n - 1) == 0 else 4096 for n in filled) > 0.95


def test_repeated_rows_are_packed_each(spark, odd):
    rows = packing.packed(odd, tokenizer("word_bpe_49k.json")).collect()
    assert sum(r["start"] == 0 for r in rows) == odd.count()
    assert all(len(r["ids"]) > 0 for r in rows)


def test_every_sentence_end_is_a_cut(reference):
    texts = ["今天很好。我们去公园！「好吗？」是", 'Yes. "Why?" They said 3.14 now. e.g.x No! (Really.) end', "a b. c", "", "क्या है। नहीं।", "短。" * 3000, "短。" * 3000]
    ends = re.compile(r"""[.!?。！？।]["'”’)」]*(?=\s|$)|[。！？।]["'”’)」]*""")
    ids, sizes, marks = packing.ChunkTokens(tokenizer("word_bpe_49k.json")).encode(pa.array(texts), 2)
    at = 0
    for text, n in zip(texts, sizes.tolist()):
        coded = reference("word_bpe_49k.json").encode(text, add_special_tokens=False)
        assert ids[at : at + n].tolist() == [*coded.ids, 2]
        wanted = {m.end() for m in ends.finditer(text)}
        until = [j for _, j in coded.offsets]
        last = [k + 1 == len(until) or until[k + 1] > until[k] for k in range(len(until))]
        assert marks[at : at + n].tolist() == [j in wanted and k for j, k in zip(until, last)] + [True], text
        at += n
    cuts, penalty = packing.allowed_cuts(sizes, marks)
    assert set((np.flatnonzero(marks) + 1).tolist()) <= set(cuts.tolist())
    assert (penalty[np.isin(cuts, np.flatnonzero(marks) + 1)] <= packing.SENTENCE_CUT).all()


def test_plain_chunks_have_the_ids_of_the_library(reference):
    t, own = reference("word_bpe_49k.json"), packing.ChunkTokens(tokenizer("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(0x21, 0xFFFF)) if not 0xD800 <= ord(c) < 0xE000]
    taken = own.plain.takes(pa.array(letters))
    kept = [c for c, k in zip(letters, taken.tolist()) if k]
    assert {*"az09!~'éßñ。中あ가жλ"} <= set(kept) and not {*"AZÉ\x7f\u0130\u01c5\u0301\u3000\u00a0"} & set(kept)
    rng = random.Random(7)
    chunks = [f for c in kept for f in (c, "x" + c, c + "e", "7" + c + "'s")]
    chunks += ["".join(rng.choices(kept, k=rng.randint(1, 12))) for _ in range(3000)]
    chunks += ["".join(rng.choices("aehinrst'.,1", k=rng.randint(1, 40))) for _ in range(3000)]
    chunks += ["", "'", "''s", "it's", "we'll've", "'re'd", "a1b22c", "x" * 5000, "ab" * 3000, "!" * 700, "日本語。テスト！", "(r.t.)"]
    assert own.plain.takes(pa.array(chunks)).all()
    ids, sizes = own.plain.encode(pa.array(chunks))
    wanted = [e.ids for e in t.encode_batch(chunks, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_only_chunks_that_are_not_plain_go_through_the_library(reference):
    own, asked = packing.ChunkTokens(tokenizer("word_bpe_49k.json")), []
    call = own.call
    own.call = lambda chunks: asked.extend(chunks) or call(chunks)
    texts = ["Some words, some more. It's 3.14! Größe 日本語", "e\u0301 and x<|endoftext|>y", "", None, "\u0130 AB cd"]
    for part in (texts[:1], texts):
        ids, sizes, _ = own.encode(pa.array(part, pa.string()), 2)
        assert ids.tolist() == [i for x in part for i in [*reference("word_bpe_49k.json").encode(x or "", add_special_tokens=False).ids, 2]]
        assert len(part) > 1 or not asked
    assert {"e\u0301", "x<|endoftext|>y", "AB", "\u0130"} <= set(asked) and not {"cd", "some", "and"} & set(asked)


def test_other_rules_leave_all_chunks_to_the_library(reference, tmp_path):
    import json

    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as file:
        content = json.load(file)
    assert packing.PlainCoder.fits(content)
    content["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[\p{L}]+|[^\s\p{L}]+"}
    assert not packing.PlainCoder.fits(content)
    (tmp_path / "other.json").write_text(json.dumps(content), encoding="utf-8")
    own = packing.ChunkTokens(str(tmp_path / "other.json"))
    assert own.plain is None
    ids, _, _ = own.encode(pa.array(["It's 1999, don't."]), 2)
    assert ids.tolist() == [*own.tokenizer.encode("It's 1999, don't.", add_special_tokens=False).ids, 2]


def test_whole_finds_tokens_that_their_letters_do_not_make():
    rng, seen = random.Random(11), set()
    for _ in range(3000):
        n, merges = rng.randint(1, 3), []
        spelled = [(k,) for k in range(n)]
        for _ in range(rng.randint(1, 5)):
            pair = rng.randrange(len(spelled)), rng.randrange(len(spelled))
            if spelled[pair[0]] + spelled[pair[1]] not in spelled:
                merges.append(pair)
                spelled.append(spelled[pair[0]] + spelled[pair[1]])

        def merged(token):
            while True:
                known = [(merges.index(p), k) for k, p in enumerate(zip(token, token[1:])) if p in merges]
                if not known:
                    return token
                made, k = min(known)
                token = [*token[:k], n + made, *token[k + 2 :]]

        wanted = all(merged(list(s)) == [i] for i, s in enumerate(spelled))
        assert packing.whole(merges, n) == wanted, (n, merges)
        seen.add(wanted)
    assert seen == {True, False} and not packing.whole([(1, 2)], 1)


def exhaustive(at, penalty, window):
    best = [0] + [None] * (len(at) - 1)
    for i in range(1, len(at)):
        options = []
        for j in range(i):
            n = at[i] - at[j]
            if n <= window:
                options.append(best[j] + (0 if n & (n - 1) == 0 else window - n) + penalty[i])
        best[i] = min(options)
    return best[-1]


def test_cuts_are_the_best():
    rng = random.Random(5)
    for _ in range(200):
        window = rng.choice([8, 16])
        at = [0]
        for _ in range(rng.randint(1, 12)):
            at.append(at[-1] + rng.randint(1, window))
        penalty = [rng.randint(0, 5) for _ in at]
        cuts, cost, before = packing.best_cuts(at, penalty, window), 0, 0
        for i in cuts:
            n = at[i] - before
            assert 0 < n <= window
            cost += (0 if n & (n - 1) == 0 else window - n) + penalty[i]
            before = at[i]
        assert before == at[-1] and cost == exhaustive(at, penalty, window)

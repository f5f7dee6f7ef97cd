"""One query per operator, over whole tables. Digest columns are derived here from the operators' own results."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm import alignment, bpe, fingerprints, language, line_templates, mixing, near_dups, packing, privacy, quality, rules, sharding, spelling
from sessionlens.llm.common import fold, table
from sessionlens.llm.registry import query


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, tokenizer("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '!!+', '', 'g')) AS n_marks,
         length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) AS n_upper,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_adjacent
  FROM w),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
f AS (
  SELECT *,
    (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_upper > 50 * word_chars THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_marks > 40 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN 100 * n_adjacent > 30 * n_words THEN 64 ELSE 0 END)
    + (CASE WHEN word_chars > 40 * n_words THEN 128 ELSE 0 END) AS failed
  FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  failed = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM f
"""


@query("op3_rules", OP3_SQL)
def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = rules.Policy("base", 1, rules.BASE)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.verdict(base)).alias("base_failed"),
        (rules.verdict(base) & rules.verdict(rules.STRICT)).alias("kept"),
        "failed",
    )


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def piece_digests(pieces: pa.RecordBatch) -> pa.RecordBatch:
    """Pieces with their length and the crc32 of their ids in place of the ids."""
    ids = pieces.column("ids")
    at = ids.offsets.to_numpy()
    raw = memoryview(ids.values.to_numpy().astype("<u4").tobytes())
    sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at.tolist(), at[1:].tolist())]
    columns = {
        "doc_id": pieces.column("doc_id"), "start": pieces.column("start"), "length": pa.array(at[1:] - at[:-1], pa.int64()),
        "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": pieces.column("doc_tokens"),
        "sequence_id": pieces.column("sequence_id"), "offset": pieces.column("offset"),
    }
    return pa.RecordBatch.from_pydict(columns)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), finish=piece_digests, schema=PIECES)


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_dups.near_duplicates(near_dups.simhash(docs, words=3), bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    as_text = lambda name: F.lower(F.hex(name)).alias(name)
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("fingerprint"),
        as_text("edited_fingerprint"), "near_edited", "near_next",
    )


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    scored = quality.classify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language.fit(docs, fold(F.col("doc_id"), 4) != 2)
    found = language.identify(docs.select("doc_id", "text"), filters)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


@query("op1_privacy")
def op1_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.private_spans(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k) for k in privacy.KINDS))
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{privacy.KINDS[kind]}")

    counts = [count(k) for k in range(4)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


@query("op8_lines")
def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.without_recurring_lines(docs)


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.aligned(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *alignment.NUMBERS, "n_best", "count_sum", digest)


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), damaged=spelling.DAMAGED)


@query("op13_mixing")
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")

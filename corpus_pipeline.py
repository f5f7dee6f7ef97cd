"""From raw documents to packed training sequences: the stages and the run that chains them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet into the shared
folder and gives the next stage what it reads back. Stages but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm import line_templates, near_dups, packing, privacy, quality
from sessionlens.llm.common import fold, table
from sessionlens.llm.queries import PIECES, piece_digests, tokenizer
from sessionlens.llm.registry import query
from sessionlens.session import stage


def recounted(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``; ``n_chars`` follows the text where there is one."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    return quality.classify(docs, model).where("predicted = 1").select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template an earlier document has."""
    return recounted(docs, line_templates.without_recurring_lines(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return near_dups.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and words that disclose it masked."""
    return recounted(docs, privacy.sanitised(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), finish=piece_digests, schema=PIECES)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", fresh_lines),
    ("near_dedup", distinct_documents),
    ("pii", private),
    ("packing", sequences),
]
#: Learned scores, hashes of shingles and a tokenizer's ids have no SQL form.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

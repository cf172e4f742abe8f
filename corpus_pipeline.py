"""A corpus pipeline: quality, language, near duplicates, repeated passages, packing.

Each stage takes (spark, documents, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. `run` applies them in order to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import ballhash, langid, packing, quality, rlindex
from tabulon.llm.common import ensure_checkpoint_dir, table

#: Repeated strings of PASSAGE bytes are looked for, and runs of them of more than WORDS words go. op10 has a length of its own.
PASSAGE, WORDS = 200, 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.filtered(docs, quality.learn(docs))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    return langid.filtered(docs, langid.learn(docs, ~langid.held_out()))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id."""
    return ballhash.representatives(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of more than WORDS words that repeat in the corpus."""
    return rlindex.trimmed(docs, PASSAGE, words=WORDS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeated_passage_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of sequences that the documents which are kept make; nothing if none is."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

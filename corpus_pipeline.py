"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents,
every row as it was. The caller writes each result and gives it to the next stage.

Defined results, for every stage: a null text counts as empty; each row is decided by its own text, also where rows share a
doc_id; a row without a doc_id comes after all others of its group; ties and repeated rows share their fate; further columns
are carried along; an empty table gives an empty result. An empty text is scored like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucerna.llm.common import table
from lucerna.llm.decontaminate import keep_uncontaminated
from lucerna.llm.exact_dedup import keep_first
from lucerna.llm.ngram_join import keep_first_of_near
from lucerna.llm.piece_codec import encode_documents
from lucerna.llm.quality import keep_quality
from lucerna.llm.queries import model_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below its threshold."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the smallest doc_id stays."""
    return keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join, the smallest doc_id stays."""
    return keep_first_of_near(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return encode_documents(docs, model_path())


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("encoding", encoding),
]

#: A trained classifier and a tokenizer are no SQL; tests/llm/test_pipeline.py holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

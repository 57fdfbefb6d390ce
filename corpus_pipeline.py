"""A corpus pipeline: stages over ``documents``, each one operator of ``docmill.llm``, at production parameters.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``. A runner writes each stage's result as Parquet and reads it again as the next one's docs.

Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns of any name have the
results that each operator's docstring states; every stage but the last keeps the columns of its input as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.llm.bpe import encode_documents, word_bpe_path
from docmill.llm.common import cut, table
from docmill.llm.exact_dedup import exact_dedup
from docmill.llm.mixing import mixed_documents
from docmill.llm.near_dedup import near_dedup
from docmill.llm.quality import classify, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more); it learns from labels of its own input.
    Null texts are scored as empty ones; without labels all documents have one score."""
    rules = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, rules).where("predicted = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for the case of A-Z: the one with the largest id; null texts
    count as empty, null ids as the smallest."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more; that with
    the smallest id. Texts without words are near to nothing; rows with a null id stay."""
    return near_dedup(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets; a document that is taken twice is there twice. A null source is a source;
    documents without words are not taken."""
    return mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document of the mix; null texts have no tokens."""
    return encode_documents(docs, word_bpe_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("bpe", bpe)]

#: A trained classifier decides the first stage, so no SQL has these rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

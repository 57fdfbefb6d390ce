"""The indexes of the test tables' chunks and vectors: written once a session, read by all searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.stored_index import Index, Rows, write_index
from docmill.operators.vector_index import VectorIndex, write_vector_index
from docmill.plans.views import chunks, table
from docmill.sources.stored import temporary_folder

_WRITTEN: dict[tuple, Index] = {}
_VECTORS: dict[tuple, VectorIndex | None] = {}


def keyed_chunks(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    return chunks(spark, sf, docs).withColumn("ck", F.concat("chunk_id", F.lit("#"), F.col("document_id").cast("string")))


def with_chunks(spark: SparkSession, sf: str, hits: DataFrame, *columns: str) -> DataFrame:
    """Hits (ck, ...; few) with columns of their chunks. Only the documents that they name are cut into chunks."""
    named = hits.select(F.split_part("ck", F.lit("#"), F.lit(-1)).cast("long").alias("doc_id")).distinct()
    docs = table(spark, sf, "documents").join(F.broadcast(named), "doc_id", "left_semi")
    return hits.join(keyed_chunks(spark, sf, docs).select("ck", *columns), "ck")


def chunk_rows(spark: SparkSession, sf: str) -> Rows:
    """The chunks for searches of given words, which read them where they lie."""
    return Rows(keyed_chunks(spark, sf), "ck")


def chunk_index(spark: SparkSession, sf: str) -> Index:
    """The chunks with the words of their fields, without postings, for searches that need the whole vocabulary. Other files of ``documents`` are another index."""
    known = (spark.sparkContext.applicationId, *sorted(table(spark, sf, "documents").inputFiles()))
    if known not in _WRITTEN:
        _WRITTEN[known] = write_index(keyed_chunks(spark, sf), "ck", temporary_folder(spark), postings=False)
    return _WRITTEN[known]


def vector_index(spark: SparkSession, sf: str) -> VectorIndex | None:
    """The vectors by cell. Other files of ``embeddings`` are another index."""
    rows = table(spark, sf, "embeddings")
    known = (spark.sparkContext.applicationId, *sorted(rows.inputFiles()))
    if known not in _VECTORS:
        _VECTORS[known] = write_vector_index(rows, temporary_folder(spark), kept=("label",))
    return _VECTORS[known]

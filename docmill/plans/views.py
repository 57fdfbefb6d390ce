"""The test tables in the shapes that the operators work on: registry, pages, chunks, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as fx

PAGE, CHUNK = 1500, 500


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def file_name(doc_id):
    return F.concat(F.lit("Doc_"), doc_id.cast("string"), F.lit("_vol"), (doc_id % 3).cast("string"), F.lit(".pdf"))


def slices(docs: DataFrame, width: int) -> DataFrame:
    """Fixed slices of the text: ``_i`` from 0 on and ``_slice``; documents without text have none. A narrow map."""
    n = F.ceil(F.length("text") / width).cast("int")
    return docs.where(F.length("text") > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("_slice", F.col("text").substr(F.col("_i") * width + 1, F.lit(width)))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """document_id, document_name, category, page_number, text, file_path: one row per page of 1,500 characters."""
    d = slices(table(spark, sf, "documents"), PAGE)
    return d.select(F.col("doc_id").alias("document_id"), file_name(F.col("doc_id")).alias("document_name"), F.col("lang").alias("category"), (F.col("_i") + 1).alias("page_number"), F.col("_slice").alias("text"), F.col("source").alias("file_path"))


def chunks(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    """document_id, document_name, category, page_number, chunk_index, chunk_id, text: three chunks a page; of all documents, or of ``docs``."""
    d = slices(table(spark, sf, "documents") if docs is None else docs, CHUNK)
    page, index = F.floor(F.col("_i") / 3).cast("int") + 1, F.col("_i") % 3
    return d.select(F.col("doc_id").alias("document_id"), file_name(F.col("doc_id")).alias("document_name"), F.col("lang").alias("category"), page.alias("page_number"), index.alias("chunk_index"), F.format_string("%s_PAGE%03d_CHUNK%03d", F.col("doc_id").cast("string"), page, index).alias("chunk_id"), F.col("_slice").alias("text"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document as a file record: ids, name, path, category, pages, size, checksum, status, order."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    d = docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
    name = file_name(F.col("doc_id"))
    status = F.when(F.length("text") == 0, "empty").when(F.col("quality") == 0, "invalid").when(F.col("doc_id") % 97 == 0, "corrupted").otherwise("valid")
    return d.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("category"), name.alias("file_name"), F.concat("source", F.lit("/"), name).alias("relative_path"), F.ceil(F.length("text") / PAGE).cast("int").alias("pages"), F.octet_length("text").cast("long").alias("file_size_bytes"), F.sha2("text", 256).alias("checksum_sha256"), status.alias("status"))


NAME_SQL = "'Doc_' || doc_id || '_vol' || (doc_id % 3) || '.pdf'"
PAGES_SQL = f"""pages_v AS (
  SELECT doc_id AS document_id, {NAME_SQL} AS document_name, lang AS category, (i + 1)::INT AS page_number,
         substring(text, (i * 1500 + 1)::INT, 1500) AS text, source AS file_path
  FROM (SELECT *, unnest(range((length(text) + 1499) // 1500)) AS i FROM documents WHERE length(text) > 0)
)"""
CHUNKS_SQL = f"""chunks AS (
  SELECT doc_id AS document_id, {NAME_SQL} AS document_name, lang AS category, (i // 3 + 1)::INT AS page_number, (i % 3)::INT AS chunk_index,
         printf('%d_PAGE%03d_CHUNK%03d', doc_id, i // 3 + 1, i % 3) AS chunk_id, substring(text, (i * 500 + 1)::INT, 500) AS text
  FROM (SELECT *, unnest(range((length(text) + 499) // 500)) AS i FROM documents WHERE length(text) > 0)
)"""
REGISTRY_SQL = f"""registry AS (
  SELECT doc_id AS document_id, lang AS category, {NAME_SQL} AS file_name, source || '/' || {NAME_SQL} AS relative_path,
         ((length(text) + 1499) // 1500)::INT AS pages, strlen(text)::BIGINT AS file_size_bytes, sha256(text) AS checksum_sha256,
         CASE WHEN length(text) = 0 THEN 'empty' WHEN quality = 0 THEN 'invalid' WHEN doc_id % 97 = 0 THEN 'corrupted' ELSE 'valid' END AS status
  FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)
)"""

"""Incremental ingestion of documents into a chunk table, by versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import terms
from docmill.operators.extract import recursive_split


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string", files: int = 10, version: Column | None = None) -> DataFrame:
    """Documents in Parquet files that arrive in ``folder``, a few files a batch, with ``version`` (what is newer is larger; the file's time where
    the source gives none) and ``origin`` (the file)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    made = F.unix_micros(F.col("_metadata.file_modification_time")) if version is None else version.cast("long")
    return rows.select("*", made.alias("version"), F.col("_metadata.file_path").alias("origin"))


def ingest_to(path: str, key: str = "doc_id", size: int = 500, overlap: int = 100):
    """A ``foreachBatch`` function that adds a batch of documents (key, text, version, origin) to the tables in ``path``.

    Of a document's versions in a batch the newest is picked before it is chunked (ties by origin, then text). The batch writes folders of its own:
    ``chunks`` (chunk_id, pos, start, text), ``terms`` (how many chunks of the document hold a term) and last ``versions`` (a row a document: version,
    tombstone if its text is null or blank, chunks and words), which makes it visible. So work is that of the batch, whatever the tables' size, and a batch that is repeated after a
    failure replaces its own folders alone. Null keys are left out."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("version", "origin", F.coalesce("text", F.lit("")).alias("text"))).alias("v")).select(key, "v.*")
        newest.write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
        docs = spark.read.schema(newest.schema).parquet(f"{path}/documents/batch={number}")
        chunks = recursive_split(docs, [key], size, overlap).withColumn("chunk_id", F.format_string("%s_%05d", F.col(key).cast("string"), F.col("pos")))
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        chunks = spark.read.schema(chunks.schema).parquet(f"{path}/chunks/batch={number}")
        words = chunks.select(key, F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("chunks"))
        words.write.mode("overwrite").parquet(f"{path}/terms/batch={number}")
        sizes = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sum(F.size(terms(F.col("text")))).alias("words"))
        rows = docs.join(sizes, key, "left").select(key, "version", "origin", F.col("chunks").isNull().alias("tombstone"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chunks", "words")])
        rows.write.mode("overwrite").parquet(f"{path}/versions/batch={number}")

    return run


def latest(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """A row a document: its newest version (a version that came twice: the later batch's) and the batch that holds it; emptied documents too."""
    v = spark.read.parquet(f"{path}/versions")
    newest = v.groupBy(key).agg(F.max(F.struct("version", "origin", "batch", "tombstone", "chunks", "words")).alias("v"))
    return newest.select(key, "v.*")


def _of_latest(spark: SparkSession, path: str, name: str, key: str) -> DataFrame:
    live = latest(spark, path, key).where("NOT tombstone").select(key, "batch")
    return spark.read.parquet(f"{path}/{name}").join(live, [key, "batch"]).drop("batch")


def current(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The chunks of each document's newest version, and of no other; documents whose newest text is blank have none. Late, repeated and
    doubled documents change nothing but what they are newer than."""
    return _of_latest(spark, path, "chunks", key)


def statistics(spark: SparkSession, path: str, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Of the current chunks: term, df; and one row: chunks, mean_words. Sums of what each document's newest version has added: no text is read."""
    df = _of_latest(spark, path, "terms", key).groupBy("term").agg(F.sum("chunks").alias("df"))
    n = latest(spark, path, key).where("NOT tombstone").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), (F.sum("words") / F.sum("chunks")).alias("mean_words"))
    return df, n


def compact(spark: SparkSession, path: str, target: str, key: str = "doc_id") -> None:
    """Write what is current, tombstones too (so that older versions that come later stay out), as batch -1 to another folder, which takes the table's place."""
    for name in ("documents", "chunks", "terms"):
        _of_latest(spark, path, name, key).write.mode("overwrite").parquet(f"{target}/{name}/batch=-1")
    latest(spark, path, key).drop("batch").write.mode("overwrite").parquet(f"{target}/versions/batch=-1")

"""Statistics of registries, chunks, question sets and evaluations: partial aggregates, no lists of rows."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def _mean(total: Column, n: Column, places: int = 2) -> Column:
    return F.round(F.when(n > 0, total / n).otherwise(0.0), places)


def dataset_statistics(registry: DataFrame) -> DataFrame:
    """One row: counts by status, mean pages of valid files, sizes, largest and smallest valid file (first wins)."""
    valid = F.col("status") == "valid"
    pages = F.when(valid, F.col("pages"))
    top = F.max(F.when(valid, F.struct("pages", (-F.col("document_id")).alias("o"), "file_name")))
    low = F.min(F.when(valid, F.struct("pages", F.col("document_id").alias("o"), "file_name")))
    a = registry.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "invalid", "corrupted", "empty", "duplicate")],
        F.sum(pages).alias("_p"), F.sum("file_size_bytes").alias("total_bytes"), top.alias("_top"), low.alias("_low"),
    )
    return a.select("total", "valid", "invalid", "corrupted", "empty", "duplicate", _mean(F.col("_p"), F.col("valid")).alias("mean_pages"), "total_bytes", _mean(F.col("total_bytes"), F.col("total")).alias("mean_bytes"), F.col("_top.file_name").alias("largest"), F.col("_low.file_name").alias("smallest"), _mean(F.col("valid") * 100.0, F.col("total")).alias("valid_percent"))


def category_statistics(registry: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category of the dimension, also those without files."""
    a = registry.groupBy("category").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status").isin("invalid", "corrupted", "empty")).alias("invalid"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate"), F.sum(F.when(F.col("status") == "valid", F.col("pages"))).alias("pages"), F.sum("file_size_bytes").alias("bytes"),
    )
    return categories.join(a, "category", "left").na.fill(0)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, mean, longest and shortest characters, chunks per page as a map."""
    per_page = chunks.groupBy("document_id", "page_number").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("s"), F.max(F.length("text")).alias("hi"), F.min(F.length("text")).alias("lo"))
    entries = F.sort_array(F.collect_list(F.struct("page_number", "n")))
    return per_page.groupBy("document_id").agg(F.sum("n").alias("chunks"), F.round(F.sum("s") / F.sum("n"), 2).alias("mean_chars"), F.max("hi").alias("max_chars"), F.min("lo").alias("min_chars"), F.map_from_entries(entries).alias("chunks_per_page"))


def corpus_chunk_statistics(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Over all documents: totals, mean over chunks, longest, shortest, documents without a chunk."""
    a = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("with_chunks"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"), F.max(F.length("text")).alias("max_chars"), F.min(F.length("text")).alias("min_chars"))
    n = documents.agg(F.count("*").alias("documents"))
    return a.crossJoin(F.broadcast(n)).select("*", (F.col("documents") - F.col("with_chunks")).alias("failed"))


def index_statistics(chunks: DataFrame, reason: Column, key: str = "chunk_id") -> DataFrame:
    """Attempted, indexed, failed: rows with a reason, and all but the first row of a key."""
    n = chunks.select(key, reason.alias("_r")).groupBy(key).agg(F.count("*").alias("n"), F.max(F.when(F.col("_r").isNull(), 1).otherwise(0)).alias("good"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("attempted"), F.coalesce(F.sum("good"), F.lit(0)).alias("indexed")).withColumn("failed", F.col("attempted") - F.col("indexed"))


def write_indexed(rows: DataFrame, reason: Column, path: str, key: str = "chunk_id", order: str = "page_number", vector: str | None = None) -> DataFrame:
    """Write the first row of each key among those without a ``reason`` as a table, and give one row of statistics that the write measures
    of itself (no second scan, first by ``order``): attempted, indexed, failed (a reason, a null key or a repeated one), seconds, ms_per_row, and the ``dimension`` of its vectors."""
    seen, put = Observation(), Observation()
    marked = rows.withColumn("_reason", reason).observe(seen, F.count(F.lit(1)).alias("attempted"))
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    first = F.min_by(whole, F.struct(order, F.xxhash64(F.to_json(whole))))
    good = marked.where(F.col("_reason").isNull() & F.col(key).isNotNull()).groupBy(key).agg(first.alias("_row")).select("_row.*")
    width = F.max(F.lit(None).cast("int") if vector is None else F.size(vector))
    began = time.monotonic()
    good.observe(put, F.count(F.lit(1)).alias("indexed"), width.alias("dimension")).write.parquet(path)
    seconds, attempted, indexed = time.monotonic() - began, seen.get["attempted"], put.get["indexed"]
    told = (attempted, indexed, attempted - indexed, seconds, 1000 * seconds / max(indexed, 1), put.get["dimension"])
    return rows.sparkSession.createDataFrame([told], "attempted long, indexed long, failed long, seconds double, ms_per_row double, dimension int")


def golden_statistics(golden: DataFrame) -> DataFrame:
    """Per category (rejected rows left out): totals by status, mean query and answer length of valid rows, sources."""
    valid = F.col("status") == "valid"
    rows = golden.where("status <> 'rejected'").withColumn("category", F.coalesce("category", F.lit("Unknown")))
    return rows.groupBy("category").agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(F.col("status") == "invalid").alias("invalid"), F.count_if(F.col("status") == "duplicate").alias("duplicate"), F.round(F.avg(F.when(valid, F.length("query"))), 2).alias("mean_query"), F.round(F.avg(F.when(valid, F.length("expected_answer"))), 2).alias("mean_answer"), F.countDistinct(F.when(valid, F.col("source_document"))).alias("sources"))


def validation_report(golden: DataFrame) -> DataFrame:
    """Errors by field and code over rows with ``errors`` (array of structs), with the rows that have them."""
    return golden.select("row_number", F.explode("errors").alias("e")).groupBy("e.field_name", "e.error_code").agg(F.count("*").alias("errors"), F.countDistinct("row_number").alias("rows"))


def keyword_top_n(chunks: DataFrame, pattern: str, stopwords, least: int = 4, most: int = 15, key: str = "chunk_key") -> DataFrame:
    """Per chunk: its most frequent words of at least ``least`` letters without stop words; ties by first occurrence."""
    words = chunks.select(key, F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(pattern), 1)).alias("pos", "word"))
    words = words.withColumn("word", F.lower("word")).where((F.length("word") >= least) & ~F.col("word").isin(*stopwords))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "pos"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).drop("pos")


def document_keywords(keywords: DataFrame, document: str, most: int = 20) -> DataFrame:
    """Per document: words by the number of chunk lists that hold them; ties by the first chunk, then rank."""
    counts = keywords.groupBy(document, "word").agg(F.count("*").alias("n"), F.min(F.struct("chunk_key", "rank")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(document).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).drop("first")


def knowledge_rollup(found: DataFrame, document: str = "document_id") -> DataFrame:
    """Per document: distinct entities (type, folded text) at their best confidence, as counts and a sorted list."""
    best = found.groupBy(document, "kind", F.lower("matched").alias("folded")).agg(F.max("confidence").alias("confidence"), F.countDistinct("chunk_key").alias("chunks"))
    one = F.concat_ws(":", "kind", "folded")
    return best.groupBy(document).agg(F.count("*").alias("entities"), F.sum("chunks").alias("mentions"), F.round(F.max("confidence"), 2).alias("best"), F.array_join(F.sort_array(F.collect_list(one)), ",").alias("entity_list"))


def knowledge_totals(rollup: DataFrame, category: str = "category") -> DataFrame:
    return rollup.groupBy(category).agg(F.count("*").alias("documents"), F.sum("entities").alias("entities"), F.sum("mentions").alias("mentions"))


def evaluation_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of the metrics over all questions (with ``latency_ms``, of that too, as mean_latency_ms) and counts by status."""
    means = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    if "latency_ms" in rows.columns:
        means.append(F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"))
    return rows.agg(F.count("*").alias("questions"), *means, *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Pass", "Partial", "Failed")])


def answer_confidence(hits: DataFrame, citations: DataFrame) -> DataFrame:
    """Per question with hits: half the mean score, 0.3 times the cited share of retrieved documents, 0.2 times
    citations/3 (1 at most); between 0 and 1, two decimals."""
    got = hits.groupBy("qid").agg(F.avg("score").alias("mean"), F.collect_set(F.lower("document_name")).alias("got"))
    cited = citations.groupBy("qid").agg(F.collect_set(F.lower("document_name")).alias("cited"), F.count("*").alias("n"))
    j = got.join(cited, "qid", "left")
    cover = F.coalesce(F.size(F.array_intersect("got", "cited")), F.lit(0)) / F.size("got")
    value = 0.5 * F.col("mean") + 0.3 * F.when(F.col("cited").isNull(), 0.0).otherwise(cover) + 0.2 * F.least(F.coalesce("n", F.lit(0)) / 3.0, F.lit(1.0))
    return j.select("qid", F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 2).alias("confidence"))

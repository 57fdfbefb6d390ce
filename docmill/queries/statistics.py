"""Queries of statistics, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.registry import query
from docmill.functions import patterns as pt
from docmill.functions import text as fx
from docmill.operators import aggregate as ag
from docmill.operators import checks, dedup
from docmill.sources import bucketed
from docmill.sources.stored import temporary_folder
from docmill.plans.views import CHUNKS_SQL, PAGES_SQL, REGISTRY_SQL, chunks, pages, registry, table


@query("a1_dataset_statistics", f"""WITH {REGISTRY_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'corrupted') AS corrupted,
  count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'duplicate') AS duplicate, round(avg(pages) FILTER (status = 'valid'), 2) AS mean_pages, sum(file_size_bytes)::BIGINT AS total_bytes, round(avg(file_size_bytes), 2) AS mean_bytes,
  first(file_name ORDER BY pages DESC, document_id) FILTER (status = 'valid') AS largest, first(file_name ORDER BY pages, document_id) FILTER (status = 'valid') AS smallest, round(100.0::DOUBLE * count(*) FILTER (status = 'valid') / count(*), 2) AS valid_percent FROM registry""")
def _(spark, sf):
    return ag.dataset_statistics(registry(spark, sf))


@query("a2_category_statistics", f"""WITH {REGISTRY_SQL}, dim AS (SELECT DISTINCT lang AS category FROM documents UNION ALL SELECT 'none')
SELECT d.category, count(document_id) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status IN ('invalid', 'corrupted', 'empty')) AS invalid, 0::BIGINT AS duplicate,
  coalesce(sum(pages) FILTER (status = 'valid'), 0)::BIGINT AS pages, coalesce(sum(file_size_bytes), 0)::BIGINT AS bytes FROM dim d LEFT JOIN registry r ON r.category = d.category GROUP BY d.category""")
def _(spark, sf):
    r = registry(spark, sf)
    dim = r.select("category").distinct().unionByName(spark.range(1).select(F.lit("none").alias("category")))
    return ag.category_statistics(r, dim)


@query("a3_chunk_statistics", f"""WITH {CHUNKS_SQL}, p AS (SELECT document_id, page_number, count(*) AS n, sum(length(text)) AS s, max(length(text)) AS hi, min(length(text)) AS lo FROM chunks GROUP BY ALL)
SELECT document_id, sum(n)::BIGINT AS chunks, round(sum(s)::DOUBLE / sum(n), 2) AS mean_chars, max(hi)::INT AS max_chars, min(lo)::INT AS min_chars, string_agg(page_number || '=' || n, ',' ORDER BY page_number) AS per_page FROM p GROUP BY document_id""")
def _(spark, sf):
    s = ag.chunk_statistics(chunks(spark, sf))
    shown = F.array_join(F.transform(F.map_entries("chunks_per_page"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return s.select("document_id", "chunks", "mean_chars", "max_chars", "min_chars", shown.alias("per_page"))


@query("a4_corpus_chunk_statistics", f"WITH {CHUNKS_SQL} SELECT count(*) AS chunks, count(DISTINCT document_id) AS with_chunks, round(avg(length(text)), 2) AS mean_chars, max(length(text))::INT AS max_chars, min(length(text))::INT AS min_chars, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents) - count(DISTINCT document_id) AS failed FROM chunks")
def _(spark, sf):
    return ag.corpus_chunk_statistics(chunks(spark, sf), table(spark, sf, "documents"))


@query("a5_index_statistics", f"WITH {CHUNKS_SQL} SELECT count(*) AS attempted, count(*) FILTER (length(trim(text)) >= 10) AS indexed, count(*) - count(*) FILTER (length(trim(text)) >= 10) AS failed FROM chunks")
def _(spark, sf):
    c = chunks(spark, sf)
    return ag.index_statistics(c, checks.first_index_error(F.col("chunk_id"), F.col("document_id").cast("string"), F.col("text"), F.col("document_name"), F.col("category")))


@query("a8_keywords_of_chunks", f"""WITH {CHUNKS_SQL}, w AS (SELECT chunk_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT chunk_id, regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC\\pM]', '_', 'g'), '\\b([a-zA-Z][a-zA-Z\\-'']*)\\b', 1) AS ws FROM chunks)),
c AS (SELECT chunk_id AS chunk_key, lower(word) AS word, count(*) AS n, min(pos) AS pos FROM w WHERE length(word) >= 4 AND lower(word) NOT IN ({', '.join(f"'{x}'" for x in pt.STOPWORDS)}) GROUP BY ALL)
SELECT chunk_key, word, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_key ORDER BY n DESC, pos) AS rank FROM c) WHERE rank <= 15""")
def _(spark, sf):
    return ag.keyword_top_n(chunks(spark, sf).withColumnRenamed("chunk_id", "chunk_key"), pt.KEYWORD, pt.STOPWORDS)


@query("a9_keywords_of_documents", f"""WITH {CHUNKS_SQL}, w AS (SELECT document_id, chunk_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT document_id, chunk_id, regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC\\pM]', '_', 'g'), '\\b([a-zA-Z][a-zA-Z\\-'']*)\\b', 1) AS ws FROM chunks)),
c AS (SELECT document_id, chunk_id AS chunk_key, lower(word) AS word, count(*) AS n, min(pos) AS pos FROM w WHERE length(word) >= 4 AND lower(word) NOT IN ({', '.join(f"'{x}'" for x in pt.STOPWORDS)}) GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_key ORDER BY n DESC, pos) AS rank FROM c) WHERE rank <= 15),
d AS (SELECT document_id, word, count(*) AS n, min(chunk_key || lpad(rank::VARCHAR, 3, '0')) AS f FROM k GROUP BY ALL)
SELECT document_id, word, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f) AS rank FROM d) WHERE rank <= 20""")
def _(spark, sf):
    c = chunks(spark, sf).withColumnRenamed("chunk_id", "chunk_key")
    k = ag.keyword_top_n(c, pt.KEYWORD, pt.STOPWORDS).join(c.select("chunk_key", "document_id"), "chunk_key")
    return ag.document_keywords(k, "document_id")


@query("w1_dedup_chunks", f"""WITH {CHUNKS_SQL}, c AS (SELECT *, lower(trim(text)) AS cleaned FROM chunks), k AS (SELECT *, row_number() OVER (PARTITION BY document_id, cleaned ORDER BY page_number, chunk_index) AS n FROM c)
SELECT document_id, page_number, chunk_index, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY chunk_index) - 1)::INT AS new_index FROM k WHERE n = 1""")
def _(spark, sf):
    return dedup.dedup_chunks(chunks(spark, sf), F.lower(F.trim("text"))).select("document_id", "page_number", "chunk_index", "new_index")


@query("w2_dedup_by_chunk_id", f"WITH {CHUNKS_SQL} SELECT left(chunk_id, 9) AS cid, min(document_id) AS document_id, count(*) AS copies FROM chunks GROUP BY 1")
def _(spark, sf):
    c = chunks(spark, sf).withColumn("cid", F.substring("chunk_id", 1, 9))
    kept = dedup.first_rows(c, ["cid"], ["document_id", "page_number", "chunk_index"]).select("cid", "document_id")
    return kept.join(dedup.repeated_keys(c, "cid"), "cid", "left").select("cid", "document_id", F.coalesce("n", F.lit(1)).alias("copies"))


@query("w3_mark_duplicate_files", f"""WITH {REGISTRY_SQL} SELECT document_id, CASE WHEN f <> document_id THEN 'duplicate' ELSE status END AS status, CASE WHEN f <> document_id THEN f END AS is_duplicate_of
FROM (SELECT *, first_value(document_id) OVER (PARTITION BY checksum_sha256 ORDER BY relative_path, document_id) AS f FROM registry)""")
def _(spark, sf):
    return dedup.mark_duplicate_files(registry(spark, sf)).select("document_id", "status", "is_duplicate_of")


@query("w4_mark_duplicate_questions", "SELECT event_id, row_number() OVER (PARTITION BY lower(trim(event_type || user_id)) ORDER BY event_id) > 1 AS is_duplicate FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("query", F.concat("event_type", F.col("user_id").cast("string")))
    return dedup.mark_duplicate_questions(e, order="event_id").select("event_id", "is_duplicate")


@query("w5_w6_top_k", "SELECT user_id AS qid, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def _(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "qid")
    return dedup.top_k(e, 5, "value", "event_id").select("qid", "event_id", "rank")


@query("w7_best_per_document", f"""WITH {CHUNKS_SQL}, h AS (SELECT category AS qid, document_name, page_number, chunk_id, row_number() OVER (PARTITION BY category ORDER BY length(text) DESC, chunk_id, document_id) AS rank FROM chunks),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, lower(document_name), page_number ORDER BY rank) AS n FROM h) WHERE n = 1)
SELECT qid, document_name, page_number, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY qid, lower(document_name) ORDER BY (page_number = 1)::INT, rank) AS m FROM o) WHERE m = 1""")
def _(spark, sf):
    c = chunks(spark, sf).withColumn("qid", F.col("category")).withColumn("score", F.length("text"))
    c = c.withColumn("tie", F.struct("chunk_id", "document_id"))
    return dedup.best_per_document(dedup.ranked(c, "score", "tie")).select("qid", "document_name", "page_number", "chunk_id")


@query("w8_context_budget", rf"""WITH {CHUNKS_SQL} SELECT document_id, chunk_id, words FROM (SELECT *, (sum(len(regexp_extract_all(text, '\S+'))) OVER (PARTITION BY document_id ORDER BY page_number, chunk_index ROWS UNBOUNDED PRECEDING))::BIGINT AS words FROM chunks) WHERE words <= 300""")
def _(spark, sf):
    return dedup.context_budget(chunks(spark, sf), "document_id", ["page_number", "chunk_index"], 300).select("document_id", "chunk_id", "words")


@query("w9_last_exchanges", """WITH p AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM p WHERE role = 'user' AND nr = 'assistant')
SELECT conv_id, string_agg('Q: ' || text, chr(10) ORDER BY turn) AS history FROM q WHERE back <= 2 GROUP BY conv_id""")
def _(spark, sf):
    return dedup.history(dedup.last_exchanges(table(spark, sf, "conversations"), 2))


@query("w10_select_source_pages", f"""WITH {PAGES_SQL}, p AS (SELECT *, length(trim(text)) > 1000 AND NOT (contains(upper(text), 'TABLE I') AND length(text) < 1200) AS good FROM pages_v)
SELECT document_id, page_number, pick::INT AS pick FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY good DESC, CASE WHEN good THEN (page_number < 2)::INT END NULLS FIRST, CASE WHEN NOT good THEN -length(text) END NULLS FIRST, page_number) AS pick FROM p) WHERE pick <= 3""")
def _(spark, sf):
    return dedup.select_pages(pages(spark, sf), checks.boilerplate(F.col("text"), ("TABLE I",)), F.lit(2)).select("document_id", "page_number", "pick")


@query("w12_assign_split", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '7'), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, CASE WHEN i <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""")
def _(spark, sf):
    return dedup.assign_split(table(spark, sf, "documents"), "doc_id", "lang", (0.8, 0.1, 0.1)).select("doc_id", "split")


@query("w13_sort_and_page", f"WITH {REGISTRY_SQL} SELECT document_id, file_name FROM registry ORDER BY coalesce(category, ''), file_name DESC LIMIT 20 OFFSET 40")
def _(spark, sf):
    r = registry(spark, sf)
    return checks.page_of(r, [F.coalesce("category", F.lit("")), F.desc("file_name")], 3, 20).select("document_id", "file_name")


@query("u1_union_all", f"WITH {REGISTRY_SQL} SELECT document_id, category, 'scan' AS origin FROM registry WHERE category = 'en' UNION ALL SELECT document_id, category, 'scan' FROM registry WHERE category = 'de' UNION ALL SELECT document_id, category, 'cache' FROM registry WHERE status = 'valid'")
def _(spark, sf):
    r = registry(spark, sf).select("document_id", "category", "status")
    part = lambda c, o: r.where(c).select("document_id", "category", F.lit(o).alias("origin"))
    return part("category = 'en'", "scan").unionByName(part("category = 'de'", "scan")).unionByName(part("status = 'valid'", "cache"))


@query("u2_difference", "SELECT source, count(*) AS n FROM (SELECT DISTINCT source, lang FROM documents EXCEPT SELECT source, lang FROM documents WHERE doc_id % 10 = 3) GROUP BY source")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("source", "lang").distinct().join(d.where("doc_id % 10 = 3").select("source", "lang").distinct(), ["source", "lang"], "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("s13_upsert_by_key", f"""WITH {CHUNKS_SQL}, n AS (SELECT chunk_id, document_id, text || '!' AS text FROM chunks WHERE document_id % 5 = 0) SELECT chunk_id, document_id, sha256(text) AS h FROM (SELECT chunk_id, document_id, text FROM chunks WHERE document_id % 5 <> 0 UNION ALL SELECT * FROM n)""")
def _(spark, sf):
    from docmill.sources.tables import upsert

    old = chunks(spark, sf).select("chunk_id", "document_id", "text")
    new = old.where("document_id % 5 = 0").withColumn("text", F.concat("text", F.lit("!")))
    return upsert(old, new, ["chunk_id"]).select("chunk_id", "document_id", F.sha2("text", 256).alias("h"))


@query("s14_delete_by_document", f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id FROM chunks WHERE document_id % 9 <> 4")
def _(spark, sf):
    from docmill.sources.tables import delete_documents

    gone = table(spark, sf, "documents").where("doc_id % 9 = 4").select(F.col("doc_id").alias("document_id"))
    return delete_documents(chunks(spark, sf), gone).select("chunk_id", "document_id")


@query("s13_stored_upsert", f"""WITH {CHUNKS_SQL} SELECT chunk_id, document_id, sha256(CASE WHEN document_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM chunks UNION ALL SELECT chunk_id || 'n', document_id, sha256('new') FROM chunks WHERE document_id % 10 = 0 AND page_number = 1""")
def _(spark, sf):
    """The same on a stored table in buckets of documents, with rows that come twice and rows that are new; the same write is done twice."""
    path, c = temporary_folder(spark), chunks(spark, sf).select("chunk_id", "document_id", "page_number", "text")
    bucketed.create(c, path, ["document_id", "chunk_id"], by=["document_id"], buckets=16)
    changed = c.where("document_id % 5 = 0")
    new = c.where("document_id % 10 = 0 AND page_number = 1").withColumn("chunk_id", F.concat("chunk_id", F.lit("n"))).withColumn("text", F.lit("new"))
    for _ in range(2):
        bucketed.upsert(path, changed.unionByName(changed.withColumn("text", F.concat("text", F.lit("!")))).unionByName(new), order=F.length("text"))
    return bucketed.read(spark, path).select("chunk_id", "document_id", F.sha2("text", 256).alias("h"))


@query("s14_stored_delete", f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id FROM chunks WHERE document_id % 9 <> 4")
def _(spark, sf):
    path = temporary_folder(spark)
    bucketed.create(chunks(spark, sf).select("chunk_id", "document_id"), path, ["document_id", "chunk_id"], by=["document_id"], buckets=16)
    bucketed.delete(path, table(spark, sf, "documents").where("doc_id % 9 = 4").select(F.col("doc_id").alias("document_id")))
    return bucketed.read(spark, path).select("chunk_id", "document_id")


@query("a5_write_statistics", f"WITH {CHUNKS_SQL}, c AS (SELECT * FROM chunks UNION ALL SELECT * FROM chunks WHERE document_id % 10 = 0) SELECT count(*) AS attempted, count(DISTINCT chunk_id) FILTER (length(trim(text)) >= 10) AS indexed, count(*) - count(DISTINCT chunk_id) FILTER (length(trim(text)) >= 10) AS failed, true AS timed FROM c")
def _(spark, sf):
    """Statistics that a write of the chunks (some of them twice) measures of itself; the time is only asked to be there."""
    c = chunks(spark, sf)
    reason = checks.first_index_error(F.col("chunk_id"), F.col("document_id").cast("string"), F.col("text"), F.col("document_name"), F.col("category"))
    told = ag.write_indexed(c.unionByName(c.where("document_id % 10 = 0")), reason, temporary_folder(spark))
    return told.select("attempted", "indexed", "failed", (F.col("seconds") > 0).alias("timed"))


@query("s15_incremental_skip", f"WITH {REGISTRY_SQL} SELECT document_id, file_name FROM registry WHERE document_id % 4 <> 1 AND status <> 'invalid' AND category = 'en' ORDER BY file_name LIMIT 50")
def _(spark, sf):
    from docmill.sources.tables import not_done

    r = registry(spark, sf)
    return not_done(r, r.where("document_id % 4 = 1").select("document_id"), category="en", skip_status="invalid", first=50).select("document_id", "file_name")


@query("s4_pages_from_documents", r"SELECT doc_id, page_number, trim(replace(p, chr(0), '')) AS text FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps)))::INT + 1 AS page_number FROM (SELECT doc_id, string_split(replace(text, '. ', '. ' || chr(12)), chr(12)) AS ps FROM documents))")
def _(spark, sf):
    from docmill.sources.tables import pages_from_documents

    d = table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(". \f")))
    return pages_from_documents(d, "doc_id").select("doc_id", "page_number", "text")


def _html_sql() -> str:
    from docmill.sources.tables import REFERENCES

    out = r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for name, sign in REFERENCES:
        out = f"""replace({out}, '{name}', '{sign.replace("'", "''")}')"""
    return f"SELECT page_id, trim(regexp_replace({out}, '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages"


@query("s4_text_of_html", _html_sql())
def _(spark, sf):
    from docmill.sources.tables import text_of_html

    return table(spark, sf, "pages").select("page_id", text_of_html(F.col("html")).alias("text"))

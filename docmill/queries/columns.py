"""Queries of the column functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.registry import query
from docmill.functions import patterns as pt
from docmill.functions import text as fx
from docmill.operators import checks
from docmill.plans.views import CHUNKS_SQL, PAGES_SQL, REGISTRY_SQL, chunks, pages, registry, table


@query("f1_chunk_id", f"WITH {CHUNKS_SQL} SELECT document_id, page_number, chunk_index, printf('%s_PAGE%03d_CHUNK%03d', left(uid, 8), page_number, chunk_index) AS cid FROM (SELECT *, sha256(document_id::VARCHAR) AS uid FROM chunks)")
def _(spark, sf):
    c = chunks(spark, sf)
    return c.select("document_id", "page_number", "chunk_index", fx.chunk_id(F.sha2(F.col("document_id").cast("string"), 256), F.col("page_number"), F.col("chunk_index")).alias("cid"))


@query("f2_token_estimate", "SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(1, CASE WHEN n % 4 = 2 THEN n // 4 + (n // 4) % 2 WHEN n % 4 = 3 THEN n // 4 + 1 ELSE n // 4 END) END::INT AS tokens FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.token_estimate(F.col("text")).alias("tokens"))


@query("f3_clean_chunk_text", rf"WITH {CHUNKS_SQL} SELECT chunk_id, document_id, regexp_replace(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{3,}}', ' ', 'g') AS cleaned FROM chunks")
def _(spark, sf):
    return chunks(spark, sf).select("chunk_id", "document_id", fx.clean_chunk_text(F.col("text")).alias("cleaned"))


@query("f4_clean_query", r"SELECT item_id, lower(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS q FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", fx.clean_query(F.col("text"), lowercase=True).alias("q"))


@query("f6_stable_ids", "SELECT doc_id, 'node_' || left(sha256('Doc_' || doc_id || '_vol' || (doc_id % 3) || '.pdf'), 12) AS node, left(sha256(lower(trim(text)) || '|' || lower(trim(source))), 12) AS record, 'okf_doc_' || left(sha256(source), 12) AS okf FROM documents")
def _(spark, sf):
    from docmill.plans.views import file_name

    d = table(spark, sf, "documents")
    return d.select("doc_id", fx.node_id(file_name(F.col("doc_id"))).alias("node"), fx.record_id(F.col("text"), F.col("source")).alias("record"), fx.knowledge_id("doc", F.col("source")).alias("okf"))


@query("f5_document_id")
def _(spark, sf):
    """Version 5 UUIDs; tests hold them against Python's uuid module, as DuckDB has no SHA-1 over bytes of a UUID."""
    r = registry(spark, sf)
    return r.select("document_id", fx.document_id(F.col("checksum_sha256"), F.col("relative_path")).alias("uuid"), fx.point_id(F.col("file_name")).alias("point"))


@query("f7_derive_title", f"WITH {REGISTRY_SQL} SELECT document_id, 'Doc ' || document_id || ' Vol' || (document_id % 3) AS title FROM registry")
def _(spark, sf):
    return registry(spark, sf).select("document_id", fx.derive_title(F.col("file_name")).alias("title"))


@query("f8_category_of_path", f"WITH {REGISTRY_SQL} SELECT document_id, category AS cat, category || '/' || file_name AS rel FROM registry")
def _(spark, sf):
    r = registry(spark, sf).withColumn("path", F.concat(F.lit("file:/mnt/dataset/"), "category", F.lit("/"), "file_name"))
    return r.select("document_id", fx.detect_category(F.col("path"), "dataset").alias("cat"), fx.relative_path(F.col("path"), "dataset").alias("rel"))


@query("f9_human_size", f"WITH {REGISTRY_SQL} SELECT document_id, CASE WHEN file_size_bytes < 1024 THEN printf('%.2f Bytes', file_size_bytes::DOUBLE) WHEN file_size_bytes < 1048576 THEN printf('%.2f KB', file_size_bytes / 1024.0) ELSE printf('%.2f MB', file_size_bytes / 1048576.0) END AS shown, round(file_size_bytes / 1048576.0::DOUBLE, 3) AS mb FROM registry")
def _(spark, sf):
    return registry(spark, sf).select("document_id", fx.human_size(F.col("file_size_bytes")).alias("shown"), fx.size_mb(F.col("file_size_bytes")).alias("mb"))


@query("f11_sanitize", "SELECT event_id, nullif(trim(event_type), '') AS kind, CASE WHEN trunc(value) > 0 THEN trunc(value)::INT END AS page FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", fx.sanitize_text(F.concat(F.lit(" "), "event_type")).alias("kind"), fx.sanitize_page(F.col("value").cast("string")).alias("page"))


@query("f13_summary_text", rf"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 250 THEN t WHEN regexp_extract(left(t, 250), '^(.+) ', 1) <> '' THEN regexp_extract(left(t, 250), '^(.+) ', 1) || '…' ELSE left(t, 250) || '…' END AS summary, CASE WHEN length(t) <= 300 THEN t ELSE left(t, 300) || '...' END AS shown FROM f")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.summary_text(F.col("text")).alias("summary"), fx.truncate(fx.whitespace_fold(F.col("text"))).alias("shown"))


@query("f14_normalize_doc_name", f"WITH {REGISTRY_SQL} SELECT document_id, 'doc_' || document_id AS name FROM registry")
def _(spark, sf):
    return registry(spark, sf).select("document_id", fx.normalize_doc_name(F.col("file_name")).alias("name"))


@query("f15_slice_and_normalize", "SELECT vec_id, list_transform(v[1:32], lambda x: round(CASE WHEN n > 0 THEN x / n ELSE x END, 6)) AS unit FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v[1:32], lambda y: y * y))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.transform(fx.slice_and_normalize(F.col("embedding"), 32), lambda x: fx.round_half_away(x, 6)).alias("unit"))


@query("f18_whitespace_fold", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.whitespace_fold(F.col("text")).alias("folded"))


@query("f19_page_number_resolve", "SELECT event_id, coalesce(nullif((event_id % 3)::INT, 0), nullif((event_id % 5)::INT, 0), nullif((user_id % 7)::INT, 0)) AS page FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", fx.page_number_resolve(F.col("event_id") % 3, F.col("event_id") % 5, F.col("user_id") % 7).alias("page"))


@query("p1_chunk_metadata", f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id, concat_ws('|', document_id::VARCHAR, document_name, category, page_number::VARCHAR, 'pdf') AS meta FROM chunks")
def _(spark, sf):
    meta = F.struct(F.col("document_id").cast("string").alias("document_id"), "document_name", "category", F.col("page_number").cast("string").alias("page_number"), F.lit("pdf").alias("source"))
    c = chunks(spark, sf).withColumn("metadata", meta)
    return c.select("chunk_id", "document_id", F.concat_ws("|", *[F.col("metadata")[k] for k in ("document_id", "document_name", "category", "page_number", "source")]).alias("meta"))


@query("p2_validate_pages", f"WITH {PAGES_SQL} SELECT document_id, page_number, CASE WHEN document_id % 7 = 0 THEN 'missing category' ELSE '' END || CASE WHEN page_number - 2 < 1 THEN CASE WHEN document_id % 7 = 0 THEN ';' ELSE '' END || 'page_number must be an integer >= 1' ELSE '' END AS errs FROM pages_v")
def _(spark, sf):
    p = pages(spark, sf)
    category = F.when(F.col("document_id") % 7 != 0, F.col("category"))
    found = checks.page_errors({"document_id": F.col("document_id").cast("string"), "document_name": F.col("document_name"), "category": category, "file_path": F.col("file_path")}, F.col("page_number") - 2)
    return p.select("document_id", "page_number", F.array_join(found, ";").alias("errs"))


@query("p3_validate_for_keyword_index", f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id, CASE WHEN trim(text) = '' THEN 'empty text' WHEN length(trim(text)) < 10 THEN 'text too short' WHEN trim(category) = '' THEN 'empty category' END AS reason FROM chunks")
def _(spark, sf):
    c = chunks(spark, sf)
    return c.select("chunk_id", "document_id", checks.first_index_error(F.col("chunk_id"), F.col("document_id").cast("string"), F.col("text"), F.col("document_name"), F.col("category")).alias("reason"))


@query("p4_validate_for_embedding", f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id, (CASE WHEN trim(text) = '' THEN 1 ELSE 0 END + CASE WHEN page_number > 3 THEN 1 ELSE 0 END)::INT AS n_errors FROM chunks")
def _(spark, sf):
    c = chunks(spark, sf)
    found = checks.page_errors({"chunk_id": F.col("chunk_id"), "text": F.col("text"), "document_id": F.col("document_id").cast("string")}, F.when(F.col("page_number") <= 3, F.col("page_number")))
    return c.select("chunk_id", "document_id", F.size(found).alias("n_errors"))


@query("p5_validate_dimension", "SELECT vec_id, len(embedding) = 64 AS ok FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", checks.has_width(F.col("embedding"), 64).alias("ok"))


@query("p6_filter_by_metadata", f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id FROM chunks WHERE category = 'en' AND page_number BETWEEN 2 AND 4")
def _(spark, sf):
    return checks.by_metadata(chunks(spark, sf), category="en", pages=(2, 4)).select("chunk_id", "document_id")


@query("p7_search_documents", f"WITH {REGISTRY_SQL} SELECT document_id, file_name FROM registry WHERE category = 'fr' AND status = 'valid' AND contains(lower(file_name), '_vol1')")
def _(spark, sf):
    return checks.search_documents(registry(spark, sf), "_VOL1", "F_R", "valid").select("document_id", "file_name")


@query("p8_list_documents", f"WITH {REGISTRY_SQL}, c AS (SELECT count(*) AS n FROM registry WHERE status = 'valid') SELECT document_id, file_name, ceil(n / 25.0)::INT AS total_pages FROM registry, c WHERE status = 'valid' ORDER BY document_id LIMIT 25 OFFSET 25")
def _(spark, sf):
    r = registry(spark, sf).where("status = 'valid'")
    total = r.agg(F.ceil(F.count("*") / 25).cast("int").alias("total_pages"))
    return checks.page_of(r, ["document_id"], 2, 25).crossJoin(F.broadcast(total)).select("document_id", "file_name", "total_pages")


@query("p9_file_status", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'empty' WHEN event_id % 5 = 1 THEN 'invalid' WHEN event_id % 5 = 2 THEN 'corrupted' WHEN event_id % 10 = 3 THEN 'invalid' WHEN event_id % 10 = 8 THEN 'valid' ELSE 'valid' END AS status FROM events")
def _(spark, sf):
    e = F.col("event_id")
    error = F.when(e % 5 == 0, "PDF has zero pages").when(e % 5 == 1, "File is empty").when(e % 5 == 2, "Cannot open")
    return table(spark, sf, "events").select("event_id", checks.file_status(F.when(e % 10 == 3, 0).otherwise(4), error).alias("status"))


@query("p10_drop_short_chunks", f"WITH {CHUNKS_SQL} SELECT chunk_id, document_id FROM chunks WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 20")
def _(spark, sf):
    return chunks(spark, sf).where(checks.long_enough(F.col("text"))).select("chunk_id", "document_id")


@query("p11_validate_query", "SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(trim(text)) < 3 THEN 'too short' WHEN length(trim(text)) > 2000 THEN 'too long' END AS reason FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", checks.query_error(F.col("text")).alias("reason"))


@query("p12_flag_prompt_injection", "SELECT conv_id, turn, regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in pt.INJECTIONS) + "') AS flagged FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", checks.injection(F.col("text")).alias("flagged"))


@query("p13_boilerplate_pages", f"WITH {PAGES_SQL} SELECT document_id, page_number, regexp_matches(upper(text), 'AND|TABLE I|DER') AND (len(regexp_extract_all(text, '\\.\\.\\.\\.')) > 5 OR len(regexp_extract_all(text, '----')) > 5 OR length(text) < 1200) AS boiler FROM pages_v")
def _(spark, sf):
    return pages(spark, sf).select("document_id", "page_number", checks.boilerplate(F.col("text"), ("AND", "TABLE I", "DER")).alias("boiler"))


@query("p16_lookup_by_id", f"WITH {CHUNKS_SQL} SELECT chunk_id, page_number, chunk_index, text FROM chunks WHERE document_id = 42")
def _(spark, sf):
    return chunks(spark, sf).where("document_id = 42").select("chunk_id", "page_number", "chunk_index", "text")


@query("x2_detect_headings", r"SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls)))::INT AS line_no FROM (SELECT doc_id, string_split(replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '.', ''), chr(10)) AS ls FROM documents)) WHERE regexp_matches(line, '^(PART\s+[0-9A-Z\-\. ]+|SUBCHAPTER\s+[A-Z\-\. ]+|§\s*[0-9]+[a-zA-Z0-9\-\.\:]*|Sec(tion)?\s*\.?\s*[0-9]+[a-zA-Z0-9\-\.\:]*|[A-Z0-9 ,\-\:\(\)]{8,80})$')")
def _(spark, sf):
    """Headings, defined per line; a-z are upper-cased first, as the texts' own lines hold none."""
    upper = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.replace(upper, F.lit("."), F.lit("")), "\n")).alias("line_no", "line"))
    return d.where(F.col("line").rlike(pt.HEADING))

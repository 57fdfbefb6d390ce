"""Queries of question sets, evaluation and answers. Golden questions are the passages of ``benchmark``, all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.registry import query
from docmill.operators import aggregate as ag
from docmill.operators import answers as an
from docmill.operators import evaluate as ev
from docmill.operators import golden as go
from docmill.operators import stored_index as si
from docmill.operators.joins import passages_in
from docmill.plans.indexes import chunk_rows, with_chunks
from docmill.plans.views import PAGE, file_name, table
from docmill.sources.stored import stored
from docmill.queries.search import _STOP, INDEX_SQL, POSTINGS_SQL, SCORE_SQL, questions

RAW_SQL = """raw AS (SELECT (event_id + 2)::INT AS row_number, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type || (user_id % 40) || '?' END AS query, CASE WHEN event_id % 7 = 0 OR event_id % 77 = 0 THEN NULL ELSE 'answer ' || event_id END AS expected_answer, CASE WHEN event_id % 77 = 0 THEN '' ELSE 'f' || user_id || '.pdf' END AS source_document, CASE WHEN event_id % 77 = 0 THEN NULL ELSE (event_id % 5)::VARCHAR || '.0' END AS page_number, CASE WHEN event_id % 77 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'Other' ELSE 'Tax' END AS category FROM events)"""
GOLDEN_SQL = RAW_SQL + """, cl AS (SELECT row_number, nullif(trim(query), '') AS query, nullif(trim(expected_answer), '') AS expected_answer, nullif(trim(source_document), '') AS source_document, CASE WHEN try_cast(page_number AS DOUBLE)::INT > 0 THEN try_cast(page_number AS DOUBLE)::INT END AS page, category, page_number IS NULL AND nullif(trim(query), '') IS NULL AND nullif(trim(expected_answer), '') IS NULL AND nullif(trim(source_document), '') IS NULL AND category IS NULL AS empty FROM raw),
nn AS (SELECT *, row_number() OVER (PARTITION BY lower(query) ORDER BY row_number) AS nth FROM cl),
er AS (SELECT *, CASE WHEN empty THEN '' ELSE concat_ws(',', CASE WHEN query IS NULL THEN 'MISSING_QUERY' END, CASE WHEN expected_answer IS NULL THEN 'MISSING_ANSWER' END, CASE WHEN source_document IS NULL THEN 'MISSING_SOURCE' END, CASE WHEN page IS NULL THEN 'INVALID_PAGE' END, CASE WHEN category = 'Other' THEN 'UNKNOWN_CATEGORY' END, CASE WHEN category IS NULL THEN 'MISSING_CATEGORY' END, CASE WHEN query IS NOT NULL AND nth > 1 THEN 'DUPLICATE_QUERY' END) END AS codes FROM nn),
golden AS (SELECT *, CASE WHEN empty THEN 'rejected' WHEN codes = '' THEN 'valid' WHEN codes = 'DUPLICATE_QUERY' THEN 'duplicate' ELSE 'invalid' END AS status FROM er)"""


def raw_rows(spark, sf):
    e, i, u = table(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    blank = i % 77 == 0
    return e.select(
        (i + 2).cast("int").alias("row_number"), F.when(i % 11 == 0, " ").otherwise(F.concat("event_type", (u % 40).cast("string"), F.lit("?"))).alias("Question"), F.when(~((i % 7 == 0) | blank), F.concat(F.lit("answer "), i.cast("string"))).alias(" Ground_Truth "),
        F.when(blank, "").otherwise(F.concat(F.lit("f"), u.cast("string"), F.lit(".pdf"))).alias("SOURCE"), F.when(~blank, F.concat((i % 5).cast("string"), F.lit(".0"))).alias("Page"), F.when(~blank, F.when(i % 13 == 0, "Other").otherwise("Tax")).alias("Type"),
    )


def validated(spark, sf):
    return go.validate_rows(go.canonical_columns(raw_rows(spark, sf)), ["Tax", "Acts"])


@query("f10_canonical_columns", f"WITH {RAW_SQL} SELECT * FROM raw")
def _(spark, sf):
    return go.canonical_columns(raw_rows(spark, sf))


@query("f12_validate_golden_rows", f"WITH {GOLDEN_SQL} SELECT row_number, status, codes, coalesce(page, 0) AS page_number FROM golden")
def _(spark, sf):
    return validated(spark, sf).select("row_number", "status", F.array_join("errors.error_code", ",").alias("codes"), "page_number")


@query("p17_complete_question_rows", f"WITH {GOLDEN_SQL} SELECT row_number, query, page AS page_number FROM golden WHERE query IS NOT NULL AND expected_answer IS NOT NULL AND source_document IS NOT NULL AND page IS NOT NULL AND category IS NOT NULL")
def _(spark, sf):
    return go.complete_rows(go.canonical_columns(raw_rows(spark, sf))).select("row_number", "query", "page_number")


@query("a6_golden_statistics", f"WITH {GOLDEN_SQL} SELECT coalesce(category, 'Unknown') AS category, count(*) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'duplicate') AS duplicate, round(avg(length(query)) FILTER (status = 'valid'), 2) AS mean_query, round(avg(length(expected_answer)) FILTER (status = 'valid'), 2) AS mean_answer, count(DISTINCT source_document) FILTER (status = 'valid') AS sources FROM golden WHERE status <> 'rejected' GROUP BY 1")
def _(spark, sf):
    return ag.golden_statistics(validated(spark, sf))


@query("a7_validation_report", f"WITH {GOLDEN_SQL} SELECT error_code, count(*) AS errors, count(DISTINCT row_number) AS rows FROM (SELECT row_number, unnest(string_split(codes, ',')) AS error_code FROM golden WHERE codes <> '') GROUP BY 1")
def _(spark, sf):
    return ag.validation_report(validated(spark, sf)).drop("field_name")


@query("d1_export_for_use_case", "SELECT doc_id AS id, text AS prompt, lang AS language FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0")
def _(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return go.export_rows(rows, {"doc_id": "id", "text": "prompt", "lang": "language"}, "quality = 1 AND toxic = 0")


EVAL_SQL = POSTINGS_SQL + rf""", tr AS (SELECT item_id AS qid, doc_id, instr(d.text, b.text) AS pos FROM benchmark b JOIN documents d ON contains(d.text, b.text)), tf1 AS (SELECT qid, min(doc_id) AS doc_id FROM tr GROUP BY qid),
g AS (SELECT item_id AS qid, CASE WHEN t.doc_id IS NULL THEN 'none.pdf' ELSE 'Doc_' || t.doc_id || '_vol' || (t.doc_id % 3) || '.pdf' END AS expected_document, coalesce((pos - 1) // 1500 + 1, 1)::INT AS expected_page, text AS qtext FROM benchmark LEFT JOIN tf1 f ON f.qid = item_id LEFT JOIN tr t ON t.qid = f.qid AND t.doc_id = f.doc_id),
qt AS (SELECT * FROM (SELECT qid, unnest(regexp_extract_all(lower(qtext), '[\p{{L}}\p{{N}}]+')) AS term FROM g) WHERE term NOT IN ({_STOP})), """ + SCORE_SQL + r""",
h AS (SELECT kw.*, c.document_name, c.page_number FROM kw JOIN (SELECT chunk_id || '#' || document_id AS ck, document_name, page_number FROM chunks) c USING (ck)),
n AS (SELECT g.*, h.rank, h.document_name, h.page_number, regexp_replace(replace(lower(h.document_name), '.pdf', ''), '(_|-)?vol(ume)?_?\d+', '') = regexp_replace(replace(lower(expected_document), '.pdf', ''), '(_|-)?vol(ume)?_?\d+', '') AS loose, lower(h.document_name) = lower(expected_document) AS same FROM g LEFT JOIN h ON h.qid = g.qid AND rank <= 5),
m AS (SELECT qid, max(CASE WHEN loose THEN CASE abs(page_number - expected_page) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END ELSE 0 END) AS retrieval_accuracy, count(*) FILTER (same) AS k, min(rank) FILTER (same) AS f FROM n GROUP BY qid),
ap AS (SELECT qid, avg(i::DOUBLE / rank) AS context_precision FROM (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM n WHERE same) GROUP BY qid),
ev AS (SELECT qid, retrieval_accuracy, k / 5.0::DOUBLE AS precision_at_5, CASE WHEN k > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS recall_at_5, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, round(coalesce(1.0::DOUBLE / log2(f + 1), 0), 6) AS ndcg, round(coalesce(context_precision, 0), 6) AS context_precision FROM m LEFT JOIN ap USING (qid))"""


def truth(spark, sf):
    """qid, document_id, at: the documents that hold a passage, and where."""
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("pid"), "text")
    return passages_in(passages, table(spark, sf, "documents").select(F.col("doc_id").alias("tid"), "text")).select(F.col("pid").alias("qid"), F.col("tid").alias("document_id"), "at")


def golden_questions(spark, sf):
    """Stored, as metrics read it more than once: every passage as a question; expected is the first document that holds it, and the page where it starts ('none.pdf' if none)."""
    first = truth(spark, sf).groupBy("qid").agg(F.min(F.struct("document_id", "at")).alias("f"))
    j = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text").join(first, "qid", "left")
    page = F.coalesce((F.floor((F.col("f.at") - 1) / PAGE) + 1).cast("int"), F.lit(1))
    return stored(j.select("qid", F.coalesce(file_name(F.col("f.document_id")), F.lit("none.pdf")).alias("expected_document"), page.alias("expected_page"), "text"))


def golden_hits(spark, sf):
    return with_chunks(spark, sf, si.search(chunk_rows(spark, sf), questions(spark, sf)), "document_name", "page_number", "text")


@query("e1_retrieval_accuracy", f"WITH {EVAL_SQL} SELECT qid, retrieval_accuracy FROM ev")
def _(spark, sf):
    return ev.retrieval_accuracy(golden_questions(spark, sf), golden_hits(spark, sf))


@query("e2_e3_e4_rank_metrics", f"WITH {EVAL_SQL} SELECT qid, precision_at_5, recall_at_5, mrr, ndcg, context_precision FROM ev")
def _(spark, sf):
    return ev.rank_metrics(golden_questions(spark, sf), golden_hits(spark, sf))


CITED_SQL = "cited AS (SELECT qid, expected_document AS document, expected_page + qid % 4 AS page FROM g WHERE qid % 3 <> 0 UNION ALL SELECT qid, replace(expected_document, 'vol', 'vol9'), expected_page FROM g)"


def cited(g):
    first = g.where("qid % 3 <> 0").select("qid", F.col("expected_document").alias("document"), (F.col("expected_page") + F.col("qid") % 4).cast("int").alias("page"))
    return first.unionByName(g.select("qid", F.replace("expected_document", F.lit("vol"), F.lit("vol9")).alias("document"), F.col("expected_page").alias("page")))


@query("e5_citation_accuracy", f"WITH {EVAL_SQL}, {CITED_SQL} SELECT g.qid, max(CASE WHEN lower(document) = lower(expected_document) THEN CASE page - expected_page WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.0 END) AS citation_accuracy, 1.0::DOUBLE AS citation_score FROM g JOIN cited USING (qid) GROUP BY g.qid")
def _(spark, sf):
    g = golden_questions(spark, sf)
    return ev.citation_scores(g, cited(g))


def evaluated(spark, sf):
    g = golden_questions(spark, sf)
    told = g.select("qid", F.when(F.col("qid") % 4 == 0, "Information not found in the provided legal documents.").otherwise(F.col("text")).alias("answer"), F.length("text").alias("latency_ms"))
    return ev.evaluate(g, golden_hits(spark, sf), cited(g), told)


@query("e6_e7_e8_evaluate_golden_set", f"WITH {EVAL_SQL} SELECT qid, retrieval_accuracy, CASE WHEN qid % 4 = 0 THEN 0.15::DOUBLE WHEN recall_at_5 > 0 THEN 0.94::DOUBLE ELSE 0.40::DOUBLE END AS answer_relevancy, CASE WHEN retrieval_accuracy > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS faithfulness, CASE WHEN retrieval_accuracy >= 0.9 THEN 'Pass' WHEN retrieval_accuracy > 0 THEN 'Partial' ELSE 'Failed' END AS status FROM ev")
def _(spark, sf):
    return evaluated(spark, sf).select("qid", "retrieval_accuracy", "answer_relevancy", "faithfulness", "status")


@query("a15_evaluation_summary", f"WITH {EVAL_SQL} SELECT count(*) AS questions, round(avg(retrieval_accuracy), 6) AS retrieval_accuracy, round(avg(mrr), 6) AS mrr, (SELECT round(avg(length(qtext)), 2) FROM g) AS mean_latency_ms, count(*) FILTER (retrieval_accuracy >= 0.9) AS pass, count(*) FILTER (retrieval_accuracy > 0 AND retrieval_accuracy < 0.9) AS partial, count(*) FILTER (retrieval_accuracy = 0) AS failed FROM ev")
def _(spark, sf):
    return ag.evaluation_summary(evaluated(spark, sf), ["retrieval_accuracy", "mrr"])


@query("a16_answer_confidence", f"WITH {EVAL_SQL}, {CITED_SQL}, s AS (SELECT qid, avg(score / 100.0::DOUBLE) AS mean, list(DISTINCT lower(document_name)) AS got FROM h GROUP BY qid), c AS (SELECT qid, list(DISTINCT lower(document)) AS cd, count(*) AS n FROM cited GROUP BY qid) SELECT qid, round(least(greatest(0.5::DOUBLE * mean + 0.3::DOUBLE * len(list_intersect(got, cd)) / len(got) + 0.2::DOUBLE * least(n / 3.0::DOUBLE, 1.0), 0.0), 1.0), 2) AS confidence FROM s JOIN c USING (qid)")
def _(spark, sf):
    hits = golden_hits(spark, sf).withColumn("score", F.col("score") / 100)
    return ag.answer_confidence(hits, cited(golden_questions(spark, sf)).withColumnRenamed("document", "document_name"))


@query("f16_build_context", f"WITH {EVAL_SQL} SELECT qid, 'Q: ' || qtext || chr(10) || string_agg('[' || rank || '] ' || h.document_name || ' (page ' || h.page_number || ')' || chr(10) || r.text, chr(10) || chr(10) ORDER BY rank) AS prompt FROM h JOIN rows_ r USING (ck) JOIN g USING (qid) WHERE rank <= 3 GROUP BY qid, qtext")
def _(spark, sf):
    context = an.build_context(golden_hits(spark, sf).where("rank <= 3"))
    return an.prompts(golden_questions(spark, sf), context, "Q: {question}\n{context}")


@query("f17_parse_model_json", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'Information not found in the provided legal documents.' ELSE trim(coalesce(text, '')) END AS answer, CASE WHEN turn % 3 = 2 THEN 0 ELSE 1 END AS n, turn % 3 <> 2 AS parsed FROM conversations")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    cited = F.from_json(F.lit('[{"document": "A.pdf", "page": 2, "category": "Tax"}, {"page": 3}]'), "array<struct<document:string,page:int,category:string>>")
    body = F.to_json(F.struct(F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("answer"), F.lit("s").alias("summary"), cited.alias("citations")))
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 3 == 1, body).otherwise("I cannot say.")
    got = an.parse_model_json(c.select(F.struct("conv_id", "turn").alias("qid"), raw.alias("raw_response")))
    return got.select("qid.*", "answer", F.size("citations").alias("n"), "parsed")


@query("entry_keyword_quality", rf"""WITH {INDEX_SQL}, h AS (SELECT qid, document_id, page_number, rank FROM kw JOIN (SELECT chunk_id || '#' || document_id AS ck, document_id, page_number FROM chunks) USING (ck) WHERE rank <= 5),
t AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT qid, count(DISTINCT doc_id) AS relevant, (SELECT count(DISTINCT document_id) FROM h WHERE h.qid = t.qid AND EXISTS (SELECT 1 FROM t x WHERE x.qid = t.qid AND x.doc_id = h.document_id)) AS found, coalesce(round(1.0::DOUBLE / (SELECT min(rank) FROM h WHERE h.qid = t.qid AND EXISTS (SELECT 1 FROM t x WHERE x.qid = t.qid AND x.doc_id = h.document_id)), 6), 0) AS mrr FROM t GROUP BY qid""")
def _(spark, sf):
    """Per passage that some document holds: documents that hold it, how many of them the first five hits name, MRR."""
    hits = with_chunks(spark, sf, si.search(chunk_rows(spark, sf), questions(spark, sf)).where("rank <= 5"), "document_id").select("qid", "document_id", "rank")
    first = hits.groupBy("qid", "document_id").agg(F.min("rank").alias("rank"))
    j = truth(spark, sf).join(first, ["qid", "document_id"], "left")
    return j.groupBy("qid").agg(F.countDistinct("document_id").alias("relevant"), F.countDistinct(F.when(F.col("rank").isNotNull(), F.col("document_id"))).alias("found"), F.coalesce(F.round(1.0 / F.min("rank"), 6), F.lit(0.0)).alias("mrr"))

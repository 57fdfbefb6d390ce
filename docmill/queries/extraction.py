"""Queries of the extraction jobs, over all chunks, with the legal patterns and with generic ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.registry import query
from docmill.functions import patterns as pt
from docmill.operators import aggregate as ag
from docmill.operators import extract as ex
from docmill.plans.views import CHUNKS_SQL, PAGES_SQL, chunks, pages, table

#: A legal sentence, added to every second text (by id), as none of the texts has one; (Spark and SQL add the same).
LEGAL = " Section 12 of the Employee Retirement Income Security Act amends Pub. 550; see IRC §401(k), 26 C.F.R. § 1.61, Treas. Reg. § 1.162 and Rev. Rul. 99-7. Smith v. Jones overruled it, says the IRS; Judge Brown paid $5,000 on March 3, 2020."
#: Letters and digits beyond ASCII as an underscore: so RE2's word boundaries fall where Java's do.
_BOUND = r"regexp_replace(text, '[^\x00-\x7F\pP\pS\pZ\pC\pM]', '_', 'g')"
LEGAL_SQL = f"legal AS (SELECT chunk_id, document_id, category, CASE WHEN document_id % 2 = 0 THEN text || '{LEGAL}' ELSE text END AS text FROM chunks)"


def _matches_sql(patterns, source="chunks", key="chunk_id", rest=", document_id, category") -> str:
    text = lambda x: _BOUND if r"\b" in x else "text"
    parts = [f"SELECT {key}{rest}, unnest(ms) AS m, unnest(range(len(ms)))::INT AS i, '{k}' AS kind, {c}::DOUBLE AS confidence, {n} AS p FROM (SELECT {key}{rest}, regexp_extract_all({text(x)}, '{x}', 0) AS ms FROM {source})" for n, (x, k, c) in enumerate(patterns)]
    return "m AS (" + " UNION ALL ".join(parts) + ")"


_FOLD = r"lower(trim(regexp_replace(trim(m), '[\t\n\f\r\x0b ]+', ' ', 'g')))"
_FIRST = f"f AS (SELECT {{key}}, kind, {_FOLD} AS folded, first(trim(m) ORDER BY p, i) AS matched, first(confidence ORDER BY p, i) AS confidence, min(p * 100000 + i) AS o FROM m GROUP BY ALL)"


def legal_chunks(spark, sf):
    c = chunks(spark, sf).withColumn("chunk_key", F.col("chunk_id"))
    return c.withColumn("text", F.when(F.col("document_id") % 2 == 0, F.concat("text", F.lit(LEGAL))).otherwise(F.col("text")))


def plain_chunks(spark, sf):
    return chunks(spark, sf).withColumn("chunk_key", F.col("chunk_id"))


@query("x3_extract_entities", f"WITH {CHUNKS_SQL}, {LEGAL_SQL}, {_matches_sql(pt.ENTITIES, 'legal')}, {_FIRST.format(key='chunk_id')} SELECT chunk_id, matched, kind, confidence, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY confidence DESC, o) AS rank FROM f) WHERE rank <= 30")
def _(spark, sf):
    return ex.entities(legal_chunks(spark, sf), "chunk_id", pt.ENTITIES).select("chunk_id", "matched", "kind", "confidence", "rank")


@query("x3_generic_entities", f"WITH {CHUNKS_SQL}, {_matches_sql(pt.GENERIC)}, {_FIRST.format(key='chunk_id')} SELECT chunk_id, matched, kind, confidence, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY confidence DESC, o) AS rank FROM f) WHERE rank <= 30")
def _(spark, sf):
    return ex.entities(plain_chunks(spark, sf), "chunk_id", pt.GENERIC).select("chunk_id", "matched", "kind", "confidence", "rank")


@query("x4_extract_sections", f"WITH {CHUNKS_SQL}, {LEGAL_SQL}, {_matches_sql(pt.SECTIONS, 'legal')}, f AS (SELECT chunk_id, {_FOLD} AS folded, min(p * 100000 + i) AS o FROM m GROUP BY ALL) SELECT chunk_id, folded, (row_number() OVER (PARTITION BY chunk_id ORDER BY o))::INT AS rank FROM f WHERE length(folded) >= 3")
def _(spark, sf):
    return ex.sections(legal_chunks(spark, sf), "chunk_id", pt.SECTIONS).select("chunk_id", "folded", "rank")


@query("x5_extract_references", f"WITH {CHUNKS_SQL}, {LEGAL_SQL}, {_matches_sql(pt.REFERENCES, 'legal')} SELECT DISTINCT chunk_id, {_FOLD} AS folded FROM m")
def _(spark, sf):
    return ex.distinct_matches(ex.matches(legal_chunks(spark, sf), "chunk_id", pt.REFERENCES), "chunk_id", by_kind=False).select("chunk_id", "folded")


@query("x6_extract_relations", f"WITH {CHUNKS_SQL}, {LEGAL_SQL}, {_matches_sql(pt.REFERENCES, 'legal')}, {_FIRST.format(key='chunk_id')} SELECT chunk_id, kind, folded, confidence FROM f WHERE confidence >= 0.4")
def _(spark, sf):
    return ex.relations(legal_chunks(spark, sf), "chunk_id", pt.REFERENCES).select("chunk_id", "kind", "folded", "confidence")


@query("x7_detect_edge_patterns", f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || '{LEGAL}' ELSE text END AS text FROM documents), {_matches_sql(pt.EDGES, 'd', 'doc_id', '')} SELECT DISTINCT doc_id, kind, {_FOLD} AS folded FROM m")
def _(spark, sf):
    """The legal edge patterns over every text."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(LEGAL))).otherwise(F.col("text")).alias("text"))
    return ex.distinct_matches(ex.matches(d, "doc_id", pt.EDGES), "doc_id").select("doc_id", "kind", "folded")


@query("x8_knowledge_chunks", f"""WITH {CHUNKS_SQL}, {LEGAL_SQL}, {_matches_sql(pt.ENTITIES, 'legal')}, e AS (SELECT chunk_id, count(*) AS n FROM (SELECT DISTINCT chunk_id, kind, {_FOLD} FROM m) GROUP BY 1),
s AS (SELECT chunk_id, count(*) AS n FROM (WITH {_matches_sql(pt.SECTIONS, 'legal')} SELECT DISTINCT chunk_id, {_FOLD} AS f FROM m) WHERE length(f) >= 3 GROUP BY 1), r AS (SELECT chunk_id, count(*) AS n FROM (WITH {_matches_sql(pt.REFERENCES, 'legal')} SELECT DISTINCT chunk_id, kind, {_FOLD} FROM m) GROUP BY 1)
SELECT chunk_id, document_id, least(coalesce(e.n, 0), 30)::INT AS entities, coalesce(s.n, 0)::INT AS sections, coalesce(r.n, 0)::INT AS relations FROM legal c LEFT JOIN e USING (chunk_id) LEFT JOIN s USING (chunk_id) LEFT JOIN r USING (chunk_id) WHERE length(trim(text)) >= 5""")
def _(spark, sf):
    c = legal_chunks(spark, sf)
    k = ag.keyword_top_n(c, pt.KEYWORD, pt.STOPWORDS).withColumnRenamed("chunk_key", "chunk_id")
    out = ex.knowledge_chunks(c.drop("chunk_key"), "chunk_id", pt.ENTITIES, pt.SECTIONS, pt.REFERENCES, k)
    return out.select("chunk_id", "document_id", F.size("entities").alias("entities"), F.size("sections").alias("sections"), F.size("relations").alias("relations"))


@query("a10_knowledge_rollup", f"""WITH {CHUNKS_SQL}, {LEGAL_SQL}, {_matches_sql(pt.ENTITIES, 'legal')}, b AS (SELECT document_id, kind, lower(trim(m)) AS folded, max(confidence) AS c, count(DISTINCT chunk_id) AS n FROM m GROUP BY ALL)
SELECT document_id, count(*) AS entities, sum(n)::BIGINT AS mentions, round(max(c), 2) AS best, string_agg(kind || ':' || folded, ',' ORDER BY kind || ':' || folded) AS entity_list FROM b GROUP BY document_id""")
def _(spark, sf):
    found = ex.matches(legal_chunks(spark, sf).withColumn("k", F.struct("document_id", "chunk_key")), "k", pt.ENTITIES).select("k.*", "matched", "kind", "confidence")
    return ag.knowledge_rollup(found)


@query("a11_knowledge_totals", f"""WITH {CHUNKS_SQL}, {LEGAL_SQL}, {_matches_sql(pt.ENTITIES, 'legal')}, b AS (SELECT document_id, category, kind, lower(trim(m)) AS folded, count(DISTINCT chunk_id) AS n FROM m GROUP BY ALL)
SELECT category, count(DISTINCT document_id) AS documents, count(*) AS entities, sum(n)::BIGINT AS mentions FROM b GROUP BY category""")
def _(spark, sf):
    found = ex.matches(legal_chunks(spark, sf).withColumn("k", F.struct("document_id", "chunk_key")), "k", pt.ENTITIES).select("k.*", "matched", "kind", "confidence")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("category"))
    return ag.knowledge_totals(ag.knowledge_rollup(found).join(docs, "document_id"))


@query("x9_sentence_candidates", rf"""WITH {PAGES_SQL}, s AS (SELECT document_id, page_number, unnest(ss) AS sentence, unnest(range(len(ss)))::INT AS pos FROM (SELECT *, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS ss FROM pages_v)),
k AS (SELECT *, len(regexp_extract_all(lower(sentence), 'tion|ing'))::INT AS hits FROM (SELECT document_id, page_number, pos, trim(sentence) AS sentence FROM s) WHERE length(sentence) BETWEEN 100 AND 280 AND regexp_matches(sentence, '^\p{{Lu}}'))
SELECT document_id, page_number, pos, sentence, hits, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY hits DESC, pos))::INT AS rank FROM k""")
def _(spark, sf):
    return ex.sentence_candidates(pages(spark, sf), ["document_id", "page_number"], ("tion", "ing")).select("document_id", "page_number", "pos", "sentence", "hits", "rank")


@query("x10_make_question_rows", rf"""WITH {PAGES_SQL}, s AS (SELECT document_id, document_name, category, page_number, unnest(ss) AS sentence, unnest(range(len(ss)))::INT AS pos FROM (SELECT *, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS ss FROM pages_v)),
k AS (SELECT *, len(regexp_extract_all(lower(sentence), 'tion|ing'))::INT AS hits FROM (SELECT * REPLACE (trim(sentence) AS sentence) FROM s) WHERE length(sentence) BETWEEN 100 AND 280 AND regexp_matches(sentence, '^\p{{Lu}}')),
b AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY hits DESC, pos) AS n FROM k)
SELECT document_id, document_name, category, page_number, replace(CASE category WHEN 'en' THEN 'What is said about {{topic}}?' WHEN 'de' THEN 'Was steht zu {{topic}}?' ELSE '{{topic}}: what follows?' END, '{{topic}}', array_to_string(string_split(sentence, ' ')[1:6], ' ')) AS query, sentence AS expected_answer, printf('%s, page %d', document_name, page_number) AS citation FROM b WHERE n = 1""")
def _(spark, sf):
    key = ["document_id", "document_name", "category", "page_number"]
    s = ex.sentence_candidates(pages(spark, sf), key, ("tion", "ing"))
    return ex.question_rows(s, key, {"en": "What is said about {topic}?", "de": "Was steht zu {topic}?"}, "{topic}: what follows?")


@query("x1_recursive_split")
def _(spark, sf):
    """Chunks of every page; properties are tested: length, containment, coverage."""
    return ex.recursive_split(pages(spark, sf), ["document_id", "page_number"], 500, 100)


@query("w11_active_heading", rf"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls)))::INT AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
o AS (SELECT doc_id, n, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) - length(line) - 1)::BIGINT AS "offset" FROM l),
h AS (SELECT doc_id, "offset" AS ho, line FROM o WHERE length(line) < 60),
c AS (SELECT doc_id, unnest(range((length(text) + 499) // 500)) * 500 AS "offset" FROM documents WHERE length(text) > 0)
SELECT c.doc_id, c."offset", first(h.line ORDER BY ho DESC) AS heading FROM c LEFT JOIN h ON h.doc_id = c.doc_id AND ho <= c."offset" GROUP BY ALL""")
def _(spark, sf):
    """Short lines as headings: the last one at or before each slice of 500 characters."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "heading"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("offset", F.sum(F.length("heading") + 1).over(w) - F.length("heading") - 1).where(F.length("heading") < 60)
    c = chunks(spark, sf).select(F.col("document_id").alias("doc_id"), (((F.col("page_number") - 1) * 3 + F.col("chunk_index")) * 500).cast("long").alias("offset"), "text")
    return ex.active_heading(c, lines, ["doc_id"]).select("doc_id", "offset", "heading")

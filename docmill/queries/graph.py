"""Queries of joins and of the document graph. Edges link a document to the first one that holds the same line."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.registry import query
from docmill.functions import text as fx
from docmill.operators import graph as gr
from docmill.operators import joins as jn
from docmill.plans.views import CHUNKS_SQL, PAGES_SQL, REGISTRY_SQL, chunks, file_name, pages, registry, table

TYPES = {"en": "ACT", "de": "JUDGMENT", "fr": "PUBLICATION"}
NODES_SQL = f"{CHUNKS_SQL}, nodes AS (SELECT document_id AS node_id, CASE category WHEN 'en' THEN 'ACT' WHEN 'de' THEN 'JUDGMENT' WHEN 'fr' THEN 'PUBLICATION' ELSE 'UNKNOWN' END AS node_type, document_name, max(page_number) AS page_count FROM chunks GROUP BY ALL)"
EDGES_SQL = """lines AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 30),
firsts AS (SELECT line, min(doc_id) AS f FROM lines GROUP BY line HAVING count(*) > 1),
raw AS (SELECT doc_id AS source_id, f AS target_id, CASE WHEN length(line) >= 60 THEN 'CITES' ELSE 'REFERS_TO' END AS edge_type, least(0.5::DOUBLE + (length(line) // 8) * 0.02::DOUBLE, 0.95::DOUBLE) AS confidence, line AS pattern FROM lines JOIN firsts USING (line) WHERE doc_id <> f),
edges AS (SELECT source_id, target_id, edge_type, max(confidence) AS confidence, count(*) AS occurrences, round(least(max(confidence) + least(0.1::DOUBLE * (count(*) - 1), 0.2::DOUBLE), 1.0::DOUBLE), 4) AS weight FROM raw GROUP BY ALL)"""
WALK_SQL = EDGES_SQL + """, both_ AS (SELECT source_id AS u, target_id AS v, edge_type, source_id || '→' || target_id || '→' || edge_type AS via FROM edges UNION ALL SELECT target_id, source_id, edge_type, source_id || '→' || target_id || '→' || edge_type FROM edges),
l0 AS (SELECT doc_id AS seed, doc_id AS node FROM documents WHERE doc_id % 50 = 0),
l1 AS (SELECT seed, v AS node, min(via) AS via FROM l0 JOIN both_ ON u = node WHERE v <> seed GROUP BY ALL),
l2 AS (SELECT l1.seed, v AS node, min(both_.via) AS via FROM l1 JOIN both_ ON u = l1.node WHERE v <> l1.seed AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.seed = l1.seed AND x.node = v) GROUP BY ALL)"""


def raw_edges(spark, sf):
    """Lines meet by their SHA-256: text moves only for a caller that reads ``pattern``."""
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length("line") >= 30)
    lines = lines.select("doc_id", F.unhex(F.sha2("line", 256)).alias("digest"), F.length("line").alias("size"), "line")
    firsts = lines.groupBy("digest").agg(F.min("doc_id").alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    j = lines.join(firsts, "digest").where("doc_id <> f")
    return j.select(F.col("doc_id").alias("source_id"), F.col("f").alias("target_id"), F.when(F.col("size") >= 60, "CITES").otherwise("REFERS_TO").alias("edge_type"), F.least(F.lit(0.5) + F.floor(F.col("size") / 8) * F.lit(0.02), F.lit(0.95)).alias("confidence"), F.col("line").alias("pattern"))


def edges(spark, sf):
    return gr.build_edges(raw_edges(spark, sf))


def nodes(spark, sf):
    return gr.build_nodes(chunks(spark, sf), TYPES).drop("node_id").withColumnRenamed("document_id", "node_id")


def seeds(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("node_id"))


@query("a12_build_nodes", rf"WITH {CHUNKS_SQL}, f AS (SELECT document_id, document_name, category, max(page_number) AS page_count, trim(regexp_replace(first(text ORDER BY page_number, chunk_index), '\s+', ' ', 'g')) AS t, count(*) AS n FROM chunks GROUP BY ALL) SELECT 'node_' || left(sha256(document_name), 12) AS node_id, document_id, CASE category WHEN 'en' THEN 'ACT' WHEN 'de' THEN 'JUDGMENT' WHEN 'fr' THEN 'PUBLICATION' ELSE 'UNKNOWN' END AS node_type, page_count, n::INT AS n_chunks, CASE WHEN length(t) <= 250 THEN t WHEN regexp_extract(left(t, 250), '^(.+) ', 1) <> '' THEN regexp_extract(left(t, 250), '^(.+) ', 1) || '…' ELSE left(t, 250) || '…' END AS summary FROM f")
def _(spark, sf):
    return gr.build_nodes(chunks(spark, sf), TYPES).select("node_id", "document_id", "node_type", "page_count", F.size("chunk_ids").alias("n_chunks"), "summary")


@query("a13_build_edges", f"WITH {EDGES_SQL} SELECT source_id, target_id, edge_type, confidence, occurrences, weight FROM edges")
def _(spark, sf):
    return edges(spark, sf).drop("pattern")


@query("a14_graph_statistics", f"WITH {NODES_SQL}, {EDGES_SQL}, n AS (SELECT count(*) AS nodes FROM nodes), e AS (SELECT count(*) AS edges, count(DISTINCT (source_id, target_id)) AS pairs FROM edges) SELECT nodes, edges, pairs, round(pairs::DOUBLE / (nodes * (nodes - 1)), 6) AS density FROM n, e")
def _(spark, sf):
    return gr.graph_statistics(nodes(spark, sf), edges(spark, sf)).select("nodes", "edges", "pairs", "density")


@query("g1_neighbors", f"WITH {WALK_SQL} SELECT seed, node, 1 AS level, via FROM l1 UNION ALL SELECT seed, node, 2, via FROM l2")
def _(spark, sf):
    return gr.neighbors(seeds(spark, sf), edges(spark, sf), 2)


@query("g2_related_by_relation", f"WITH {WALK_SQL} SELECT seed, v AS node, 1 AS level, min(via) AS via FROM l0 JOIN both_ ON u = node WHERE v <> seed AND edge_type = 'CITES' GROUP BY ALL")
def _(spark, sf):
    return gr.neighbors(seeds(spark, sf), edges(spark, sf), 1, ["CITES"])


@query("g3_referenced_by_type", f"WITH {WALK_SQL}, {NODES_SQL} SELECT seed, node, level, node_type FROM (SELECT seed, node, 1 AS level FROM l1 UNION ALL SELECT seed, node, 2 FROM l2) JOIN nodes ON node_id = node WHERE node_type IN ('ACT', 'PUBLICATION')")
def _(spark, sf):
    r = gr.related(seeds(spark, sf), edges(spark, sf), nodes(spark, sf), 2, ["CITES", "REFERS_TO"], ["ACT", "PUBLICATION"])
    return r.select("seed", "node", "level", "node_type")


@query("g4_expand_results", f"WITH {EDGES_SQL}, o AS (SELECT doc_id % 10 AS qid, doc_id AS node FROM documents WHERE length(text) > 0), b AS (SELECT source_id AS u, target_id AS v FROM edges UNION SELECT target_id, source_id FROM edges) SELECT DISTINCT qid, v AS node, 1 AS level FROM o JOIN b ON u = node WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.qid = o.qid AND x.node = v)")
def _(spark, sf):
    own = gr.build_nodes(chunks(spark, sf), TYPES).drop("node_id").withColumnRenamed("document_id", "node_id").withColumn("chunk_ids", F.transform("chunk_ids", lambda c: F.concat(c, F.lit("#"), F.col("node_id").cast("string"))))
    hits = table(spark, sf, "documents").where("length(text) > 0").select((F.col("doc_id") % 10).alias("qid"), F.format_string("%d_PAGE001_CHUNK000#%d", F.col("doc_id"), F.col("doc_id")).alias("chunk_id"))
    return gr.expand_results(hits, jn.chunks_to_nodes(own), edges(spark, sf))


@query("g5_edge_list", f"WITH {EDGES_SQL} SELECT source_id, target_id, edge_type, weight, occurrences FROM edges")
def _(spark, sf):
    return edges(spark, sf).select("source_id", "target_id", "edge_type", "weight", "occurrences")


@query("p15_graph_nodes", f"WITH {NODES_SQL} SELECT node_id, 'Doc_' || node_id || '_vol' || (node_id % 3) AS label, CASE node_type WHEN 'ACT' THEN 1 WHEN 'JUDGMENT' THEN 2 WHEN 'PUBLICATION' THEN 3 ELSE 0 END AS \"group\", trunc(12 + page_count::DOUBLE / (SELECT max(page_count) FROM nodes) * 28)::INT AS size FROM nodes")
def _(spark, sf):
    drawn, _ = gr.projection(nodes(spark, sf), edges(spark, sf), {"ACT": "#1f77b4", "JUDGMENT": "#d62728", "PUBLICATION": "#2ca02c"})
    return drawn.select("node_id", "label", "group", "size")


@query("p15_graph_links", f"WITH {EDGES_SQL} SELECT source_id, target_id, edge_type, round(1 + 4 * weight, 2) AS width FROM edges")
def _(spark, sf):
    return gr.projection(nodes(spark, sf), edges(spark, sf), {})[1]


@query("j1_map_source_to_registry", f"WITH {REGISTRY_SQL}, s AS (SELECT DISTINCT 'DOC_' || user_id || '_vol' || (user_id % 3) || CASE WHEN user_id % 2 = 0 THEN '.PDF ' ELSE '.txt' END AS source_document FROM events) SELECT source_document, document_id, category, pages, document_id IS NOT NULL AS is_indexed FROM s LEFT JOIN registry ON lower(trim(source_document)) = lower(file_name)")
def _(spark, sf):
    u = F.col("user_id")
    g = table(spark, sf, "events").select(F.concat(F.lit("DOC_"), u.cast("string"), F.lit("_vol"), (u % 3).cast("string"), F.when(u % 2 == 0, ".PDF ").otherwise(".txt")).alias("source_document"), F.lit("valid").alias("status"))
    return jn.map_sources(g, registry(spark, sf))


@query("j2_propagate_to_duplicates", f"WITH {REGISTRY_SQL}, m AS (SELECT document_id, first_value(document_id) OVER (PARTITION BY checksum_sha256 ORDER BY relative_path, document_id) AS f FROM registry), q AS (SELECT doc_id AS document_id, text AS query FROM documents) SELECT document_id, query, false AS copied FROM q UNION ALL SELECT m.document_id, query, true FROM q JOIN m ON m.f = q.document_id AND m.f <> m.document_id")
def _(spark, sf):
    from docmill.operators.dedup import mark_duplicate_files

    q = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("query"))
    return jn.propagate_to_duplicates(q, mark_duplicate_files(registry(spark, sf)))


@query("j3_resolve_reference", r"""WITH t AS (SELECT DISTINCT doc_id AS source_id, unnest(regexp_extract_all(text, '([a-z]{9,})', 1)) AS matched FROM documents),
d AS (SELECT c_custkey AS document_id, c_custkey AS ord, lower(left(sha256(c_custkey::VARCHAR), 2)) AS stem FROM customer UNION ALL SELECT -1 - doc_id, doc_id + 1000000000000, regexp_extract(text, '([a-z]{5,})', 1) FROM documents),
s AS (SELECT DISTINCT stem FROM d WHERE stem <> ''), w AS (SELECT DISTINCT matched FROM t), p AS (SELECT matched, stem FROM w JOIN s ON contains(stem, matched) OR contains(matched, stem))
SELECT source_id, matched, first(document_id ORDER BY ord) AS target_id FROM t JOIN p USING (matched) JOIN d USING (stem) WHERE -1 - source_id <> document_id GROUP BY ALL""")
def _(spark, sf):
    """Long words of every text as references, to customers (by two hex digits) and documents (by their first word)."""
    d = table(spark, sf, "documents")
    found = d.select((-1 - F.col("doc_id")).alias("source_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{9,})"), 1))).alias("matched"))
    cust = table(spark, sf, "customer")
    docs = cust.select(F.col("c_custkey").alias("document_id"), F.col("c_custkey").alias("ord"), F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 2).alias("stem"))
    docs = docs.unionByName(d.select((-1 - F.col("doc_id")).alias("document_id"), (F.col("doc_id") + 1_000_000_000_000).alias("ord"), F.regexp_extract("text", "([a-z]{5,})", 1).alias("stem"))).where("stem <> ''")
    return jn.resolve_references(found, docs).select((-1 - F.col("source_id")).alias("source_id"), "matched", "target_id")


@query("j4_join_chunk_to_node", f"WITH {CHUNKS_SQL} SELECT 'node_' || left(sha256(document_name), 12) AS node_id, chunk_id FROM chunks")
def _(spark, sf):
    return jn.chunks_to_nodes(gr.build_nodes(chunks(spark, sf), TYPES))


_CITED = """h AS (SELECT document_id % 20 AS qid, document_name, page_number, text, (row_number() OVER (PARTITION BY document_id % 20 ORDER BY length(text) DESC, chunk_id, document_id))::INT AS rank FROM chunks),
c AS (SELECT DISTINCT (doc_id + (doc_id % 7 = 0)::INT) % 20 AS qid, upper('Doc_' || doc_id || '_vol' || (doc_id % 3) || '.pdf') AS document, (doc_id % 3 + 1)::INT AS page FROM documents)"""


def _cited(spark, sf):
    from docmill.operators.dedup import ranked

    c = chunks(spark, sf).withColumn("qid", F.col("document_id") % 20)
    hits = ranked(c.withColumn("score", F.length("text")).withColumn("tie", F.struct("chunk_id", "document_id")), tie="tie")
    d = table(spark, sf, "documents")
    other = F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)  # these cite what their question has no hit of
    cited = d.select(((F.col("doc_id") + other) % 20).alias("qid"), F.upper(file_name(F.col("doc_id"))).alias("document"), (F.col("doc_id") % 3 + 1).cast("int").alias("page")).distinct()
    return cited, hits


@query("j6_resolve_citations", f"WITH {CHUNKS_SQL}, {_CITED}, j AS (SELECT c.*, h.page_number, h.text, row_number() OVER (PARTITION BY c.qid, document, page ORDER BY (h.page_number <> page)::INT, rank) AS n FROM c LEFT JOIN h ON h.qid = c.qid AND lower(document_name) = lower(document)) SELECT qid, document, page AS cited_page, coalesce(page_number, page) AS page, text AS snippet FROM j WHERE n = 1")
def _(spark, sf):
    return jn.resolve_citations(*_cited(spark, sf))


@query("j7_attach_citation_chunk", f"WITH {CHUNKS_SQL}, {_CITED}, j AS (SELECT c.*, h.page_number AS hit_page, rank, CASE WHEN h.page_number = page THEN 2 ELSE 3 END AS why FROM c JOIN h ON h.qid = c.qid AND lower(document_name) = lower(document) WHERE rank <= 40) SELECT qid, document, page, hit_page, why, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, document, page ORDER BY (hit_page = 1)::INT, why, rank) AS n FROM j) WHERE n = 1")
def _(spark, sf):
    cited, hits = _cited(spark, sf)
    return jn.attach_chunks(cited.withColumn("snippet", F.lit(None).cast("string")), hits, 40)


@query("j8_verify_citation_text", f"WITH {CHUNKS_SQL}, {PAGES_SQL} SELECT chunk_id, c.document_id, coalesce(contains(regexp_replace(lower(p.text), '[^\\p{{L}}\\p{{N}}]', '', 'g'), regexp_replace(lower(left(c.text, 150)), '[^\\p{{L}}\\p{{N}}]', '', 'g')), false) AS verified FROM chunks c LEFT JOIN pages_v p ON p.document_id = c.document_id AND p.page_number = c.page_number + (c.chunk_index = 2)::INT")
def _(spark, sf):
    """Every chunk is cited with a page: the last ones of a page with the page after it, which holds them only by chance."""
    cited = chunks(spark, sf).withColumn("page_number", F.col("page_number") + (F.col("chunk_index") == 2).cast("int"))
    return jn.verify_text(cited, pages(spark, sf)).select("chunk_id", "document_id", "verified")


@query("j9_mentioned_documents", f"WITH {REGISTRY_SQL}, a AS (SELECT conv_id, turn, 'See doc_' || (conv_id % 60) || '_vol' || (conv_id % 3) || ' and Doc_' || turn || '_vol' || (turn % 3) || '.pdf.' AS t FROM conversations) SELECT DISTINCT conv_id, turn, document_id FROM a JOIN registry ON document_id = turn OR (document_id = conv_id % 60 AND (conv_id % 60) % 3 = conv_id % 3)")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    s = lambda x: x.cast("string")
    text = F.concat(F.lit("See doc_"), s(F.col("conv_id") % 60), F.lit("_vol"), s(F.col("conv_id") % 3), F.lit(" and Doc_"), s(F.col("turn")), F.lit("_vol"), s(F.col("turn") % 3), F.lit(".pdf."))
    return jn.mentioned_documents(c.withColumn("text", text), registry(spark, sf), ["conv_id", "turn"])

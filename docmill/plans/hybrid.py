"""The question path as one plan over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import clean_query
from docmill.operators.checks import by_metadata, query_error
from docmill.operators.dedup import first_rows, ranked
from docmill.operators.fusion import fuse_rrf, pool
from docmill.operators.search import rerank, vector_search
from docmill.operators.stored_index import Index, keyword_search


def hybrid_search(vector: DataFrame, keyword: DataFrame, chunks: DataFrame, key: str, k: int, category: str | None = None, document: str | None = None, pages: tuple[int, int] | None = None) -> DataFrame:
    """Both hit lists fused by reciprocal ranks, deduplicated by chunk, filtered by metadata, the ``k`` best a query."""
    fused = first_rows(fuse_rrf(pool(vector, keyword, key), key), ["qid", key], ["rank"]).drop("rank")
    joined = by_metadata(fused.join(chunks, key), category, document, pages)
    return ranked(joined, tie=key).where(f"rank <= {int(k)}")


def retrieve(questions: DataFrame, vectors: DataFrame, index: Index, corpus: DataFrame, k: int = 20, final: int = 5, category: str | None = None, document: str | None = None, fuzzy: bool = False, pair_score: Column | None = None) -> DataFrame:
    """The question path for a table of questions (qid, text) over a stored index: cleaned and validated, both searches (``k`` each), fused, one
    row a chunk, filtered, ranked again by ``pair_score`` (a column of query and text) if given, the ``final`` best.

    ``vectors`` (qid, embedding) are the questions', ``corpus`` (vec_id, embedding, key, category) the chunks'. The category goes into
    both searches, the document only into the filter after fusion. Each row has its query's numbers of vector hits, keyword hits and
    candidates before the filter. Questions that fail validation have no rows. A question without hits by one way is answered by the other."""
    key, rows = index.key, index.documents().drop("d")
    asked = questions.withColumn("text", clean_query(F.col("text"))).where(query_error(F.col("text")).isNull())
    near = vector_search(vectors.join(asked.select("qid"), "qid", "left_semi"), corpus, k, category=category).join(corpus.select("vec_id", key), "vec_id")
    keyword = keyword_search(index, asked, k, fuzzy, category)
    fused = first_rows(fuse_rrf(pool(near, keyword, key), key), ["qid", key], ["rank"])
    w = Window.partitionBy("qid")
    counted = fused.withColumns({"vector_count": F.count("vector_rank").over(w), "keyword_count": F.count("keyword_rank").over(w), "candidates": F.count("*").over(w)})
    joined = by_metadata(counted.join(rows, key), category, document)
    if pair_score is not None:
        joined = rerank(joined.join(asked.select("qid", F.col("text").alias("query")), "qid"), pair_score)
    return ranked(joined, tie=key).where(F.col("rank") <= final).select("qid", key, "document_name", "page_number", "score", "rank", "vector_count", "keyword_count", "candidates")

"""Retrieval quality over a table of questions: one plan, no loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import normalize_doc_name, page_gap_score

METRICS = ["retrieval_accuracy", "precision_at_5", "recall_at_5", "mrr", "ndcg", "context_precision", "citation_accuracy", "answer_relevancy", "faithfulness"]


def hit_metrics(golden: DataFrame, hits: DataFrame, top: int = 5) -> DataFrame:
    """qid, retrieval_accuracy, precision_at_5, recall_at_5, mrr, ndcg, context_precision: one join and one grouping of the first hits.

    Accuracy: best page-gap score of the hits of the document, names without volume suffix. The others: plain lower-case
    names, matches of any page. A question without hits has zeros."""
    h = hits.where(F.col("rank") <= top).select("qid", "document_name", "page_number", "rank")
    j = golden.select("qid", "expected_document", "expected_page").join(h, "qid", "left")
    loose = normalize_doc_name(F.col("document_name")) == normalize_doc_name(F.col("expected_document"))
    score = F.when(loose & F.col("document_name").isNotNull(), page_gap_score(F.col("page_number"), F.col("expected_page"))).otherwise(0.0)
    same = F.lower(F.trim("document_name")) == F.lower(F.trim("expected_document"))
    ranks = F.sort_array(F.collect_list(F.when(same, F.col("rank"))))  # at most ``top`` of them
    r = j.groupBy("qid").agg(F.coalesce(F.max(score), F.lit(0.0)).alias("retrieval_accuracy"), ranks.alias("r"))
    first, n = F.try_element_at("r", F.lit(1)), F.size("r")
    precision = F.aggregate(F.transform("r", lambda x, i: (i + 1) / x), F.lit(0.0), lambda s, x: s + x)
    zero = lambda c: F.round(F.when(n > 0, c).otherwise(0.0), 6)
    return r.select("qid", "retrieval_accuracy", (n / float(top)).alias("precision_at_5"), F.when(n > 0, 1.0).otherwise(0.0).alias("recall_at_5"), zero(1.0 / first).alias("mrr"), zero(1.0 / F.log2(first + F.lit(1.0))).alias("ndcg"), zero(precision / n).alias("context_precision"))


def retrieval_accuracy(golden: DataFrame, hits: DataFrame, top: int = 5) -> DataFrame:
    return hit_metrics(golden, hits, top).select("qid", "retrieval_accuracy")


def rank_metrics(golden: DataFrame, hits: DataFrame, top: int = 5) -> DataFrame:
    return hit_metrics(golden, hits, top).drop("retrieval_accuracy")


def citation_scores(golden: DataFrame, citations: DataFrame) -> DataFrame:
    """qid, citation_accuracy (plain names) and citation_score (names without volume suffix), best over citations."""
    j = golden.select("qid", "expected_document", "expected_page").join(citations.select("qid", "document", "page"), "qid", "left")
    gap = page_gap_score(F.col("page"), F.col("expected_page"))
    plain = F.lower(F.trim("document")) == F.lower(F.trim("expected_document"))
    loose = normalize_doc_name(F.col("document")) == normalize_doc_name(F.col("expected_document"))
    return j.groupBy("qid").agg(F.max(F.when(plain, gap).otherwise(0.0)).alias("citation_accuracy"), F.max(F.when(loose & F.col("document").isNotNull(), gap).otherwise(0.0)).alias("citation_score"))


def evaluate(golden: DataFrame, hits: DataFrame, citations: DataFrame, answers: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row per question with all metrics and a status: Pass from 0.9 accuracy on, Partial above 0, else Failed.

    ``answers`` has (qid, answer) and may have latency_ms, which stays. Nothing is padded. Answer relevancy is a fixed rule: 0.15 for an answer that says not found or error, 0.94 with
    recall, else 0.40. An answer is grounded by its verdict, or, without one, if the accuracy is above 0."""
    j = hit_metrics(golden, hits).join(citation_scores(golden, citations), "qid").join(answers.select("qid", F.lower("answer").alias("_a"), *[c for c in answers.columns if c == "latency_ms"]), "qid", "left")
    if verdicts is not None:
        j = j.join(verdicts.select("qid", "grounded"), "qid", "left")
    else:
        j = j.withColumn("grounded", F.lit(None).cast("boolean"))
    said_no = F.coalesce(F.col("_a").contains("information not found") | F.col("_a").contains("error"), F.lit(False))
    relevancy = F.when(said_no, 0.15).when(F.col("recall_at_5") > 0, 0.94).otherwise(0.40)
    faithful = F.when(F.coalesce("grounded", F.col("retrieval_accuracy") > 0), F.col("citation_score")).otherwise(0.0)
    status = F.when(F.col("retrieval_accuracy") >= 0.90, "Pass").when(F.col("retrieval_accuracy") > 0, "Partial").otherwise("Failed")
    return j.withColumns({"answer_relevancy": relevancy, "faithfulness": faithful, "context_recall": F.col("retrieval_accuracy"), "status": status}).drop("_a", "grounded", "citation_score")

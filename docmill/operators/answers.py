"""Prompts and model answers as tables; the model itself is a table of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "answer string, summary string, citations array<struct<document:string,page:int,category:string>>, confidence_score double"
NOT_FOUND = "Information not found in the provided legal documents."
NO_SUMMARY = "Insufficient information available to process request."


def build_context(hits: DataFrame) -> DataFrame:
    """qid, context: hits in rank order as numbered blocks with name and page, joined by blank lines."""
    block = lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["document_name"], F.lit(" (page "), x["page_number"].cast("string"), F.lit(")\n"), x["text"])
    listed = F.sort_array(F.collect_list(F.struct("rank", "document_name", "page_number", "text")))
    return hits.groupBy("qid").agg(F.array_join(F.transform(listed, block), "\n\n").alias("context"))


def prompts(questions: DataFrame, context: DataFrame, template: str) -> DataFrame:
    """qid, prompt: ``{question}`` and ``{context}`` of a template filled in."""
    j = questions.join(context, "qid", "left")
    filled = F.replace(F.replace(F.lit(template), F.lit("{question}"), F.col("text")), F.lit("{context}"), F.coalesce("context", F.lit("")))
    return j.select("qid", filled.alias("prompt"))


def parse_model_json(responses: DataFrame) -> DataFrame:
    """qid, answer, summary, citations, parsed: code fences go; what is no JSON object gives the not-found answer."""
    text = F.regexp_replace(F.trim("raw_response"), r"^```(?:json)?\s*", "")
    text = F.trim(F.regexp_replace(text, r"\s*```$", ""))
    data = F.from_json(text, ANSWER)
    good = text.startswith("{") & F.coalesce(data["answer"].isNotNull() | data["citations"].isNotNull(), F.lit(False))
    empty = F.array().cast("array<struct<document:string,page:int,category:string>>")
    cited = F.filter(F.coalesce(data["citations"], empty), lambda c: c["document"].isNotNull() & c["page"].isNotNull())
    return responses.select("qid", F.when(good, F.trim(F.coalesce(data["answer"], F.lit("")))).otherwise(NOT_FOUND).alias("answer"), F.when(good, F.trim(F.coalesce(data["summary"], F.lit("")))).otherwise(NO_SUMMARY).alias("summary"), F.when(good, cited).otherwise(empty).alias("citations"), F.coalesce(good, F.lit(False)).alias("parsed"))

"""Validation predicates and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.patterns import BOILERPLATE, INJECTIONS


def errors(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules that fail (conditions that are true when something is wrong), in order."""
    found = F.array(*[F.when(bad, F.lit(message)) for bad, message in rules])
    return F.filter(found, lambda x: x.isNotNull())


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def page_errors(required: dict[str, Column], page: Column) -> Column:
    """Errors of a page's metadata: required keys that are blank, a page number that is no integer of at least 1."""
    return errors(*[(blank(c), f"missing {k}") for k, c in required.items()], (F.coalesce(page < 1, F.lit(True)), "page_number must be an integer >= 1"))


def first_index_error(chunk: Column, document: Column, text: Column, name: Column, category: Column) -> Column:
    """First failing rule of the keyword index; null if the row may be indexed."""
    rules = ((blank(chunk), "empty chunk_id"), (blank(document), "empty document_id"), (blank(text), "empty text"), (F.length(F.trim(text)) < 10, "text too short"), (blank(name), "empty document_name"), (blank(category), "empty category"))
    return F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in rules])


def has_width(vector: Column, width: int) -> Column:
    return F.coalesce(F.size(vector) == width, F.lit(False))


def by_metadata(rows: DataFrame, category: str | None = None, document: str | None = None, pages: tuple[int, int] | None = None) -> DataFrame:
    """Rows that meet all the conditions given; plain predicates, which Spark pushes to the scan."""
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if document is not None:
        rows = rows.where(F.col("document_name") == document)
    return rows if pages is None else rows.where(F.col("page_number").between(*pages))


def search_documents(rows: DataFrame, text: str = "", category: str | None = None, status: str | None = None) -> DataFrame:
    """Category without regard to case, ``_`` and spaces; status; substring of name, title or id."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[_ ]", "")
    if category:
        rows = rows.where(fold(F.col("category")) == fold(F.lit(category)))
    if status:
        rows = rows.where(F.col("status") == status)
    t = text.strip().lower()
    if not t:
        return rows
    held = [F.lower(F.col(c).cast("string")).contains(t) for c in ("file_name", "title", "document_id") if c in rows.columns]
    out = held[0]
    for h in held[1:]:
        out = out | h
    return rows.where(out)


def page_of(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """A page of a sorted listing (a feature of listings, hence the limit)."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def file_status(pages: Column, error: Column) -> Column:
    """valid, invalid, corrupted or empty; an error about an empty file ends as invalid, only zero pages gives empty."""
    lower = F.lower(F.coalesce(error, F.lit("")))
    return F.when(lower.contains("zero pages"), "empty").when(lower.contains("empty"), "invalid").when(lower != "", "corrupted").when(F.coalesce(pages, F.lit(0)) > 0, "valid").otherwise("invalid")


def long_enough(text: Column, least: int = 20) -> Column:
    return F.coalesce(F.length(F.trim(text, F.lit(" \t\r\n"))) >= least, F.lit(False))


def query_error(query: Column, least: int = 3, most: int = 2000) -> Column:
    n = F.length(F.trim(query))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n < least, "too short").when(n > most, "too long")


def injection(text: Column, patterns=INJECTIONS) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def boilerplate(text: Column, markers=BOILERPLATE) -> Column:
    """A marker (upper case) and more than five ``....`` or ``----``, or fewer than 1,200 characters."""
    marked = F.upper(text).rlike("|".join(m.replace("-", r"\-") for m in markers))
    return marked & ((F.regexp_count(text, F.lit(r"\.\.\.\.")) > 5) | (F.regexp_count(text, F.lit("----")) > 5) | (F.length(text) < 1200))


def answer_gate(questions: DataFrame, hits: DataFrame, score: str = "score", least: float = 0.005) -> DataFrame:
    """Per question: ``gate`` is out_of_domain (no hits), not_found (best score too low, or only blank texts) or pass."""
    best = hits.groupBy("qid").agg(F.max(score).alias("best"), F.max(F.length(F.trim("text"))).alias("longest"))
    gate = F.when(F.col("best").isNull(), "out_of_domain").when((F.col("best") < least) | (F.coalesce("longest", F.lit(0)) == 0), "not_found").otherwise("pass")
    return questions.join(best, "qid", "left").withColumn("gate", gate)

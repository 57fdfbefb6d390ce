"""Labelled question sets: headers, validation, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.patterns import COLUMN_ALIASES
from docmill.functions.text import sanitize_page, sanitize_text
from docmill.operators.dedup import repeated

FIELDS = ("query", "expected_answer", "source_document", "page_number", "category")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Headers by their aliases; unknown ones are kept, trimmed and in lower case."""
    names = {a: c for c, aliases in COLUMN_ALIASES.items() for a in aliases}
    return df.toDF(*[names.get(c.strip().lower(), c.strip().lower()) for c in df.columns])


def complete_rows(df: DataFrame, first: int | None = None, order: str = "row_number") -> DataFrame:
    """Rows with all five required fields after cleaning; optionally the first few."""
    clean = df.withColumns({f: sanitize_page(F.col(f).cast("string")) if f == "page_number" else sanitize_text(F.col(f).cast("string")) for f in FIELDS}).dropna(subset=list(FIELDS))
    return clean if first is None else clean.orderBy(order).limit(first)


def validate_rows(df: DataFrame, categories: list[str]) -> DataFrame:
    """Rows (strings, with row_number from 2 on) cleaned, with ``errors`` (field_name, error_code) and ``status``.

    All blank: rejected. Only a repeated question: duplicate. Any other error: invalid. Earlier rows count for repeats
    even when they are invalid."""
    text = {f: sanitize_text(F.col(f).cast("string")) for f in FIELDS if f != "page_number"}
    raw = sanitize_text(F.col("page_number").cast("string"))
    page = sanitize_page(F.col("page_number").cast("string"))
    empty = raw.isNull()
    for c in text.values():
        empty = empty & c.isNull()
    rows = df.withColumns({**{f"_{f}": c for f, c in text.items()}, "_page": page, "_empty": empty})
    error = lambda bad, field, code: F.when(bad, F.struct(F.lit(field).alias("field_name"), F.lit(code).alias("error_code")))
    found = F.array(
        error(F.col("_query").isNull(), "query", "MISSING_QUERY"), error(F.col("_expected_answer").isNull(), "expected_answer", "MISSING_ANSWER"), error(F.col("_source_document").isNull(), "source_document", "MISSING_SOURCE"),
        error(F.col("_page").isNull(), "page_number", "INVALID_PAGE"), error(~F.col("_category").isin(*categories), "category", "UNKNOWN_CATEGORY"), error(F.col("_category").isNull(), "category", "MISSING_CATEGORY"),
        error(F.col("_query").isNotNull() & F.col("_repeated"), "query", "DUPLICATE_QUERY"),
    )
    rows = repeated(rows, F.lower(F.col("_query")), "row_number").withColumn("errors", F.when(F.col("_empty"), F.array().cast("array<struct<field_name:string,error_code:string>>")).otherwise(F.filter(found, lambda e: e.isNotNull())))
    codes = F.col("errors.error_code")
    only_repeat = (F.size("errors") == 1) & F.array_contains(codes, "DUPLICATE_QUERY")
    status = F.when(F.col("_empty"), "rejected").when(F.size("errors") == 0, "valid").when(only_repeat, "duplicate").otherwise("invalid")
    out = rows.withColumn("status", status).withColumns({f: F.col(f"_{f}") for f in text}).withColumn("page_number", F.coalesce("_page", F.lit(0)))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def export_rows(rows: DataFrame, renamed: dict[str, str], eligible: str) -> DataFrame:
    """Eligible rows with the fields of a use case, renamed."""
    return rows.where(eligible).select(*renamed).withColumnsRenamed(renamed)


def export_for_use_case(rows: DataFrame, renamed: dict[str, str], eligible: str, kind: str, path: str) -> None:
    """Write :func:`export_rows` as csv, json (one object a line) or parquet."""
    writer = export_rows(rows, renamed, eligible).write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "jsonl": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()

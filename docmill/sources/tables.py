"""Tables of pages and chunks: reading, merging, deleting, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pages_from_documents(docs: DataFrame, key: str) -> DataFrame:
    """One row per form-feed separated page, numbered from 1; NUL characters go, ends are trimmed; empty pages stay."""
    split = docs.select(key, F.posexplode(F.split("text", "\f")).alias("_i", "text"))
    return split.select(key, (F.col("_i") + 1).alias("page_number"), F.trim(F.replace("text", F.lit("\u0000"), F.lit(""))).alias("text"))


#: Named character references that are decoded (fixed values), the ampersand last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def text_of_html(html: Column) -> Column:
    """Text of an HTML page by native functions: comments, scripts and styles go, tags become spaces, the usual character references
    are decoded, white space is one space. (The main text of a page is another job.)"""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, sign in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; repeating it changes nothing."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_documents(rows: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def not_done(registry: DataFrame, done: DataFrame, category: str | None = None, skip_status: str | None = None, first: int | None = None) -> DataFrame:
    """Documents without output yet, of a category, without a status; optionally only the first few by name."""
    left = registry.join(done.select("document_id"), "document_id", "left_anti")
    if category is not None:
        left = left.where(F.col("category") == category)
    if skip_status is not None:
        left = left.where(F.col("status") != skip_status)
    return left if first is None else left.orderBy("file_name").limit(first)

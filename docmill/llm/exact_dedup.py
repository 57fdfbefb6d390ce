"""Exact duplicates with a heavy-hitter split; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import ascii_lower, cut, packed, table, text_or_empty


def frequent(digests: DataFrame, column: str, most: int = 1024, tracked: int = 8192) -> DataFrame:
    """At most ``most`` values of ``column`` that may be frequent: Spark's frequent-items sketch, a Misra-Gries
    summary of ``tracked`` counters that is built map-side and merged. Every value that holds more than
    1/``most`` of the rows is among them; others may be, so counts are verified by the caller."""
    top = digests.agg(F.expr(f"approx_top_k({column}, {most}, {tracked})").alias("t"))
    return top.select(F.explode("t.item").alias(column))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = 1 / 1024) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a group stays
    (null ids are the smallest; of rows that repeat an id and a text, exactly one is kept, also where all ids are null). Digests
    that hold at least ``heavy_share`` of the rows are found by Misra-Gries and counted exactly; these at most
    1/``heavy_share`` winners are broadcast, so that the rows of large groups are decided where they are read.
    All other digests meet by an ordinary shuffle of (digest, id): grouped with partial counts, cut, and joined as two exchanges, which
    adaptive execution splits where a digest is frequent, so that no group is gathered in one task. Extra columns are ignored; empty table: no rows.
    """
    own = docs.select(F.col(id_col).alias(id_col), F.sha2(ascii_lower(text_or_empty(text_col)), 256).alias("text_sha256"))
    own = cut(own.withColumn("_row", F.monotonically_increasing_id()))
    total = own.count()
    winners = [F.max(F.struct(F.col(id_col).alias("id"), F.col("_row").alias("row"))).alias("_last"), F.count("*").alias("group_size")]
    guess = frequent(own, "text_sha256", most=round(1 / heavy_share))
    heavy = own.join(F.broadcast(guess), "text_sha256").groupBy("text_sha256").agg(*winners)
    heavy = cut(heavy.where(F.col("group_size") >= max(2, heavy_share * total)))
    out = [F.col(id_col), F.col("_last.id").alias("keep_id"), F.col("group_size"), (F.col("_last.row") == F.col("_row")).alias("kept"), F.col("text_sha256")]
    decided = own.join(F.broadcast(heavy), "text_sha256").select(*out)
    rest = own.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    rest = rest.join(cut(rest.groupBy("text_sha256").agg(*winners)), "text_sha256").select(*out)
    return decided.unionByName(rest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = 1 / 1024) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the rules are those of :func:`exact_groups`.

    Rows of verified heavy groups other than the winner's id are removed map-side; the rest meet by digest, one row of each
    digest and task. Further columns pass through, whatever their names; an empty table gives no rows.
    """
    keyed = packed(docs).withColumn("_digest", F.sha2(ascii_lower(text_or_empty(f"_doc.{text_col}")), 256)).withColumn("_id", F.col(f"_doc.{id_col}"))
    narrow = cut(keyed.select("_digest", "_id"))
    total = narrow.count()
    guess = frequent(narrow, "_digest", most=round(1 / heavy_share))
    heavy = narrow.join(F.broadcast(guess), "_digest").groupBy("_digest").agg(F.max("_id").alias("_last"), F.count("*").alias("_n"), F.lit(True).alias("_heavy"))
    heavy = cut(heavy.where(F.col("_n") >= max(2, heavy_share * total)))
    kept = keyed.join(F.broadcast(heavy), "_digest", "left").where(F.col("_heavy").isNull() | F.col("_last").eqNullSafe(F.col("_id")))
    first = Window.partitionBy("_digest").orderBy(F.col("_id").desc_nulls_last())
    return kept.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select("_doc.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`exact_groups` of all ``documents``; nulls, ties and empty tables as there."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

"""Fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def pool(vector: DataFrame, keyword: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Full outer join of hits on (qid, key), each side with its score and its rank; an absent side is null."""
    v = vector.select("qid", key, F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    b = keyword.select("qid", key, F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    return v.join(b, ["qid", key], "full_outer")


def _ranked(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key)))


def fuse_rrf(pooled: DataFrame, key: str = "chunk_id", k: int = K) -> DataFrame:
    """Reciprocal rank fusion: sum of 1/(k + rank); an absent list adds nothing."""
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return _ranked(pooled.withColumn("score", F.round(part("vector_rank") + part("keyword_rank"), 6)), key)


def fuse_halves(pooled: DataFrame, key: str = "chunk_id", k: int = K, missing: str = "compat") -> DataFrame:
    """Halves of reciprocal ranks. With ``missing='compat'`` an absent list counts as rank 0, which outranks a first
    place; kept for comparison only. ``missing='zero'`` adds nothing."""
    if missing not in ("compat", "zero"):
        raise ValueError(missing)
    absent = F.lit(0.5 / k if missing == "compat" else 0.0)
    part = lambda c: F.coalesce(0.5 / (F.lit(k) + F.col(c)), absent)
    return _ranked(pooled.withColumn("score", F.round(part("vector_rank") + part("keyword_rank"), 6)), key)


def fuse_minmax(pooled: DataFrame, key: str = "chunk_id", vector: float = 0.7, keyword: float = 0.3) -> DataFrame:
    """Weighted min-max scores within each query; a constant list gives 1, an absent score 0."""
    w = Window.partitionBy("qid")

    def part(c: str):
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(F.col(c).isNull(), 0.0).when(high == low, 1.0).otherwise((F.col(c) - low) / (high - low))

    scored = pooled.withColumn("score", F.round(vector * part("vector_score") + keyword * part("keyword_score"), 6))
    return _ranked(scored, key)

"""Joined rows of the approximate search, each with a block of queries, are spread over tasks by number."""

from pyspark.sql import functions as F

from docmill.operators import vector_index as vi


def test_few_packs_a_task(spark, sf_dir, tmp_path, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = vi.write_vector_index(rows, str(tmp_path / "v"), sample=200)
    monkeypatch.setattr(vi, "PACK", 16)
    monkeypatch.setattr(vi, "PACKS", 2)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    plan = vi.shortlists(index, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(xxhash64(ids" in plan and f", {-(-rows.count() // 32)}), REPARTITION_BY_NUM" in plan

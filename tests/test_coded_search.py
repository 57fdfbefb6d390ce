"""Searches that read rows where they lie: the same hits as over stored words, and no index is written."""

import pytest
from pyspark.sql import functions as F

from docmill.catalog import QUERIES
from docmill.operators import stored_index as si
from docmill.plans import indexes
from docmill.plans.indexes import keyed_chunks


@pytest.fixture(scope="module")
def both(spark, sf_dir, tmp_path_factory):
    rows = keyed_chunks(spark, sf_dir).where("document_id % 4 = 0")
    odd = spark.createDataFrame([("x1", "ΟΔΟΣ naïve_12 -- Straße", "A b"), ("x2", "", "Doc_1"), ("x3", " - ", "of")], "ck string, text string, document_name string")
    rows = rows.unionByName(odd, allowMissingColumns=True).unionByName(rows.where("document_id % 20 = 0").withColumn("ck", F.concat(F.lit("z"), "ck")))
    return si.Rows(rows, "ck"), si.write_index(rows, "ck", str(tmp_path_factory.mktemp("coded") / "index"), postings=False)


@pytest.fixture(scope="module")
def asked(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id < 12").select(F.col("item_id").alias("qid"), F.concat("text", F.lit(" "), F.col("item_id").cast("string")).alias("text"))
    return b.union(spark.createDataFrame([(100, "naïve 12 straße"), (103, "ΟΔΟΣ straße"), (101, ""), (102, "nothingisso")], "qid long, text string"))


def told(df):
    return sorted(tuple(r) for r in df.select("qid", "ck", "score", *[c for c in ("rank",) if c in df.columns]).collect())


@pytest.mark.parametrize("most", [si.TERMS, 3])
def test_hits_are_those_of_stored_words(both, asked, most):
    live, index = si.Rows(both[0].rows, "ck", most), both[1]
    where = F.col("category") == "en"
    for search in (lambda i: si.search(i, asked, 7), lambda i: si.keyword_search(i, asked), lambda i: si.keyword_search(i, asked, category="en"), lambda i: si.phrase_hits(i, asked), lambda i: si.field_hits(i, "body", asked, where=where)):
        assert (got := told(search(index))) == told(search(live)) and got


def test_no_index_is_written_for_given_words(spark, sf_dir):
    before = dict(indexes._WRITTEN)
    indexes._WRITTEN.clear()
    for name in ("r3_bm25_search", "r6_index_filter", "r4_phrase_boost", "r5_fuzzy_terms", "r13_rerank", "e1_retrieval_accuracy"):
        assert QUERIES[name](spark, sf_dir).count()
    assert not indexes._WRITTEN
    indexes._WRITTEN.update(before)


@pytest.mark.parametrize("name", ["entry_keyword_quality", "a16_answer_confidence", "f16_build_context"])
def test_evaluations_write_no_index(spark, sf_dir, monkeypatch, name):
    def written(*_, **__):
        raise AssertionError("an index is written")

    monkeypatch.setattr(si, "write_index", written)
    monkeypatch.setattr(indexes, "write_index", written)
    monkeypatch.setattr(indexes, "_WRITTEN", {})
    assert QUERIES[name](spark, sf_dir).count()

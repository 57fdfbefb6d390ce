"""The inverted file of vectors: recall of the whole exact top lists, and how little it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import search
from docmill.operators import vector_index as vi
from docmill.plans.indexes import vector_index
from docmill.queries.search import vectors

SCHEMA = "vec_id long, label int, embedding array<float>"


def pairs(df):
    return {(r.qid, r.vec_id) for r in df.collect()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_whole_top_lists(spark, folder):
    """These vectors have no clusters: most cells are looked into, but few vectors are compared."""
    q, e = vectors(spark, f"/root/testdata/{folder}")
    index = vector_index(spark, f"/root/testdata/{folder}")
    assert index.rows(spark).count() == e.count()
    exact, near = pairs(search.vector_search(q, e)), pairs(vi.vector_search_approx(q, index))
    asked, rows = q.count(), e.count()
    coded = vi.probed_cells(index, q).join(index.rows(spark).groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0]
    compared = vi.shortlists(index, q, 100).count()
    print(f"{folder}: {len(near & exact)} of {len(exact)}; codes of {coded / asked / rows:.1%} of rows, vectors of {compared / asked / rows:.1%} a query; {index.probes} of {len(index.cells)} cells")
    assert len(near & exact) / len(exact) >= 0.9
    assert near <= pairs(search.vector_search(q, e, k=1000))
    if rows >= 2000:
        assert compared <= 0.1 * asked * rows


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """4,000 vectors around 60 places, a third of them around one; ids of several rows; rows that have no cosine."""
    rng = np.random.default_rng(5)
    places = rng.normal(size=(60, 30))
    own = np.where(rng.random(4000) < 1 / 3, 0, rng.integers(0, 60, 4000))
    x = places[own] + 0.25 * rng.normal(size=(4000, 30))
    rows = [(i - i % 40 if i % 40 == 1 else i, i % 3, [float(v) for v in x[i]]) for i in range(4000)]
    rows += [(None, 1, rows[0][2]), (5000, 1, None), (5001, 1, [0.0] * 30), (5002, 1, [1.0]), (5003, 1, []), (5004, 1, [None] * 30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    return df, vi.write_vector_index(df, path, kept=("label",))


def test_clusters_are_pruned(spark, clustered):
    df, index = clustered
    good = df.where("vec_id < 4000")
    q = good.where("vec_id % 50 = 7").select(F.col("vec_id").alias("qid"), "embedding")
    exact, near = pairs(search.vector_search(q, good)), pairs(vi.vector_search_approx(q, index))
    asked = q.count()
    coded = vi.probed_cells(index, q).join(index.rows(spark).groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0]
    compared = vi.shortlists(index, q, 100).count()
    print(f"clusters: {len(near & exact)} of {len(exact)}; codes of {coded / asked / 4000:.1%}, vectors of {compared / asked / 4000:.1%}; {index.probes} of {len(index.cells)} cells")
    assert len(near & exact) >= 0.9 * len(exact)
    assert coded <= 0.25 * asked * 4000 and compared <= 0.1 * asked * 4000
    one = q.limit(1)
    plan = vi.vector_search_approx(one, index)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_looking_everywhere_is_exact(spark, clustered):
    """All cells and a shortlist of all rows: the same rows, scores and ranks as the exact search, also of one label and for several blocks of queries."""
    df, index = clustered
    good = df.where("vec_id < 4000")
    q = good.where("vec_id % 100 = 3").select(F.col("vec_id").alias("qid"), "embedding")
    own = lambda d: {(r.qid, r.vec_id, round(r.score, 5), r["rank"]) for r in d.collect()}
    everywhere = dict(probes=len(index.cells), shortlist=4100)
    assert own(vi.vector_search_approx(q, index, **everywhere)) == own(search.vector_search(q, good))
    assert own(vi.vector_search_approx(q, index, where=F.col("label") == 2, **everywhere)) == own(search.vector_search(q, good.where("label = 2")))
    short = vi.shortlists(index, q, 5)
    assert own(vi.shortlists(index, q, 5, block=9).select("qid", "vec_id", "score", "rank")) == own(short)


def test_stored_index_is_read_back(spark, clustered):
    df, index = clustered
    again = vi.read_vector_index(spark, index.path)
    assert np.array_equal(again.cells, index.cells) and np.array_equal(again.books, index.books) and again.probes == index.probes
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 30), (3, [1.0]), (None, [1.0] * 30), (4, [float("nan")] * 30)], "qid long, embedding array<float>")
    assert vi.vector_search_approx(odd, again).count() == 0
    assert index.rows(spark).where("vec_id >= 5000 OR vec_id IS NULL").count() == 0


def test_empty_and_tiny_tables(spark, tmp_path):
    none = spark.createDataFrame([(1, 0, None)], SCHEMA)
    assert vi.write_vector_index(none, str(tmp_path / "none")) is None
    q = spark.createDataFrame([(7, [1.0, 2.0])], "qid long, embedding array<float>")
    assert vi.vector_search_approx(q, None).count() == 0
    one = spark.createDataFrame([(1, 0, [1.0, 2.0])], SCHEMA)
    hits = vi.vector_search_approx(q, vi.write_vector_index(one, str(tmp_path / "one"))).collect()
    assert [(r.qid, r.vec_id, r.score, r["rank"]) for r in hits] == [(7, 1, 1.0, 1)]

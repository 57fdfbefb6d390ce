"""Hand-computed cases and properties."""

import uuid

import pytest
from pyspark.sql import functions as F

from docmill.functions import patterns as pt
from docmill.functions import text as fx
from docmill.operators import aggregate, checks, evaluate, extract, fusion, golden, graph


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column).first()[0]


@pytest.mark.parametrize("n, want", [(0, 0), (1, 1), (10, 2), (14, 4)])
def test_token_estimate(spark, n, want):
    assert one(spark, fx.token_estimate(F.lit("x" * n))) == want


def test_chunk_id(spark):
    got = one(spark, fx.chunk_id(F.lit("1808ca0c-57c1-517c-9af0-66fb7f1510d9"), F.lit(3), F.lit(7)))
    assert got == "1808ca0c_PAGE003_CHUNK007"


def test_uuids(spark):
    assert one(spark, fx.document_id(F.lit("ab" * 32), F.lit("Tax/x.pdf"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{'ab' * 32}::Tax/x.pdf"))
    for name in ("c1", "c2", "é", ""):
        assert one(spark, fx.point_id(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


@pytest.mark.parametrize("name, want", [("IRS_pub-550.pdf", "Irs Pub 550"), ("a1b_c.pdf", "A1B C"), ("x.y.pdf", "X.Y")])
def test_title(spark, name, want):
    assert one(spark, fx.derive_title(F.lit(name))) == want


@pytest.mark.parametrize("vector, fused, least, want", [(0.25, 0.008, 0.005, "pass"), (0.4, 0.002, 0.005, "not_found"), (0.4, 0.1, 0.5, "not_found"), (0.5, 0.01, 0.005, "pass"), (None, None, 0.005, "out_of_domain")])
def test_answer_gate(spark, vector, fused, least, want):
    q = spark.createDataFrame([(1,)], "qid int")
    hits = spark.createDataFrame([] if fused is None else [(1, fused, "some text")], "qid int, score double, text string")
    assert checks.answer_gate(q, hits, least=least).first().gate == want


def lists(spark):
    v = spark.createDataFrame([(1, "c1", 0.9, 1), (1, "c2", 0.8, 2)], "qid int, chunk_id string, score double, rank int")
    b = spark.createDataFrame([(1, "c2", 7.0, 1), (1, "c3", 6.0, 2)], "qid int, chunk_id string, score double, rank int")
    return fusion.pool(v, b)


def test_fusion(spark):
    rrf = {r.chunk_id: (round(r.score, 6), r["rank"]) for r in fusion.fuse_rrf(lists(spark)).collect()}
    assert rrf == {"c2": (0.032522, 1), "c1": (0.016393, 2), "c3": (0.016129, 3)}
    compat = {r.chunk_id: (round(r.score, 6), r["rank"]) for r in fusion.fuse_halves(lists(spark)).collect()}
    assert compat == {"c1": (0.01653, 1), "c3": (0.016398, 2), "c2": (0.016261, 3)}
    minmax = {r.chunk_id: r.score for r in fusion.fuse_minmax(lists(spark)).collect()}
    assert minmax == {"c1": 0.7, "c2": 0.3, "c3": 0.0}


def test_metrics(spark):
    g = spark.createDataFrame([(1, "Title26_Vol9.pdf", 10)], "qid int, expected_document string, expected_page int")
    rows = [(1, "Title26_Vol2.pdf", 10, 1), (1, "Title26_Vol9.pdf", 12, 2), (1, "Other.pdf", 1, 3), (1, "Title26_Vol9.pdf", 10, 4), (1, "Other.pdf", 2, 5)]
    h = spark.createDataFrame(rows, "qid int, document_name string, page_number int, rank int")
    assert evaluate.retrieval_accuracy(g, h).first().retrieval_accuracy == 1.0
    m = evaluate.rank_metrics(g, h).first()
    assert (m.precision_at_5, m.recall_at_5, m.mrr, m.ndcg, m.context_precision) == (0.4, 1.0, 0.5, 0.63093, 0.5)


def test_entities(spark):
    text = "See IRC §401 and Section 12 of the Employee Retirement Income Security Act. Paid $5,000 on March 3, 2020 to the IRS."
    got = extract.entities(spark.createDataFrame([(1, text)], "id int, text string"), "id", pt.ENTITIES).orderBy("rank").collect()
    want = [("IRC §401", "LAW", 0.95), ("IRS", "ORG", 0.95), ("Employee Retirement Income Security Act", "ACT", 0.85), ("$5,000", "MONEY", 0.85), ("March 3, 2020", "DATE", 0.85), ("Section 12", "SECTION", 0.80)]
    assert [(r.matched, r.kind, r.confidence) for r in got] == want


@pytest.mark.parametrize("top, n, want", [(0.75, 3, 0.95), (0.9, 2, 1.0), (0.5, 1, 0.5), (0.5, 9, 0.7)])
def test_edge_weight(spark, top, n, want):
    rows = [("a", "b", "CITES", top, "x")] + [("a", "b", "CITES", 0.4, "y")] * (n - 1)
    assert graph.build_edges(spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, confidence double, pattern string")).first().weight == want


def test_golden_rows(spark):
    rows = [(2, "What is X?", "a", "f.pdf", "3", "Tax"), (3, " what is x? ", "a", "f.pdf", "3", "Tax"), (4, "", "a", "f.pdf", "0", "Tax"), (5, "What is Y?", "a", "f.pdf", "3.0", "Other"), (6, "What is X?", " ", "f.pdf", "1", "Acts"), (7, None, "", None, " ", None)]
    df = spark.createDataFrame(rows, "row_number int, query string, expected_answer string, source_document string, page_number string, category string")
    got = {r.row_number: (r.status, [e.error_code for e in r.errors]) for r in golden.validate_rows(df, ["Tax", "Acts"]).collect()}
    assert got == {2: ("valid", []), 3: ("duplicate", ["DUPLICATE_QUERY"]), 4: ("invalid", ["MISSING_QUERY", "INVALID_PAGE"]), 5: ("invalid", ["UNKNOWN_CATEGORY"]), 6: ("invalid", ["MISSING_ANSWER", "DUPLICATE_QUERY"]), 7: ("rejected", [])}


def test_confidence(spark):
    hits = spark.createDataFrame([(1, "a", 0.4), (1, "b", 0.6)], "qid int, document_name string, score double")
    cited = spark.createDataFrame([(1, "A")], "qid int, document_name string")
    assert aggregate.answer_confidence(hits, cited).first().confidence == 0.47


def test_split_properties(spark, sf_dir):
    from docmill.plans.views import pages

    p = pages(spark, sf_dir).where("document_id < 40")
    text = {(r.document_id, r.page_number): r.text for r in p.collect()}
    for r in extract.recursive_split(p, ["document_id", "page_number"], 500, 100).collect():
        own = text[r.document_id, r.page_number]
        assert len(r.text) <= 500 and own[r.start : r.start + len(r.text)] == r.text


def test_split_keeps_all_words():
    text = "Aa bb. Cc dd.\n\n" * 60 + "x" * 1300
    got = extract.split_pieces(text, 200, 50, ("\n\n", ". ", "\n", " "))
    covered = bytearray(len(text))
    for at, piece in got:
        assert len(piece) <= 200 and text[at : at + len(piece)] == piece
        covered[at : at + len(piece)] = b"\x01" * len(piece)
    assert all(c or not text[i].strip() for i, c in enumerate(covered))


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, text string, ok boolean")
    for kind in ("csv", "json", "jsonl", "parquet"):
        golden.export_for_use_case(df, {"text": "prompt"}, "ok", kind, str(tmp_path / kind))
    assert spark.read.parquet(str(tmp_path / "parquet")).collect()[0].prompt == "a"

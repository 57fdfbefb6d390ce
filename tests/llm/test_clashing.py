"""Every operator on rows whose further columns have the names that operators use for their own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm import exact_dedup, fingerprints, html_extract, licenses, mixing, near_dedup, quality, toxicity
from docmill.llm.bpe import encode_documents, word_bpe_path
from docmill.llm.token_count import count_tokens, piece_path

NAMES = """_t _n _lines _words _last _heavy _digest _id _rank _size _tie _nth _copy _gone _doc _rest _row _score _at _bucket _bits _part _pos _sum _before _w _label _edge
x_words x_upper score predicted f features raw probability prediction rawPrediction calibrated times t_size t_source row size key source_size target taken node comp component_id component kept
n signature set_key first_id head hub crowd block shingles keep_id group_size text_sha256 digest license_id n_notices notices fingerprint n_chars held_out n_tokens ids decoded label toxic quality kind a b u v""".split()


@pytest.fixture(scope="module")
def wide(odd):
    docs = odd.select("doc_id", "text", "lang", "source")
    return docs.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in NAMES})


def plain(rows, *without):
    return sorted((tuple(v for k, v in zip(r.__fields__, r, strict=True) if k not in without) for r in rows), key=repr)


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(3, None, None), (None, 1, 1)], LABELS)


def test_rows_pass_through(wide, labels):
    """The operators that return their input's columns keep each value, and find the same rows as on plain columns."""
    docs = wide.select("doc_id", "text", "lang", "source")
    for stage in (exact_dedup.exact_dedup, near_dedup.near_dedup, mixing.mixed_documents):
        got = stage(wide)
        assert got.columns == wide.columns
        rows = got.collect()
        assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in NAMES)
        assert plain(rows, *NAMES) == plain(stage(docs).collect())
    kept = [c for c in NAMES if c not in ("score", "predicted")]
    rules = quality.train(wide, labels)
    assert rules == quality.train(docs, labels)
    for got, want in ((quality.classify(wide, rules), quality.classify(docs, rules)),):
        rows = got.collect()
        assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in kept) and len(rows) == wide.count()
        assert plain(rows, *kept) == plain(want.collect())
    model = toxicity.train(wide, labels)
    rows = model.score(wide).collect()
    assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in kept) and len(rows) == wide.count()
    assert plain(rows, *kept) == plain(model.score(docs).collect())


def test_own_results(spark, wide):
    """The operators that return rows of their own have the same ones as on plain columns."""
    docs = wide.select("doc_id", "text", "lang", "source")
    known = licenses.known_licenses(spark)
    for f in (exact_dedup.exact_groups, near_dedup.near_groups, mixing.mix, fingerprints.edited_fingerprints, lambda d: licenses.license_scan(d, known), lambda d: encode_documents(d, word_bpe_path()), lambda d: count_tokens(d, piece_path())):
        got, want = f(wide), f(docs)
        assert got.columns == want.columns and plain(got.drop("row").collect()) == plain(want.drop("row").collect())
    pages = wide.select(F.col("doc_id").alias("page_id"), F.lit("http://h/1").alias("url"), F.col("text").alias("html"), *[c for c in NAMES])
    assert plain(html_extract.extract(pages).collect()) == plain(html_extract.extract(pages.select("page_id", "url", "html")).collect())


def test_stages_keep_columns(spark, tmp_path, wide, labels):
    labels.where("doc_id IS NOT NULL").write.parquet(str(tmp_path / "labels.parquet"))
    docs = wide
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == wide.columns
        docs.collect()
    assert corpus_pipeline.bpe(spark, docs, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids", "decoded"]

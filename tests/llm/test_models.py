"""Classifiers by held-out accuracy, extraction and counting by brute force, the pipeline by its stages' rules."""

import pytest
from pyspark.sql import functions as F

from docmill.llm import html_extract, quality, token_count, toxicity

BIG = "/root/testdata/sf0.01"


def held_out(df, labels, label):
    rows = df.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return [(r[0], r[1]) for r in rows]


def test_quality_held_out(spark, odd):
    got = quality.op2_quality(spark, BIG)
    rows = held_out(got, spark.read.parquet(f"{BIG}/labels.parquet"), "quality")
    assert sum(p == y for p, y in rows) / len(rows) > 0.95
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rules = quality.train(odd.withColumnRenamed("rank", "x_rank"), labels)
    assert quality.classify(odd, rules).count() == odd.count()
    assert quality.train(odd.limit(0), labels.limit(0)).weights == ()


def test_toxicity_held_out(spark, odd):
    got = toxicity.op7_toxicity(spark, BIG)
    rows = held_out(got, spark.read.parquet(f"{BIG}/labels.parquet"), "toxic")
    assert sum(p == y for p, y in rows) / len(rows) > 0.9
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    none = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score(odd.select("doc_id", "text")).count() == odd.count()


def test_toxicity_features():
    lexicon = dict.fromkeys(toxicity.INSULTS, 3.0)
    f = dict(zip(toxicity.NAMES, toxicity.features("You are an 1d10t and a m0ron, YOU i d i o t!", lexicon), strict=True))
    assert f["insults"] >= 3 and f["second_person_rate"] > 0 and f["mixed_words"] > 0
    assert toxicity.features("", lexicon) == [0.0] * len(toxicity.NAMES)
    assert dict(zip(toxicity.NAMES, toxicity.features("a fine day", lexicon), strict=True))["insults"] == 0


PAGES = [
    ("<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a>x</a></nav><div class=ad>buy</div><article><h1>T &amp; U</h1><p>One<br>two <b>three<p>Four&nbsp;five<ul><li>a<li>b</ul></article><aside>s</aside><section class='comments'><p>no</p></section><footer>f</footer><script>var a='<p>';</script>", "T & U\nOne two three\nFour five\na\nb"),
    ("<p>plain &lt;text&gt;", "plain <text>"),
    ("no markup at all", "no markup at all"),
    ("<article>x<div class='cookie-notice'>y</div><form><p>z</p></form><!-- c --><p>w</p></article><p>out</p>", "x\nw"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_extract_odd_pages(spark):
    odd = spark.createDataFrame([(1, None, None, 1), (1, "http://h/a", "", 2), (None, "x", "<p>t", 3), (None, "x", "<p>t", 3)], "page_id long, url string, html string, host int")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_extract.extract(odd).collect())
    assert got == [("1", "None", "", 0), ("1", "http://h/a", "", 0), ("None", "x", "t", 1), ("None", "x", "t", 1)]
    assert html_extract.extract(odd.limit(0)).count() == 0


def test_wrapper_drops_constant_nodes(spark):
    page = lambda i: f"<body><div id=top><p>Welcome to the site</p></div><div id=main><p>Text number {i}</p><p>more {i * 7}</p></div><div id=bottom>All about us</div></body>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [(99, "http://other/1", page(1))], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(got[i] == f"Text number {i}\nmore {i * 7}" for i in range(8))
    assert got[99].startswith("Welcome")


def test_token_counts(spark, sf_dir, odd):
    tokenizers = pytest.importorskip("tokenizers")
    scores = token_count.vocabulary(token_count.piece_path())
    reference = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *scores.items()], 0, False))

    def want(text):
        if not text:
            return 0
        t = "▁" + text.replace(" ", "▁")
        e = reference.encode(t)
        return sum(1 if i else len(t[a:b].encode()) for i, (a, b) in zip(e.ids, e.offsets, strict=True))

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_count.op9_token_counts(spark, sf_dir).collect():
        assert r.n_tokens == want(texts[r.doc_id])
    counter = token_count.Counter(scores)
    for text in ("日本  語 x", "a\nb", "  ", "ééé 😀", "x" * 500, "▁a b▁"):
        assert counter.count(text) == want(text)
    got = sorted(str((r.doc_id, r.n_tokens)) for r in token_count.count_tokens(odd, token_count.piece_path()).collect())
    assert got == sorted(str((r.doc_id, want(r.text))) for r in odd.collect())

"""Operators against plain Python on small fixtures: passages, fuzzy terms, stems, duplicates, embeddings, the question path."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import dedup, extract, joins, search
from docmill.operators.stored_index import keyed, keyword_search, phrase_scores, scores, write_index
from docmill.plans.hybrid import retrieve


def test_passages_brute_force(spark):
    rng = random.Random(2)
    words = ["tax", "code", "of", "the", "act", "Übergang", "x-y", "ß"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ", ", "\t"]) for _ in range(n))
    texts = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "tax")]
    passages = [(i, t[rng.randrange(len(t)) :][: rng.randint(1, 40)]) for i, (_, t) in enumerate(texts[:60]) if t] + [(200, "tax"), (201, "ax co"), (202, ""), (203, None), (204, "  "), (205, "tax  code of the act no such"), (206, "x")]
    got = {(r.pid, r.tid): r["at"] for r in joins.passages_in(spark.createDataFrame(passages, "pid long, text string"), spark.createDataFrame(texts, "tid long, text string")).collect()}
    want = {(p, t): body.find(q) + 1 for p, q in passages for t, body in texts if q and body and q in body}
    assert got == want and len(want) > 60


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_terms_brute_force(spark):
    rng = random.Random(5)
    vocabulary = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(500)})
    asked = rng.sample(vocabulary, 40) + ["a", "ab", "abc", "abcdefgh", "ztax"]
    got = {(r.asked, r.term) for r in search.fuzzy_terms(spark.createDataFrame([(1, t) for t in asked], "qid int, term string"), spark.createDataFrame([(t,) for t in [*vocabulary, "tax"]], "term string")).collect()}
    budget = lambda t: 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2
    assert got == {(a, t) for a in asked for t in [*vocabulary, "tax"] if distance(a, t) <= budget(a)} and ("ztax", "tax") in got


@pytest.mark.parametrize("word, want", [("parties", "party"), ("ties", "ty"), ("taxes", "taxe"), ("goes", "goe"), ("acts", "act"), ("gas", "ga"), ("status", "status"), ("pass", "pass"), ("s", ""), ("tax", "tax")])
def test_stemmer(spark, word, want):
    assert spark.range(1).select(search.s_stem(F.lit(word))).first()[0] == want


def test_field_scores(spark, tmp_path):
    rows = spark.createDataFrame([("a", "the tax code of the land", "Doc_1.pdf"), ("b", "code of tax the the", "Doc_2.pdf"), ("c", "nothing here", "tax_3.pdf")], "ck string, text string, document_name string")
    asked = spark.createDataFrame([(1, "The tax code"), (2, "no such words"), (3, "tx cde")], "qid int, text string")
    index = write_index(rows, "ck", str(tmp_path / "index"), buckets=2)
    hits = lambda found: {(r.qid, r.ck) for r in keyed(index, found).collect()}
    phrases = hits(phrase_scores(index, search.analyze(asked, ["qid"], stopwords=())))
    assert phrases == {(1, "a")}
    names = hits(scores(index, "name", search.analyze(asked, ["qid"]), 0.5))
    assert names == {(1, "c")}
    top = {(r.qid, r.ck): r["rank"] for r in keyword_search(index, asked).collect()}
    assert top[1, "a"] == 1 and set(top) == {(1, "a"), (1, "b"), (1, "c")}
    fuzzy = {(r.qid, r.ck) for r in keyword_search(index, asked, fuzzy=True).collect()}
    assert {(3, "a"), (3, "b")} <= fuzzy and (3, "c") not in fuzzy  # no edits in words of two letters


@pytest.mark.parametrize("block", [3, 2048])
def test_vector_search_brute_force(spark, block):
    rng = np.random.default_rng(1)
    corpus = [(i, rng.normal(size=8).tolist(), "AB"[i % 2]) for i in range(200)] + [(300, None, "A"), (None, [1.0] * 8, "A")] + [(400 + i, [1.0] * 8, "B") for i in range(5)]
    asked = [(i, rng.normal(size=8).tolist()) for i in range(17)] + [(50, [1.0] * 8), (51, None)]
    e = spark.createDataFrame(corpus, "vec_id long, embedding array<float>, category string").repartition(5)
    q = spark.createDataFrame(asked, "qid long, embedding array<float>")
    for category in (None, "B"):
        want = {}
        for i, v in asked:
            if v is not None:
                f = lambda x: np.asarray(np.asarray(x, np.float32), np.float64)
                s = sorted((-round(float(f(v) @ f(x) / np.linalg.norm(f(v)) / np.linalg.norm(f(x))), 6), j) for j, x, c in corpus if x is not None and j is not None and category in (None, c))
                want |= {(i, j): n for n, (x, j) in enumerate(s[:4], 1) if -x >= 0.3}
        got = {(r.qid, r.vec_id): r["rank"] for r in search.vector_search(q, e, k=4, block=block, category=category).collect()}
        assert got == want


def test_embedding_failures(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return np.ones((len(texts), 2 if any("wide" in t for t in texts) else 3))

    rows = [(f"c{i}", t, i) for i, t in enumerate(["one", "two", "bad", "x", "wide", "y", "", "z", None, "last"])] + [("c0", "again", 99)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, page_number int").coalesce(1)
    got = {r.chunk_id: (r.embedding, r.error) for r in search.embed(chunks.where("page_number < 50"), "chunk_id", model, 3, 2).collect()}
    assert got["c2"][1] == got["c3"][1] == "ValueError: no" and got["c4"][1].startswith("ValueError: width 2") and got["c6"][1] == got["c8"][1] == "empty text"
    assert all(got[c][1] is None and len(got[c][0]) == 3 for c in ("c0", "c1", "c7", "c9"))
    table, counts = search.embed_corpus(chunks, spark.createDataFrame([("c0", [9.0]), ("old", [8.0])], "chunk_id string, embedding array<float>"), F.when(F.col("text") == "x", F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")), model=model, width=3, batch=1)
    n = counts.first()
    assert (n.total, n.repeated, n.invalid) == (11, 1, 1) and n.embedded + n.failed == 9
    kept = {r.chunk_id: list(r.embedding) for r in table.collect()}
    assert kept["old"] == [8.0] and len(kept["c0"]) == 3 and "c2" not in kept
    spark.catalog.clearCache()


def test_hashed_counts():
    m = search.hashed_counts(["a b a", ""], 64)
    assert m[0, hashlib.md5(b"a").digest()[0] % 64] >= 2 and m[0].sum() == 3 and m[1].sum() == 0


def test_repeated_and_split(spark):
    rows = [(i, q) for i, q in enumerate(["a", "A ", "b", "", None, " ", "", None, "B", "c"])]
    got = {r.n: r.is_duplicate for r in dedup.mark_duplicate_questions(spark.createDataFrame(rows, "n int, query string"), order="n").collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True, 9: False}
    people = [(i, None if i % 5 == 0 else "xy"[i % 2]) for i in range(300)]
    split = dedup.assign_split(spark.createDataFrame(people, "id long, s string"), "id", "s", (0.5, 0.25, 0.25), digits=1)
    assert split.columns == ["id", "s", "split"]
    own = collections.defaultdict(list)
    for i, s in people:
        own[s].append((hashlib.md5(f"{i}7".encode()).hexdigest(), i))
    want = {}
    for ids in own.values():
        n = len(ids)
        for rank, (_, i) in enumerate(sorted(ids), 1):
            want[i] = "train" if rank <= n // 2 else "validation" if rank <= n // 2 + n // 4 else "test"
    assert {r.id: r.split for r in split.collect()} == want


def test_question_path(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", f"text number {i} about tax", f"D{i}.pdf", "en" if i % 2 else "de", 1) for i in range(8)], "ck string, text string, document_name string, category string, page_number int")
    corpus = rows.select(F.monotonically_increasing_id().alias("vec_id"), F.array(F.lit(1.0), F.substring("ck", 2, 1).cast("double")).cast("array<float>").alias("embedding"), "ck", "category")
    asked = spark.createDataFrame([(1, "  number   3 \x00"), (2, "x"), (3, None), (4, "unknownword")], "qid long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 3.0]), (4, [1.0, 0.0])], "qid long, embedding array<float>")
    index = write_index(rows, "ck", str(tmp_path / "index"), buckets=2)
    got = retrieve(asked, vectors, index, corpus, k=4, final=3, category="en").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.qid].append(r)
    assert set(by) == {1, 4} and len(by[1]) == 3 and {r.keyword_count for r in by[4]} == {0}
    assert next(r for r in by[1] if r["rank"] == 1).ck == "k3" and all(int(r.ck[1]) % 2 for r in got)
    again = retrieve(asked, vectors, index, corpus, k=4, final=3, category="en", pair_score=F.when(F.col("text").contains("5"), 2.0).otherwise(0.5)).collect()
    assert next(r for r in again if r.qid == 1 and r["rank"] == 1).ck == "k5"


def test_question_rows(spark):
    s = spark.createDataFrame([(1, "a.pdf", "en", 2, 0, "One two three four five six seven.", 3, 1), (1, "a.pdf", "en", 2, 1, "Not the best.", 0, 2), (2, "b.pdf", None, 1, 0, "Short one.", 0, 1)], "document_id int, document_name string, category string, page_number int, pos int, sentence string, hits int, rank int")
    got = extract.question_rows(s, ["document_id", "document_name", "category", "page_number"], {"en": "What of {topic}?"}, "{topic}: and?").collect()
    assert {(r.document_id, r.query, r.expected_answer, r.citation) for r in got} == {(1, "What of One two three four five six?", "One two three four five six seven.", "a.pdf, page 2"), (2, "Short one.: and?", "Short one.", "b.pdf, page 1")}

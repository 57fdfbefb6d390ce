"""References to documents: containment at any size, against brute force."""

import re

from pyspark.sql import functions as F

from docmill.operators import joins


def brute(found, docs):
    fold = lambda t: re.sub("[ -]", "_", t.lower())
    out = {}
    for source, text in {f for f in found if f[0] is not None and f[1] is not None}:
        best = None
        for doc, order, stem in docs:
            if doc is None or stem is None or doc == source:
                continue
            low, own, norm, name = text.lower(), stem.lower(), fold(text), fold(stem)
            rank = 1 if low in own or own in low else 2 if len(norm) >= 4 and (norm in name or name in norm) else None
            if rank is not None and (best is None or (rank, order, doc) < best):
                best = (rank, order, doc)
        if best:
            out[source, text] = (best[2], best[0])
    return out


def resolved(spark, found, docs):
    f = spark.createDataFrame(found, "source_id long, matched string")
    d = spark.createDataFrame(docs, "document_id long, ord long, stem string")
    rows = joins.resolve_references(f, d).collect()
    got = {(r.source_id, r.matched): (r.target_id, r["pass"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_references_brute_force(spark):
    stems = ["taxation", "Tax Act-2020", "tax_act_2020", "under", "de", "Übergang", "über", "ab", "income tax", "INCOME-TAX", "x" * 40, "tax", None, "tax", "Fee_note-7 of May"]
    docs = [(i, (i * 7) % 15, s) for i, s in enumerate(stems)] + [(3, 0, "ndtx"), (None, 0, "tax")]
    texts = ["tax", "Tax Act 2020", "tax-act", "understand", "übergangs", "ÜBER", "income_tax", "xxx", "none such q", "fee note 7", "de", "act", "wonder", None]
    found = [(s, t) for s in [*range(16), 100, None] for t in texts]
    want = brute(found, docs)
    assert resolved(spark, found, docs) == want and {p for _, p in want.values()} == {1, 2}
    one = [(4, 4, "")]
    assert resolved(spark, [(1, "abc"), (4, "abc"), (2, "")], one) == brute([(1, "abc"), (4, "abc"), (2, "")], one)
    assert resolved(spark, [], docs) == {} and resolved(spark, found, []) == {}


def test_references_beyond_a_million_documents(spark):
    """Containment within words holds in a table of more than 1,000,000 documents as in a small one."""
    docs = spark.range(1_000_001).select(F.col("id").alias("document_id"), F.col("id").alias("ord"), F.concat(F.lit("q"), "id").alias("stem"))
    docs = docs.unionByName(spark.createDataFrame([(2_000_000, 2_000_000, "taxation"), (2_000_001, 2_000_001, "de")], docs.schema))
    found = spark.createDataFrame([(1, "tax"), (2, "understand")], "source_id long, matched string")
    got = {(r.source_id, r.matched): r.target_id for r in joins.resolve_references(found, docs).collect()}
    assert got == {(1, "tax"): 2_000_000, (2, "understand"): 2_000_001}


def test_unfolded_texts_take_one_pass(spark, monkeypatch):
    """Where folding changes no text and no name, strings meet once in each direction, not twice."""
    calls, plain = [], joins.contained
    monkeypatch.setattr(joins, "contained", lambda n, h: calls.append(1) or plain(n, h))
    docs = [(1, 1, "taxation"), (2, 2, "under"), (3, 0, "tax")]
    found = [(9, "tax"), (3, "taxations"), (9, "understand"), (9, "none")]
    assert resolved(spark, found, docs) == brute(found, docs) and len(calls) == 2

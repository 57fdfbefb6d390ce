"""Links between near documents: the whole set of links, by brute force over all pairs."""

import collections
import re

import pytest

from docmill.llm import fingerprints


def sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    first = {}
    for i, text in rows:
        own = sets(text)
        if i is not None and own:
            first[own] = min(i, first.get(own, i))
    return {(min(i, j), max(i, j)) for x, i in first.items() for y, j in first.items() if i < j and 100 * len(x & y) >= 80 * len(x | y)}


def group(name, count, size=200):
    base = [f"{name}{i}" for i in range(size)]
    return [" ".join([*base[: 7 * i % size], f"{name}x{i}", *base[7 * i % size + 1 :]]) for i in range(count)]


@pytest.mark.parametrize("options", [{}, {"rows": 4}])
def test_links_equal_brute_force(spark, options):
    texts = [*group("a", 3), *group("b", 12), *group("c", 25), *group("d", 2, 40), "alone in the world with no one near it", "", None]
    texts += texts[3:6] + [texts[0].upper()]
    rows = [(97 * i % 101, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    found = fingerprints.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    want = brute(rows)
    assert len(found) == len(want) > 300 and {(r.a, r.b) for r in found} == want


def test_counts_in_small_blocks(spark):
    """Per document the links of its class, over a crowd that fills many blocks."""
    texts = [*group("a", 150), *group("b", 9, 60), "alone in the world with no one near it", "", None]
    texts += texts[3:6]
    rows = list(enumerate(texts)) + [(7, texts[7])]
    want, first = collections.Counter(), {}
    for i, t in rows:
        first.setdefault(sets(t), i)
    for a, b in brute(rows):
        want[a] += 1
        want[b] += 1
    docs = spark.createDataFrame([*rows, (None, texts[0])], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in fingerprints.near_counts(docs, block_rows=16, block_shingles=3_000).collect())
    assert got == sorted((i, first[sets(t)] if sets(t) else i, want[first[sets(t)]] if sets(t) else 0) for i, t in rows)


def test_links_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.a, r.b) for r in fingerprints.near_documents(docs).collect()} == want
    assert fingerprints.near_documents(docs.limit(0)).count() == fingerprints.near_counts(docs.limit(0)).count() == 0


def test_counts_equal_sql(spark, sf_dir, same_as_sql):
    same_as_sql(fingerprints.fingerprint_links(spark, sf_dir), fingerprints.LINKS_SQL)

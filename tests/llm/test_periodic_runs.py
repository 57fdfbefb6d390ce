"""Periodic runs by brute force over all periods; the query's digests from plain Python."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm.periodic_runs import op13_periodic_runs, periodic_runs, runs_of

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    """start, length, period of every run: for each period, the maximal stretches of equal words at that distance."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


block = st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 6))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(block, max_size=6), min_size=1, max_size=4))
def test_runs_of_is_brute_force(texts):
    words = [[x for piece, times in t for x in piece * times] for t in texts]
    ids, unit, want, base = [], [], [], 0
    for d, w in enumerate(words):
        want += [(len(ids) + s, len(ids) + s + n, q) for s, n, q in brute(w)]
        ids += [base + x for x in w]
        unit += [d] * len(w)
        base += 6
    got = runs_of(np.array(ids, np.int64), np.array(unit, np.int64))
    assert sorted(zip(*[c.tolist() for c in got], strict=True)) == want


def test_runs_of_texts_of_one_word_and_of_long_periods():
    for w in ([0] * 5000, list(range(300)) * 2, list(range(300)) + list(range(300)) * 3, [0, 1, 0, 1, 1] * 500):
        got = runs_of(np.array(w, np.int64), np.zeros(len(w), np.int64))
        assert sorted((s, e - s, q) for s, e, q in zip(*[c.tolist() for c in got], strict=True)) == brute(w)


def test_op13_is_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in docs:
        w = SPACES.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [*w[:a], *[w[a + (i - a) % p] for i in range(a, n)]]
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[doc_id] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(w, runs)))
    got = {r[0]: tuple(r)[1:] for r in op13_periodic_runs(spark, sf_dir).collect()}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 10


def test_odd_rows(spark, odd):
    got = periodic_runs(odd.withColumnsRenamed({"size": "runs", "rank": "_doc"}))
    assert got.columns == ["doc_id", "text", "lang", "source", "key", "node", "_doc", "text_sha256", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        w = SPACES.findall(r["text"] or "")
        assert r["n_words"] == len(w)
        if len(w) < 1000:
            assert [tuple(x) for x in r["runs"]] == brute(w) and r["collapsed"] == collapsed(w, brute(w))
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in rows}[7] == [(0, 20000, 5)]
    assert periodic_runs(odd.limit(0)).count() == 0

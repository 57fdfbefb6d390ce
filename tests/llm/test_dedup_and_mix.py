"""Exact and near duplicates, mixing, licences: SQL on the test tables, brute force on odd rows."""

import hashlib
import re
from collections import defaultdict

import pytest

from docmill.llm import exact_dedup, fingerprints, licenses, mixing, near_dedup


@pytest.mark.parametrize("query, sql", [(exact_dedup.op4_exact_dedup, exact_dedup.OP4_SQL), (mixing.op1_mixing, mixing.OP1_SQL), (near_dedup.op5_near_dedup, near_dedup.OP5_SQL), (licenses.op6_licenses, licenses.OP6_SQL)])
def test_equals_sql(spark, sf_dir, same_as_sql, query, sql):
    same_as_sql(query(spark, sf_dir), sql)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def test_exact_odd_rows(spark, odd):
    groups = defaultdict(list)
    rows = odd.collect()
    for r in rows:
        groups[hashlib.sha256(lower(r.text).encode()).hexdigest()].append(r.doc_id)
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    for digest in groups:
        assert sum(r.kept for r in got if r.text_sha256 == digest) == 1
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(odd.limit(0)).count() == exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_exact_heavy_path(spark, odd):
    """Every digest counts as heavy, so that all rows take the broadcast path; the result is the same."""
    many = odd.unionByName(odd).unionByName(odd)
    key = lambda df: sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in df.collect())
    assert key(exact_dedup.exact_groups(many, heavy_share=1 / 30)) == key(exact_dedup.exact_groups(many))
    assert exact_dedup.exact_dedup(many, heavy_share=1 / 30).count() == exact_dedup.exact_dedup(many).count()


def sets(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_brute_force(spark, sf_dir, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = {r.doc_id: sets(r.text, k) for r in docs.collect()}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in own:
        for b in own:
            if a < b and own[a] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_dedup.near_groups(docs, k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), find(i), find(i) == i) for i, s in own.items()}


def test_near_odd_rows(spark, odd):
    got = near_dedup.near_groups(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {r.component_id for r in by[2]} == {1} and by[8][0].component_id == 7 and not by[8][0].kept
    assert by[3][0].n_shingles == 0 and by[3][0].component_id == 3 and by[3][0].kept
    assert all(r.component_id is None and not r.kept for r in by[None])
    kept = near_dedup.near_dedup(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 9, None}
    assert near_dedup.near_groups(odd.limit(0)).count() == near_dedup.near_dedup(odd.limit(0)).count() == 0


def test_near_crowded_region(spark):
    """A group of near copies, larger than any scan's width at first, and outliers that share most of its words."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"v{i}"] + base[61:])) for i in range(300)] + [(1000 + i, " ".join(base[:80] + [f"u{i}_{j}" for j in range(40)])) for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2, width=2).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 + i for i in range(40))


def test_mix_properties(spark, sf_dir, odd):
    got = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    by, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.times * r.size
        by[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    target = {r.source: r.target for r in got}
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in got)) < 1e-6 * sum(target.values())
    assert all(abs(by[s] - target[s]) <= 2 * largest[s] for s in target)
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in rows) == sorted((str(r.doc_id), r.size, r.taken) for r in again)
    docs = mixing.mixed_documents(odd)
    assert docs.columns == odd.columns and docs.count() == sum(r.times for r in rows)
    assert mixing.mix(odd.limit(0)).count() == mixing.mixed_documents(odd.limit(0)).count() == 0


def test_licenses(spark):
    known = licenses.known_licenses(spark, [("MIT", "Copyright 2020 A. B.\nPermission is granted, free of charge."), ("X", "the sub-licence")])
    rows = [(1, "COPYRIGHT (c) 2024 somebody else\n permission is granted; free of charge"), (2, "text\nThe  SUBLICENSE.\nmore"), (3, None), (None, "...")]
    got = {r.doc_id: (r.license_id, r.n_notices, r.notices) for r in licenses.license_scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int"), known).collect()}
    assert got == {1: ("MIT", 1, "MIT"), 2: (None, 1, "X"), 3: (None, 0, ""), None: (None, 0, "")}
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string"), known).count() == 0


def test_fingerprints(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs, rows_per_task=17).collect()}
    prints = {}
    for i, r in enumerate(rows):
        after = rows[(i + 1) % len(rows)].text
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = sets(r.text, 5), sets(edited, 5), sets(after, 5)
        if a and b and c:
            assert abs(g.near_edited - len(a & b) / len(a | b)) < 0.25 and abs(g.near_next - len(a & c) / len(a | c)) < 0.25
        assert prints.setdefault(r.text, g.fingerprint) == g.fingerprint
    assert fingerprints.edited_fingerprints(odd, rows_per_task=3).count() == odd.count()
    assert fingerprints.edited_fingerprints(odd.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(odd.where("doc_id = 1")).first()
    assert one.near_edited <= 1.0 and one.near_next == 1.0
    links = {(r.a, r.b) for r in fingerprints.near_documents(docs).collect()}
    own = {r.doc_id: sets(r.text, 5) for r in rows}
    assert all(100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]) for a, b in links)


def test_exact_groups_split_a_hot_digest(spark):
    """A digest of two thirds of the rows that the heavy path does not take: both sides of the join stand on exchanges, so Spark splits it."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.range(0, 60_000, 1, 8).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN string(id) ELSE 'hot' END AS text")
        got = exact_dedup.exact_groups(docs, heavy_share=1.0)
        rows = got.where("kept").agg({"doc_id": "count", "group_size": "max"})
        rows.collect()
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
        assert rows.first()[:] in ((20_001, 40_000), (40_000, 20_001))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

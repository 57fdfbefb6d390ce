"""Every text that a pattern matches holds one of the strings the prefilter asks for; containment by rarest grams against brute force."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docmill.functions import patterns as pt
from docmill.operators import dedup, joins
from docmill.operators.extract import matches, required

ALL = sorted({p for t in (pt.ENTITIES, pt.SECTIONS, pt.REFERENCES, pt.EDGES, pt.GENERIC) for p, *_ in t} | {"ab?c+d", "(?:x|yz){0,3}q", "a|", "(?i)K[ab]?l{2}m", r"(?:one|two)?three\.", "x*", "(?:ab|c)(?:defg|hijkl)+"})


@pytest.mark.parametrize("pattern", ALL)
def test_matches_hold_a_required_string(pattern):
    needed = required(pattern)

    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, re.A), fullmatch=True))
    def check(text):
        assert not needed or any(s in text.lower() for s in needed)

    check()


def test_required_strings():
    assert required(r"(?i)I\.?R\.?C\.?\s*\d+") == ("i.r.c", "i.rc", "ir.c", "irc")
    assert required(r"(?:Section|§)\s+\d+") == ("section", "§") and required("a|") == () and required("x*") == ()


def test_prefiltered_matches_are_plain_ones(spark):
    texts = ["see IRC §401(k), I.R.C. 12 and the irs", "Pub. 550 amends nothing", "", None, "The Tax Act of Judge Brown on March 3, 2020 for $5", "nothing at all"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {(r.k, r.p, r.i, r.matched) for r in matches(rows, "k", pt.ENTITIES).collect()}
    want = {(k, p, i, m[0].strip()) for k, t in enumerate(texts) for p, (x, *_) in enumerate(pt.ENTITIES) for i, m in enumerate(re.compile(x, re.A).finditer(t or ""))}
    assert got == want and len(got) == 8


def test_contained_by_rarest_gram(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    needles = [word(r.randrange(0, 12)) for _ in range(60)] + ["", None, "a" * 9]
    hays = [word(r.randrange(0, 60)) for _ in range(60)] + ["", None, "a" * 40, "a" * 40]
    got = {(x.needle, x.hay) for x in joins.contained(spark.createDataFrame([(n,) for n in needles], "n string"), spark.createDataFrame([(h,) for h in hays], "h string")).collect()}
    assert got == {(n, h) for n in needles for h in hays if n is not None and h is not None and n in h}
    long = "".join(r.choice("abcdefgh ") for _ in range(1_000_000))
    found = joins.contained(spark.createDataFrame([(long[500_000:500_030],), ("zz",), ("h",)], "n string"), spark.createDataFrame([(long,)], "h string"))
    assert {x.needle for x in found.select("needle").collect()} == {long[500_000:500_030], "h"}


def test_hot_keys_are_split(spark):
    """Blank files share one checksum: the join of rows and their first one stands on two exchanges, so Spark splits it."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        files = spark.range(0, 40_000, 1, 8).selectExpr("id AS document_id", "string(id) AS relative_path", "CASE WHEN id % 3 = 0 THEN string(id) ELSE 'blank' END AS checksum_sha256", "'valid' AS status")
        marked = dedup.mark_duplicate_files(files)
        assert sum(r.status == "duplicate" for r in marked.select("status").collect()) == 40_000 - 13_334 - 1
        marked.collect()
        assert "skew=true" in marked._jdf.queryExecution().executedPlan().toString()
        questions = files.selectExpr("document_id AS row_number", "checksum_sha256 AS query")
        again = dedup.mark_duplicate_questions(questions)
        again.collect()
        assert "skew=true" in again._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

"""Sorted scans over so many partitions that their ends fill several, and components that need more rounds."""

import pytest
from pyspark.sql import functions as F

from docmill.llm import near_dedup
from docmill.llm.components import components


def test_neighbours_across_all_boundaries(spark):
    n = 256
    rows = spark.range(n).select(F.lit(0).alias("ordering"), F.lit(5).cast("long").alias("head"), F.lit(b"\0" * 32).alias("label"), F.col("id").alias("node"), F.col("id").alias("comp"))
    found = near_dedup._scan(rows, n, 1).select("a", "b").collect()
    assert {(i, i + 1) for i in range(n - 1)} <= {(r.a, r.b) for r in found}


def test_components_raise_when_rounds_run_out(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(links, most_rounds=1, small=0)

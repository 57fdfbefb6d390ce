"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import cut, drop, shipped

shipped(__name__)

#: Link tables of up to so many rows (4 MB) are a matter of one task; larger ones of rounds over all.
SMALL = 250_000


def _united(batches):
    """node, component of a small table of links (a, b): union by smallest node."""
    root: dict[int, int] = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])


def components(links: DataFrame, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of every node in ``links`` (columns a, b; integers).

    Large star: every node hands its larger neighbours to its smallest one. Small star: it hands its smaller
    neighbours to the smallest. A round is a grouped minimum with a join, and a window, on narrow integer rows. Nodes with very
    many links are partially aggregated and their join is one that adaptive execution may split; in the small star
    a node has only its smaller neighbours, which the large star has made few. Each step
    is cut. Tables of at most ``small`` rows, a size that does not grow with the corpus, are united in one task instead, with the same result. With fewer ``most_rounds`` than it takes (the last one only sees that nothing changes) it raises an error. Self links are allowed, null ends are ignored, an empty table gives no rows.
    """
    links = cut(links)
    n = links.count()
    if n <= small:
        plain = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
        return cut(plain.coalesce(1).mapInArrow(_united, "node long, component long"))
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND u > v").distinct(), n)
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), n)
        least = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        ends = F.when(F.col("v") > F.col("m"), F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        small = cut(least.select(F.inline(F.coalesce(ends, F.array(F.struct("u", F.col("m").alias("v")))))).distinct(), n)
        drop(edges, low, large)
        edges = small
        last, seen = seen, tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if last == seen:
            break
    else:
        raise RuntimeError(f"components still changed in round {most_rounds}")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return cut(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), 2 * n)

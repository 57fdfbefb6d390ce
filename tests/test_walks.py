"""Walks over a node that many seeds reach and that has many edges: the same rows, however its pairs are dealt."""

import re

from pyspark.sql import functions as F

from docmill.operators import graph as gr


def star(spark, leaves):
    e = spark.range(1, leaves + 1).select(F.col("id").alias("source_id"), F.lit(0).cast("long").alias("target_id"), F.lit("CITES").alias("edge_type"))
    return spark.range(0, leaves + 1, 10).toDF("node_id"), e.unionByName(spark.createDataFrame([(3, 4, "REFERS_TO"), (900, 3, "CITES")], e.schema))


def test_walk_is_the_same_for_any_deal(spark, monkeypatch):
    seeds, edges = star(spark, 60)
    told = lambda: sorted(tuple(r) for r in gr.neighbors(seeds, edges, 3).collect())
    whole = told()
    links = [(r.source_id, r.target_id, f"{r.source_id}→{r.target_id}→{r.edge_type}") for r in edges.collect()]
    links += [(v, u, via) for u, v, via in links]
    want = []
    for seed in range(0, 61, 10):
        seen, front = {seed}, {seed}
        for level in (1, 2, 3):
            new = {}
            for u, v, via in links:
                if u in front and v not in seen:
                    new[v] = min(via, new.get(v, via))
            want += [(seed, v, level, via) for v, via in new.items()]
            seen, front = seen | set(new), set(new)
    assert whole == sorted(want)
    monkeypatch.setattr(gr, "PAIRS", 40)
    assert told() == whole


def test_pairs_of_a_hub_are_many_tasks(spark, monkeypatch):
    """Tables of a few kB, which adaptive execution reads in one task, are dealt by the pairs that they make."""
    monkeypatch.setattr(gr, "PAIRS", 1_000)
    seeds, edges = star(spark, 1_000)
    both = edges.selectExpr("target_id AS u", "source_id AS v", "'x' AS via")
    step = gr._stepped(seeds.selectExpr("node_id AS seed", "0L AS u"), both, both.groupBy("u").agg(F.count("*").alias("n")))
    per = [r.n for r in step.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 101 * 1_000 and len(per) > 50 and max(per) < 10_000


def test_a_walk_moves_frontier_and_edges_but_no_pairs(spark, monkeypatch):
    """A hub's pairs grow with its square: shuffled, they fill the disk."""
    monkeypatch.setattr(gr, "PAIRS", 1_000)
    seeds, edges = star(spark, 1_000)
    plan = gr.neighbors(seeds, edges, 2)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")] if "MapInArrow" in plan else plan
    assert "Exchange" not in above and not re.search(r"hashpartitioning\(seed#\d+L, \w+#\d+L, \d+\)", plan)
    frontier, both = seeds.selectExpr("node_id AS seed", "0L AS u"), edges.selectExpr("target_id AS u", "source_id AS v", "'x' AS via")
    dealt = gr._dealt(frontier, both, both.groupBy("u").agg(F.count("*").alias("n")), seeds.selectExpr("node_id AS seed", "node_id AS v"))
    assert dealt.count() < 101 * 1_000 / 10
    assert int(re.search(r"RepartitionByExpression \[seed#\d+L, u#\d+L, v#\d+L\], (\d+)", dealt._jdf.queryExecution().optimizedPlan().toString())[1]) > 5  # no task copies all


def test_walk_over_links_of_many_kinds_in_small_batches(spark, monkeypatch):
    """Names as ids, several edges of a pair in both directions, loops, seeds given twice or not in the graph, rows of a seed over several batches."""
    links = [(f"n{i * i % 31}", f"n{i * 7 % 23}", kind) for i in range(60) for kind in ("CITES", "REFERS_TO") if i % 3 or kind == "CITES"] + [("n3", "n3", "CITES")]
    seeds = [f"n{i}" for i in range(0, 31, 2)] + ["n2", "none", None]
    edges = spark.createDataFrame(sorted(set(links)), "source_id string, target_id string, edge_type string")
    both = [(u, v, f"{a}→{b}→{k}") for a, b, k in set(links) for u, v in ((a, b), (b, a))]
    want = []
    for seed in {s for s in seeds if s}:
        seen, front = {seed}, {seed}
        for level in (1, 2, 3):
            new = {}
            for u, v, via in both:
                if u in front and v not in seen:
                    new[v] = min(via, new.get(v, via))
            want += [(seed, v, level, via) for v, via in new.items()]
            seen, front = seen | set(new), set(new)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for pairs in (5, 1_000_000):
            monkeypatch.setattr(gr, "PAIRS", pairs)
            got = gr.neighbors(spark.createDataFrame([(s,) for s in seeds], "node_id string"), edges, 3)
            assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_meet_by_digest(spark, sf_dir):
    """Edges of which nobody reads the pattern move no text."""
    from docmill.queries.graph import edges

    def joins(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        yield from [[p.output().apply(i).name() for i in range(p.output().size())] for p in below] if plan.nodeName() == "Join" else []
        for p in below:
            yield from joins(p)

    sides = lambda df: list(joins(df._jdf.queryExecution().optimizedPlan()))
    moved = sides(edges(spark, sf_dir).select("source_id", "target_id", "edge_type"))
    assert moved and not any(name in ("line", "text") for side in moved for name in side)
    assert any("line" in side for side in sides(edges(spark, sf_dir)))

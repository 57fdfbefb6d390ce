"""The document graph: nodes, edges, statistics, walks, a projection for drawing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import node_id, stem, summary_text
from docmill.sources.stored import shipped, stored

shipped(__name__)

#: Pairs of a seed and an edge that a task of a walk makes, about; it holds so many at a time.
PAIRS = 1_000_000


def build_nodes(chunks: DataFrame, types: dict[str, str]) -> DataFrame:
    """One node per document: type by category, largest page, summary of the first chunk, its chunk ids in order."""
    kind = F.lit("UNKNOWN")
    for category, name in types.items():
        kind = F.when(F.col("category") == category, F.lit(name)).otherwise(kind)
    order = F.struct("page_number", "chunk_index")
    a = chunks.groupBy("document_id", "document_name", "category").agg(F.max("page_number").alias("page_count"), F.min_by("text", order).alias("_t"), F.sort_array(F.collect_list(F.struct("page_number", "chunk_index", "chunk_id"))).alias("_c"))
    return a.select("document_id", node_id(F.col("document_name")).alias("node_id"), kind.alias("node_type"), "document_name", "category", "page_count", summary_text(F.col("_t")).alias("summary"), F.col("_c.chunk_id").alias("chunk_ids"))


def build_edges(found: DataFrame, floor: float = 0.3) -> DataFrame:
    """(source_id, target_id, edge_type, confidence, pattern) to edges: best confidence and its pattern, count, and a
    weight that rises by 0.1 for each further occurrence, by 0.2 at most, to 1 at most."""
    a = found.where(F.col("confidence") >= floor).groupBy("source_id", "target_id", "edge_type")
    a = a.agg(F.max("confidence").alias("confidence"), F.max(F.struct("confidence", "pattern"))["pattern"].alias("pattern"), F.count("*").alias("occurrences"))
    boost = F.least(0.1 * (F.col("occurrences") - 1), F.lit(0.2))
    return a.withColumn("weight", F.round(F.least(F.col("confidence") + boost, F.lit(1.0)), 4))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, linked pairs, density of pairs (6 decimals), counts by type as maps."""
    count = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"{c}s"))
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.countDistinct("source_id", "target_id").alias("pairs"))
    one = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(count(nodes, "node_type"))).crossJoin(F.broadcast(count(edges, "edge_type")))
    return one.withColumn("density", F.when(F.col("nodes") < 2, 0.0).otherwise(F.round(F.col("pairs") / (F.col("nodes") * (F.col("nodes") - 1)), 6)))


def neighbors(seeds: DataFrame, edges: DataFrame, depth: int = 1, edge_types: list[str] | None = None) -> DataFrame:
    """seed, node, level, via (the smallest edge that first reached it): an undirected walk, ``depth`` 4 at most.

    Per level the frontier meets the edges in both directions, without the nodes that are reached already. Small tables can make many pairs where a node has
    many edges and many seeds reach it, so tasks are dealt by pairs, not by bytes, and pairs stay where they are made: only frontier and edges move."""
    if not 1 <= depth <= 4:
        raise ValueError("depth is 1 to 4")
    e = edges if edge_types is None else edges.where(F.col("edge_type").isin(*edge_types))
    label = F.concat_ws("→", F.col("source_id").cast("string"), F.col("target_id").cast("string"), "edge_type")
    e = stored(e.select("source_id", "target_id", label.alias("via")))
    both = e.toDF("u", "v", "via").unionByName(e.toDF("v", "u", "via"))
    degrees = stored(both.groupBy("u").agg(F.count("*").alias("n")))
    reached = seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("node"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("via"))
    frontier = reached
    for level in range(1, depth + 1):
        step = _stepped(frontier.select("seed", F.col("node").alias("u")), both, degrees, reached.select("seed", F.col("node").alias("v")))
        frontier = step.select("seed", F.col("v").alias("node"), F.lit(level).alias("level"), "via")
        frontier = stored(frontier) if level < depth else frontier
        reached = reached.unionByName(frontier)
    return reached.where("level > 0")


def _stepped(frontier: DataFrame, both: DataFrame, degrees: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """seed, v, via: the frontier (seed, u) joined with edges (u, v, via), the smallest via of each (seed, v), without those ``reached``; about ``PAIRS`` pairs a task."""
    dealt = _dealt(frontier, both, degrees, reached)
    kind = {f.name: f.dataType.simpleString() for f in dealt.schema}
    return dealt.sortWithinPartitions("seed").drop("cell").mapInArrow(_pairs(PAIRS), f"seed {kind['seed']}, v {kind['v']}, via string")


def _dealt(frontier: DataFrame, both: DataFrame, degrees: DataFrame, reached: DataFrame | None) -> DataFrame:
    """seed, u, v, via, cell: what a step's tasks read, each its cell of a grid of blocks of seeds by blocks of v, so all that decides a (seed, v) is in one.
    Edges (seed is null) go to every block of seeds, frontier (v is null) to every block of v, reached nodes (u is null) to their cell: the rows that move
    grow with the root of the pairs. More blocks of v than of seeds where edges are more than frontier."""
    at = stored(frontier.groupBy("u").agg(F.count("*").alias("f")).join(degrees, "u").select("u", "n", "f"))
    size = at.agg(F.sum(F.col("f") * F.col("n")).alias("pairs"), F.sum("f").alias("asked"), F.sum("n").alias("links")).first()
    tasks = max(1, min(20_000, -(-(size.pairs or 0) // PAIRS)))
    across = max(1, min(tasks, round(math.sqrt(2 * tasks * (size.links or 0) / (size.asked or 1)))))  # an edge has twice the bytes of a frontier's row
    down = -(-tasks // across)
    rows = both.join(at.select("u"), "u", "left_semi").unionByName(frontier.where("seed IS NOT NULL AND u IS NOT NULL"), allowMissingColumns=True)
    if reached is not None:
        rows = rows.unionByName(reached.where("seed IS NOT NULL AND v IS NOT NULL"), allowMissingColumns=True)
    copies = (size.asked or 0) * across + (size.links or 0) * down
    rows = rows.repartition(1 + copies // PAIRS, "seed", "u", "v")  # a stored frontier may be one file; its copies are made by many tasks
    row, column = (F.pmod(F.xxhash64(F.lit(salt), c), F.lit(n)).cast("int") for salt, c, n in (("seed", "seed", down), ("v", "v", across)))
    every = lambda n, cell: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)
    cells = F.when(F.col("seed").isNull(), every(down, lambda i: i * across + column)).when(F.col("u").isNull(), F.array(row * across + column)).otherwise(every(across, lambda i: row * across + i))
    return rows.select("seed", "u", "v", "via", F.explode(cells).alias("cell")).repartitionById(down * across, "cell")


def _pairs(most: int):
    """Arrow batches of one cell by seed, edges first, to (seed, v, via); ``most`` pairs at a time, or one seed's."""

    def run(batches):
        edges, asked = [], []
        links = None
        for batch in batches:
            first = batch["seed"].null_count  # edges stand before all seeds
            if first:
                edges.append(batch.slice(0, first))
            if first == batch.num_rows:
                continue
            if edges:
                links, edges = _Links(pa.Table.from_batches(edges)), []
            if links is None:
                return  # nothing to reach in this cell
            batch = batch.slice(first)
            whole = pc.index(batch["seed"], batch["seed"][-1]).as_py()  # its last seed may go on in the next batch
            if whole or (asked and asked[-1]["seed"][-1] != batch["seed"][0]):
                yield from links.smallest(pa.Table.from_batches([*asked, batch.slice(0, whole)]), most)
                asked = []
            asked.append(batch.slice(whole))
        if asked:
            yield from links.smallest(pa.Table.from_batches(asked), most)

    return run


class _Links:
    """The edges of a cell in order of via, so that the smallest via is the smallest place, with the places of each u."""

    def __init__(self, edges: pa.Table):
        edges = edges.take(pc.sort_indices(edges["via"])).combine_chunks()
        u, v = (edges[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("u", "v"))
        self.via, self.u, self.v = edges["via"].combine_chunks(), u.dictionary, v.dictionary
        self.v_of, at = v.indices.to_numpy(), u.indices.to_numpy()
        self.places, self.n = np.argsort(at, kind="stable"), np.bincount(at)
        self.starts = np.cumsum(self.n) - self.n

    def smallest(self, rows: pa.Table, most: int):
        """Frontier and reached rows of whole seeds, by seed, to batches of (seed, v, via)."""
        seeds = rows["seed"].combine_chunks().dictionary_encode()
        seed = seeds.indices.to_numpy().astype(np.int64)
        frontier = rows["u"].is_valid().to_numpy()
        u = pc.fill_null(pc.index_in(rows["u"], self.u), -1).to_numpy()
        v = pc.fill_null(pc.index_in(rows["v"], self.v), -1).to_numpy()
        known = ~frontier & (v >= 0)
        known, asked = (seed * len(self.v) + v)[known], frontier & (u >= 0)
        seed, u = seed[asked], u[asked]
        pairs = np.cumsum(np.bincount(seed, self.n[u], len(seeds.dictionary)).astype(np.int64))
        wide = max(1, 2**62 // (len(self.v) * len(self.via)))  # seeds of which all keys fit into 64 bits
        begin = 0
        while begin < len(pairs):
            done = pairs[begin - 1] if begin else 0
            end = min(begin + wide, max(begin + 1, int(np.searchsorted(pairs, done + most, side="right"))))
            lo, hi = np.searchsorted(seed, [begin, end])
            key = self._keys(seed[lo:hi] - begin, u[lo:hi])
            cell = key // len(self.via)
            cell, key = cell[keep := np.append(True, cell[1:] != cell[:-1])[: len(cell)]] + begin * len(self.v), key[keep]
            keep = np.isin(cell, known[np.searchsorted(known // len(self.v), begin) : np.searchsorted(known // len(self.v), end)], invert=True)
            cell, place = cell[keep], key[keep] % len(self.via)
            found = [seeds.dictionary.take(pa.array(cell // len(self.v))), self.v.take(pa.array(cell % len(self.v))), self.via.take(pa.array(place))]
            yield from pa.Table.from_arrays(found, ["seed", "v", "via"]).to_batches(max_chunksize=100_000)
            begin = end

    def _keys(self, seed: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Every pair as (seed, v, place) in one number, sorted."""
        n = self.n[u]
        place = self.places[np.repeat(self.starts[u] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.sort((np.repeat(seed, n) * len(self.v) + self.v_of[place]) * len(self.via) + place)


def related(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int, edge_types: list[str], node_types: list[str]) -> DataFrame:
    """Nodes of given types that a walk over given edge types reaches: referenced acts, judgments, publications."""
    keep = nodes.where(F.col("node_type").isin(*node_types)).select(F.col("node_id").alias("node"), "node_type")
    return neighbors(seeds, edges, depth, edge_types).join(keep, "node")


def expand_results(hits: DataFrame, chunk_nodes: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """Per query: documents that a walk from the hits' documents reaches and that are no hits themselves."""
    own = hits.join(chunk_nodes, "chunk_id").select("qid", "node_id").distinct()
    reached = neighbors(own.select("node_id").distinct(), edges, depth)
    out = own.withColumnRenamed("node_id", "seed").join(reached, "seed").groupBy("qid", "node").agg(F.min("level").alias("level"))
    return out.join(own.withColumnRenamed("node_id", "node"), ["qid", "node"], "left_anti")


def projection(nodes: DataFrame, edges: DataFrame, colours: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and links for drawing: label, colour and group by type, size 12 to 40 by pages, width by weight."""
    top = nodes.agg(F.greatest(F.max("page_count"), F.lit(1)).alias("top"))
    colour, group = F.lit("#999999"), F.lit(0)
    for i, (kind, c) in enumerate(colours.items(), 1):
        colour, group = F.when(F.col("node_type") == kind, F.lit(c)).otherwise(colour), F.when(F.col("node_type") == kind, i).otherwise(group)
    drawn = nodes.crossJoin(F.broadcast(top)).select("node_id", stem(F.col("document_name")).alias("label"), "node_type", colour.alias("colour"), group.alias("group"), (12 + F.col("page_count") / F.col("top") * 28).cast("int").alias("size"), F.substring("summary", 1, 150).alias("summary"))
    ends = nodes.select("node_id")
    links = edges.join(ends.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    return drawn, links.select("source_id", "target_id", "edge_type", F.round(1 + 4 * F.col("weight"), 2).alias("width"))

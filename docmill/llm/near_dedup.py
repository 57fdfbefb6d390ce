"""Near duplicates: an LSH forest over MinHash signatures, links confirmed on whole shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import cut, drop, minhash, running, shingles, shipped, spread, table, universal
from docmill.llm.components import components

shipped(__name__)

#: Orders of the forest and hash values of an order's least common prefix. Two sets of similarity 0.8 share the
#: prefix in an order with 0.8**5 = 0.33, so that 24 orders miss a pair with 7 in 100,000.
ORDERS, PREFIX = 24, 5
VALUES = ORDERS * PREFIX
#: Values that rows are sorted by in all regions, and in those that are still crowded after that.
DEPTH, DEEPER = 8, 32
#: Up to so many documents are found again by a broadcast bitmap of 16 bits each; more, by a join of ids.
FILTER_IDS = 1 << 23
#: Rows and shingles of a block of a crowd, at most (a larger set is a block of its own).
BLOCK_ROWS, BLOCK_SHINGLES = 2_048, 1 << 19


def _sets(batches, k: int, values: int):
    a, b = universal(values)
    for batch in batches:
        n, keys, signatures = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            own = shingles(text, k)
            n.append(len(own))
            keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            signatures.append(minhash(own, a, b).astype(">u4").tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["_id", "n", "set_key", "signature"])


def shingle_sets(docs: DataFrame, k: int, values: int = VALUES) -> DataFrame:
    """Per row of ``docs`` (_id, text; text not null): n (size of its set), set_key (hash of the set, null if empty), signature.

    Empty texts have an empty set and no signature; ids, also null or repeated ones, pass through; an empty table gives no rows.
    """
    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(lambda batches: _sets(batches, k, values), f"_id {kind}, n long, set_key binary, signature binary")


def _full_sets(batches, k: int):
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            keys, own = [], []
            for text in whole.column("text").slice(at, 500).cast(pa.binary()).to_pylist():
                s = shingles(text, k)
                if len(s):
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    own.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.int64()))], ["set_key", "shingles"])


def _neighbours(batches, width: int):
    """Along rows sorted by (ordering, head, label): pairs of rows at most ``width`` apart that share the head and are in different
    components (kind 0); the rows at both ends of the partition (kind 2), for the pairs across partitions."""
    names = ["kind", "a", "b", "ordering", "head", "label", "comp", "other"]

    def ends(ordering, head, node, comp, lab):
        n = len(node)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), pa.array(node), pa.array(node), pa.array(ordering), pa.array(head), pa.array(lab, pa.binary()), pa.array(comp), pa.array(comp)], names=names)

    tail, first = None, width
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("ordering", "head", "node", "comp", "label")]
        if first:
            yield ends(*(x[:first] for x in own))
            first = max(0, first - batch.num_rows)
        old = 0 if tail is None else len(tail[0])
        if old:
            own = [np.concatenate([x, y]) for x, y in zip(tail, own, strict=True)]
        ordering, head, node, comp, _ = own
        for w in range(1, width + 1):
            i = np.arange(max(0, old - w), len(node) - w)
            i = i[(head[i] == head[i + w]) & (ordering[i] == ordering[i + w]) & (comp[i] != comp[i + w])]
            if len(i):
                none = [pa.nulls(len(i), t) for t in (pa.int32(), pa.int64(), pa.binary())]
                low = [np.minimum(x[i], x[i + w]) for x in (node, comp)]
                high = [np.maximum(x[i], x[i + w]) for x in (node, comp)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(i), np.int32)), pa.array(low[0]), pa.array(high[0]), *none, pa.array(low[1]), pa.array(high[1])], names=names)
        tail = [x[-width:] for x in own]
    if tail is not None:
        yield ends(*tail)


_SCAN = "kind int, a long, b long, ordering int, head long, label binary, comp long, other long"


def _scan(rows: DataFrame, tasks: int, width: int) -> DataFrame:
    """Pairs (a, b: nodes; comp, other: theirs) of neighbours in sorted orders; one range-partitioned sort, even for
    equal labels as ``node`` is part of the key. Pairs across partitions come from a second sort of the partitions'
    ends alone, those across its own partitions from a sort of its ends, and so on until one partition is left."""
    order = ["ordering", "head", "label", "node"]
    run = lambda it, w=width: _neighbours(it, w)
    found = cut(rows.repartitionByRange(max(1, tasks), *order).sortWithinPartitions(*order).mapInArrow(run, _SCAN))
    out = found.where("kind = 0")
    while tasks > 1:
        ends, tasks = found.where("kind = 2").select("ordering", "head", "label", F.col("a").alias("node"), "comp").distinct(), max(1, tasks // 64)
        found = ends.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, _SCAN)
        found = cut(found) if tasks > 1 else found
        out = out.unionByName(found.where("kind = 0"))
    return out.select("a", "b", "comp", "other").distinct()


def _head(o: int) -> Column:
    """The least common prefix of an order, as one number."""
    return F.xxhash64(F.substring("signature", 4 * PREFIX * o + 1, 4 * PREFIX))


def _places(o: int, depth: int) -> list[int]:
    """Where in a signature the values of an order stand, from its prefix to ``depth``."""
    rest = [p for p in range(VALUES) if not o * PREFIX <= p < (o + 1) * PREFIX]
    return [4 * int(p) + 1 for p in np.random.default_rng([11, o]).permutation(rest)[: depth - PREFIX]]


def _label(o: int, depth: int) -> Column:
    return F.concat(*[F.substring("signature", p, 4) for p in _places(o, depth)])


def _deep_label(depth: int) -> Column:
    """The label of a row's own order, by a table of places."""
    places = ", ".join(f"array({', '.join(map(str, _places(o, depth)))})" for o in range(ORDERS))
    return F.expr(f"aggregate(element_at(array({places}), ordering + 1), X'', (s, p) -> concat(s, substring(signature, p, 4)))")


def _rows(classes: DataFrame, comps: DataFrame, orders: int, depth: int | None) -> DataFrame:
    """ordering, head, node, comp (and label down to ``depth``) of every class in the first ``orders`` orders."""
    each = [F.struct(F.lit(o).alias("ordering"), _head(o).alias("head"), *([] if depth is None else [_label(o, depth).alias("label")])) for o in range(orders)]
    joined = classes.select("node", "signature").join(comps, "node")
    return joined.select("node", "comp", F.explode(F.array(*each)).alias("l")).select("l.*", "node", "comp")


def _crowded(rows: DataFrame) -> DataFrame:
    """ordering, head, hub (smallest node) of the regions that hold several components."""
    per = rows.groupBy("ordering", "head").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.min("node").alias("hub"))
    return per.where("_low < _high").select("ordering", "head", "hub")


def _wanted(ids: DataFrame, count: int, docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (_id, text) whose id is in ``ids`` (first_id), perhaps few others, and null ids."""
    known = ids.where("first_id IS NOT NULL").select("first_id")
    if count > FILTER_IDS:
        return docs.join(known, F.col("_id") == F.col("first_id"), "left_semi").unionByName(docs.where("_id IS NULL"))
    bits = max(1 << 18, 1 << math.ceil(math.log2(16 * max(1, count))))  # at most 128 million: 16 MB
    at = known.select(F.pmod(F.xxhash64("first_id"), F.lit(bits)).alias("_at")).withColumn("_bucket", F.expr("_at div 32768"))
    maps = at.groupBy("_bucket").agg(F.expr("bitmap_construct_agg(_at % 32768)").alias("_bits"))
    own = docs.withColumn("_at", F.pmod(F.xxhash64("_id"), F.lit(bits))).withColumn("_bucket", F.expr("_at div 32768"))
    hit = F.expr("getbit(cast(conv(hex(substring(_bits, cast(_at % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)) = 1")
    return own.join(F.broadcast(maps), "_bucket", "left").where(F.coalesce(hit, F.lit(False)) | F.col("_id").isNull()).select("_id", "text")


def _whole_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, k: int) -> tuple[DataFrame, int]:
    """node, n, shingles of the classes of ``nodes`` (distinct), and how many they are: their texts are read again."""
    wanted = cut(nodes.join(classes.select("node", "set_key", "first_id", "n"), "node"))
    count = wanted.count()
    again = _wanted(wanted, count, docs.select(F.col(id_col).alias("_id"), F.coalesce("text", F.lit("")).alias("text")))
    full = again.select("text").mapInArrow(lambda batches: _full_sets(batches, k), "set_key binary, shingles array<long>")
    full = full.join(wanted.select("set_key", "node", "n"), "set_key").dropDuplicates(["node"])
    out = cut(full.select("node", "n", "shingles"), count, 10_000)
    drop(wanted)
    return out, count


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, k: int, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b: nodes), those with 100 * intersection >= percent * union on the whole sets."""
    full, _ = _whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs, id_col, k)
    left = full.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = full.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    near = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    both = pairs.join(left, "a").join(right, "b").where(near).withColumn("_common", F.size(F.array_intersect("s_a", "s_b")))
    return both.where(F.expr(f"100 * _common >= {percent} * (n_a + n_b - _common)")).select(*pairs.columns)


def common_counts(a: list[np.ndarray], b: list[np.ndarray], rows: int = 256, columns: int = 4096):
    """Sizes of the intersections of every set of ``a`` with every set of ``b`` (arrays without repeats), some rows of ``a`` at a
    time: (first row, matrix). Products of 0/1 matrices over the values that both sides have, some columns at a time."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    of_b = np.repeat(np.arange(len(b)), [len(s) for s in b])
    col_b = np.searchsorted(both, flat_b)
    known = (col_b < len(both)) & (both[np.minimum(col_b, len(both) - 1)] == flat_b) if len(both) else np.zeros(len(flat_b), bool)
    of_b, col_b = of_b[known], col_b[known]
    order = np.argsort(col_b, kind="stable")
    of_b, col_b = of_b[order], col_b[order]
    for at in range(0, len(a), rows):
        own = a[at : at + rows]
        flat = np.concatenate(own)
        of_a, col_a = np.repeat(np.arange(len(own)), [len(s) for s in own]), np.searchsorted(both, flat)
        if len(both):
            ok = both[np.minimum(col_a, len(both) - 1)] == flat
            of_a, col_a = of_a[ok], col_a[ok]
        else:
            of_a, col_a = of_a[:0], col_a[:0]
        out = np.zeros((len(own), len(b)), np.float32)
        used = np.unique(col_a)  # columns that these rows have
        for c in range(0, len(used), columns):
            part = used[c : c + columns]
            x, y = np.zeros((len(own), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
            i = np.flatnonzero((col_a >= part[0]) & (col_a <= part[-1]))
            x[of_a[i], np.searchsorted(part, col_a[i])] = 1
            lo, hi = np.searchsorted(col_b, part[0]), np.searchsorted(col_b, part[-1], "right")
            place = np.searchsorted(part, col_b[lo:hi])
            ok = part[np.minimum(place, len(part) - 1)] == col_b[lo:hi]
            y[of_b[lo:hi][ok], place[ok]] = 1
            out += x @ y.T
        yield at, out.astype(np.int64)


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label that each label reaches over links (a, b: places in ``labels``)."""
    low = labels.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = np.minimum(new, new[np.searchsorted(labels, new)])
        if (new == low).all():
            return low
        low = new


def _tested(left: list, right: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Components that two blocks (lists of comp, n, shingles) link, as (component, smallest one it reaches): every pair of different components is
    tested on the whole sets. Rows of the component with the most rows need not meet each other."""
    right = right or left
    labels, count = np.unique([r[0] for r in (left + right)], return_counts=True)
    most = labels[np.argmax(count)]
    split = lambda rows: ([r for r in rows if r[0] != most], [r for r in rows if r[0] == most])
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for rows, others in ((split(left)[0], right), (split(left)[1], split(right)[0])):
        if not rows or not others:
            continue
        comp, n = (np.array([r[i] for r in others], np.int64) for i in (0, 1))
        for at, c in common_counts([r[2] for r in rows], [r[2] for r in others]):
            own = rows[at : at + len(c)]
            comp_a, n_a = (np.array([r[i] for r in own], np.int64)[:, None] for i in (0, 1))
            i, j = np.nonzero((100 * c >= percent * (n_a + n[None, :] - c)) & (comp_a != comp[None, :]))
            if len(i):
                both = np.unique(np.stack([np.searchsorted(labels, comp_a[i, 0]), np.searchsorted(labels, comp[j])]), axis=1)
                links.append((both[0], both[1]))
    low = joined(labels, np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
    return labels[low != labels], low[low != labels]


def _block_links(batches, percent: int, tested=_tested):
    """Along rows sorted by (x, y: blocks, side): what ``tested`` says of two blocks (the second is empty where a block meets itself);
    two are held at a time."""
    held, sides = None, ([], [])

    def out():
        a, b = tested(*sides, percent)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        x, y, side, comp, n = (batch.column(c).to_pylist() for c in ("x", "y", "side", "comp", "n"))
        sets = batch.column("shingles")
        values, offsets = sets.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(n)]
        for r in range(batch.num_rows):
            if held is not None and held != (x[r], y[r]):
                yield out()
                sides = ([], [])
            held = (x[r], y[r])
            sides[side[r]].append((comp[r], n[r], values[offsets[r] : offsets[r + 1]].copy()))
    if held is not None:
        yield out()


def _crowd_links(crowds: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, k: int, percent: int, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, tested=_tested) -> DataFrame:
    """Links (a, b: components) between the nodes of each crowd (node, crowd), all of them, by whole sets; or what another
    ``tested`` makes of two blocks.

    Along (crowd, n) nodes fall into blocks of bounded rows and shingles; every two blocks of a crowd whose sizes allow the
    similarity, and that hold several components, meet in a task, which emits what they link and no pairs."""
    full, count = _whole_sets(crowds.select("node"), classes, docs, id_col, k)
    own = cut(full.select("node", "n").join(crowds, "node").join(comps, "node"), count)
    weighed = own.withColumn("_w", F.greatest(F.col("n"), F.lit(math.ceil(block_shingles / block_rows))))
    placed = running(spread(weighed, count, [F.col("crowd"), F.col("n"), F.col("node")]), "_w", "_at")
    placed = cut(placed.select("node", "crowd", "comp", "n", F.floor((F.col("_at") - F.col("_w")) / block_shingles).alias("block")), count)
    blocks = placed.groupBy("crowd", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    one = blocks.select("crowd", *[F.col(c).alias(f"{c}_x") for c in ("block", "hi", "c0", "c1")])
    two = blocks.select("crowd", *[F.col(c).alias(f"{c}_y") for c in ("block", "lo", "c0", "c1")])
    meet = one.join(two, "crowd").where(F.expr(f"block_x <= block_y AND 100 * hi_x >= {percent} * lo_y AND least(c0_x, c0_y) < greatest(c1_x, c1_y)"))
    meet = cut(meet.select("crowd", "block_x", "block_y"))
    left = placed.join(meet.withColumn("block", F.col("block_x")), ["crowd", "block"]).withColumn("side", F.lit(0))
    right = placed.join(meet.where("block_x < block_y").withColumn("block", F.col("block_y")), ["crowd", "block"]).withColumn("side", F.lit(1))
    dealt = left.unionByName(right).select("node", "comp", "n", "side", F.struct("crowd", "block_x").alias("p"), F.struct("crowd", "block_y").alias("q"))
    dealt = dealt.select("node", "comp", "n", "side", F.xxhash64("p").alias("x"), F.xxhash64("q").alias("y")).join(full.select("node", "shingles"), "node")
    run = lambda batches: _block_links(batches, percent, tested)
    return dealt.repartition("x", "y").sortWithinPartitions("x", "y", "side").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", width: int = 2, rows_per_task: int = 100_000, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept.

    A document's set holds its distinct ``k``-word shingles (words of [^\\x20\\x09-\\x0D]+ after lower-casing A-Z);
    fewer words are one shingle; no words: an empty set, linked with nothing, so it is its own component.
    Documents are linked when 100 * intersection >= ``percent`` * union.

    Equal sets are one class, so copies cost nothing further. Classes enter the forest: ``ORDERS`` orders by their
    MinHash values. Neighbours by longest common prefix, of at least ``PREFIX`` values, are candidates, confirmed on
    the whole sets; linked classes become components, and only neighbours of different components are candidates.
    The depth adapts to the region (the classes of an order that share the least prefix): all are sorted down to
    ``DEPTH`` values, in three orders and then in all; those that still hold several components are sorted
    again down to ``DEEPER`` values, with ``width`` neighbours. What these leave unlinked is settled exactly: crowded
    regions that share classes are one crowd, and its classes of different components meet in blocks of bounded
    size, on whole sets, in tasks that emit only which components are linked. So every pair that shares a least
    prefix in any order is linked or tested; the cost of that last step grows with the square of the unlinked part of a crowd, its
    output does not. Sorts are by (label, node), so that a region of any size spreads over tasks.

    Nulls: null text is empty; null ids are never the smallest, a component of only those has a null id (kept:
    false). Rows that repeat an id share its component. Extra columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = cut(shingle_sets(own, k))
    grouped = sets.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("_id").alias("first_id"), F.min(F.struct("n", "signature")).alias("s"))
    classes = cut(grouped.select("set_key", "first_id", "s.n", "s.signature", F.monotonically_increasing_id().alias("node")), sets.count(), 10_000)
    count = classes.count()
    comps = classes.select("node", F.col("node").alias("comp"))

    def contracted(links: DataFrame) -> DataFrame:
        """``comps`` with the linked components (a, b) as one."""
        merged = components(links)
        new = cut(comps.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("component", "comp").alias("comp")), count)
        drop(merged)
        return new

    def candidates_linked(rows: DataFrame, n: int, reach: int) -> DataFrame:
        pairs = cut(_scan(rows, math.ceil(n / rows_per_task), reach))
        if pairs.isEmpty():
            return comps
        linked = _confirmed(pairs, classes, docs, id_col, k, percent).select(F.col("comp").alias("a"), F.col("other").alias("b"))
        return contracted(linked)

    for orders in (3, ORDERS):
        comps = candidates_linked(_rows(classes, comps, orders, DEPTH), count * orders, 1)
    rows = _rows(classes, comps, ORDERS, None)
    members = cut(rows.join(_crowded(rows), ["ordering", "head"]).select("ordering", "head", "hub", "node"))
    n = members.count()
    if n:
        deep = members.join(classes.select("node", "signature"), "node").join(comps, "node")
        comps = candidates_linked(deep.select("ordering", "head", _deep_label(DEEPER).alias("label"), "node", "comp"), n, width)
        still = _crowded(members.join(comps, "node")).select("ordering", "head")
        left = members.join(still, ["ordering", "head"]).select("node", "hub").distinct()
        crowds = components(left.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "crowd")
        comps = contracted(_crowd_links(crowds, comps, classes, docs, id_col, k, percent, block_rows, block_shingles))
    known = classes.select("set_key", "first_id", "node").join(comps, "node")
    least = known.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    known = cut(known.join(least, "comp").select("set_key", "component_id"), count)
    joined_back = sets.select("_id", "n", "set_key").join(known, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return joined_back.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of :func:`near_groups`, the one with the smallest id.
    Rows with a null id, or that repeat an id, stay as they are where that id stays; null ids always stay.
    Further columns pass through whatever their names; an empty table gives no rows."""
    gone = near_groups(docs, k, percent, id_col).where(f"NOT kept AND {id_col} IS NOT NULL").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`near_groups` with two-word shingles over all ``documents``: nulls, ties and empty tables as there."""
    return near_groups(table(spark, sf_dir, "documents"), k=2)


#: Brute force over all pairs that share a shingle: for small tables only.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
         ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

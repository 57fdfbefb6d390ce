"""Trie of what conversations begin with: nodes by union-find over the common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import WORD, cut, drop, shipped, table, tasks_for

shipped(__name__)

#: Turns of a conversation that are one row at most; deeper ones are tries of their own, below the node that ends the block.
BLOCK = 4096
#: Characters of a turn's digest.
_D = 32
_NOTHING = hashlib.sha256(b"").hexdigest()


def _packs(block: int):
    """Turns of sorted conversations as one row for each stretch of a batch, of ``block`` turns at most."""

    def run(batches):
        last, at = object(), 0
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            part, digests, words = batch.column("part"), batch.column("digest").to_pylist(), batch.column("words").to_numpy()
            edges = np.r_[0, np.flatnonzero(conv[1:] != conv[:-1]) + 1, len(conv)]
            rows = []
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if z > a:
                    last, at = (last, at) if conv[a] == last else (conv[a], 0)
                    for x in range(a, z, block):
                        y = min(x + block, z)
                        rows.append((conv[a], at, y - x, "".join(digests[x:y]), words[x:y]))
                        at += y - x
            if rows:
                c, s, n, d, w = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([part[0].as_py()] * len(rows), pa.int32()), pa.array(c, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.string()), pa.array(w, pa.list_(pa.int32()))], ["part", "conv", "at", "n", "d", "w"])

    return run


def sequences(turns: DataFrame, block: int = BLOCK, rows_per_task: int = 50_000) -> DataFrame:
    """conv, start, d, w: pieces of conversations in order (turn, null first; ties by role and text's digest): the first turn's number,
    the turns' digests one after the other, their words. Rows without conv_id belong to none.

    Turns are sorted over all conversations, so that a conversation of any length spreads over tasks and rows; where one
    continues in further tasks, it is so many turns on (a row a task at most, broadcast)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("digest")]
    ordered = rows.repartitionByRange(tasks_for(turns.count(), rows_per_task), *order).sortWithinPartitions(*order)
    packs = cut(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_packs(block), "part int, conv long, at long, n long, d string, w array<int>"))
    w = Window.partitionBy("conv").orderBy("part")
    before = packs.groupBy("conv", "part").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(w) - F.col("n")).where("before > 0").select("conv", "part", "before")
    joined = packs.join(F.broadcast(cut(before)), ["conv", "part"], "left")
    return joined.select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("start"), "d", "w")


def with_shared_heads(pieces: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """Pieces of the rebuilt conversations: the first h turns of the one that leads each ``group`` of ids (fewer if it has fewer), then the own
    turns after the first h, where h is a hash of the id, ``most`` at most. A conversation without turns is one empty piece."""
    c, s = F.col("conv"), F.col("start")
    h, base = F.crc32(c.cast("string")) % (most + 1), c - c % group
    left = (F.lit(most) - s).cast("int")
    first = pieces.where((c % group == 0) & (s < most)).select(c.alias("base"), F.struct(s.alias("s"), F.col("d").substr(F.lit(1), _D * left).alias("d"), F.slice("w", F.lit(1), left).alias("w")).alias("p"))
    heads = first.groupBy("base").agg(F.sort_array(F.collect_list("p")).alias("l")).select("base", F.array_join("l.d", "").alias("hd"), F.flatten("l.w").alias("hw"))
    j = pieces.withColumns({"base": base, "h": h.cast("int")}).join(heads, "base", "left").withColumns({"hd": F.coalesce("hd", F.lit("")), "hw": F.coalesce("hw", F.array().cast("array<int>"))})
    h, skip = F.col("h"), F.greatest(F.col("h") - s, F.lit(0)).cast("int")
    own_d, own_w = F.col("d").substr(_D * skip + 1, F.length("d")), F.slice("w", skip + 1, F.size("w"))
    lead_d, lead_w = F.when(s == 0, F.col("hd").substr(F.lit(1), _D * h)).otherwise(""), F.when(s == 0, F.slice("hw", F.lit(1), h)).otherwise(F.array().cast("array<int>"))
    at = F.when(s == 0, F.lit(0)).otherwise(F.least(h, F.size("hw")) + F.greatest(s, h) - h)
    return j.select("conv", at.cast("long").alias("start"), F.concat(lead_d, own_d).alias("d"), F.concat(lead_w, own_w).alias("w"))


def _blocks(pieces: DataFrame, block: int) -> DataFrame:
    """conv, block, d, w: the conversations cut at multiples of ``block`` turns; one row (block 0) for those without turns."""
    n, s = F.size("w"), F.col("start")
    numbers = F.sequence(F.floor(s / block), F.greatest(F.floor((s + n - 1) / block), F.floor(s / block)))
    b = pieces.withColumn("block", F.explode(numbers))
    a, z = F.greatest(s, F.col("block") * block), F.least(s + n, (F.col("block") + 1) * block)
    skip, take = (a - s).cast("int"), F.greatest(z - a, F.lit(0)).cast("int")
    part = F.struct(a.alias("a"), F.col("d").substr(_D * skip + 1, _D * take).alias("d"), F.slice("w", skip + 1, take).alias("w"))
    some = b.select("conv", "block", part.alias("p")).where((F.size("p.w") > 0) | (F.col("block") == 0))
    joined = some.groupBy("conv", "block").agg(F.sort_array(F.collect_list("p")).alias("l"))
    return joined.select("conv", "block", F.array_join("l.d", "").alias("d"), F.flatten("l.w").alias("w"))


def _common(a: str, b: str) -> int:
    """Turns that two lists of digests begin with in common."""
    low, high = 0, min(len(a), len(b)) // _D
    if a[:_D] != b[:_D] or not high:
        return 0
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: _D * mid] == b[: _D * mid] else (low, mid - 1)
    return low


def _keys(top: str, d: str) -> list[str]:
    """Names of the nodes on a row's path, from the trie's root on."""
    h, out = hashlib.md5(), [top]
    for i in range(0, len(d), _D):
        h.update(d[i : i + _D].encode())
        out.append(hashlib.md5(f"{top}{h.hexdigest()}".encode()).hexdigest())
    return out


class _Part:
    """A component: neighbours that begin alike for ``depth`` turns; its children's sums (without those on the task's edges)."""

    __slots__ = ("lo", "hi", "depth", "conv", "kids", "leaves", "below", "ends", "tops")

    def __init__(self, lo: int, depth: int, conv: int, kids: int, leaves: int, below: int, ends: list[int]):
        self.lo = self.hi = lo
        self.depth, self.conv, self.kids, self.leaves, self.below, self.ends, self.tops = depth, conv, kids, leaves, below, ends, []

    def join(self, other: _Part) -> None:
        self.lo, self.hi, self.conv = min(self.lo, other.lo), max(self.hi, other.hi), min(self.conv, other.conv)


_FIELDS = [("kind", pa.int32()), ("path", pa.int64()), ("key", pa.string()), ("parent", pa.string()), ("conv", pa.int64()), ("depth", pa.int64()), ("parent_conv", pa.int64()), ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("ends", pa.string())]
_KINDS = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
_SCHEMA = ", ".join(f"{n} {_KINDS[k]}" for n, k in _FIELDS)
#: A node that is whole; one whose parent is not in this task; a node on the task's edge, of which other tasks may have members.
WHOLE, TOP, EDGE = range(3)


def _forest(first_depth: int, block: int):
    """The nodes of a task's stretch of the sorted rows.

    Edges between neighbours are taken by falling common depth; an edge unites the components at its ends, which makes or widens
    the node of that depth. A component without the task's first and last row is whole. What is left are the nodes on these two rows' paths,
    so all that others must know of a task is as small as two rows."""

    def run(batches):
        columns = {k: [] for k in ("part", "top", "d", "conv", "w", "over", "kids", "leaves", "saved")}
        for batch in batches:
            for k, v in columns.items():
                v += batch.column(k).to_pylist()
        m = len(columns["conv"])
        if not m:
            return
        top, d, conv, over = (columns[k] for k in ("top", "d", "conv", "over"))
        sizes = np.array([len(x) for x in columns["w"]], np.int64)
        off = np.r_[0, np.cumsum(sizes)]
        total = np.r_[0, np.cumsum(np.concatenate([np.asarray(x, np.int64) for x in columns["w"]]))]
        lcp = np.array([-1, *[_common(d[i - 1], d[i]) if top[i - 1] == top[i] else -1 for i in range(1, m)]], np.int64)
        parts = [_Part(i, int(sizes[i]), conv[i], columns["kids"][i], columns["leaves"][i], columns["saved"][i], [conv[i]] if over[i] else []) for i in range(m)]
        root = list(range(m))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        chains, edge = [], ({}, {})  # whole components: rows of their chains; those on the edges by depth

        def edged(p: _Part) -> bool:
            return p.lo == 0 or p.hi == m - 1

        def close(p: _Part, above: int, parent: _Part | None) -> None:
            """No more members: its chain of nodes down from the depth ``above``."""
            leaves = p.leaves if p.kids else 1
            if edged(p):
                edge[0 if p.lo == 0 else 1][p.depth] = p
                for t in p.tops:
                    chains[t][2] = (TOP, p)
            else:
                for t in p.tops:
                    chains[t][2] = (WHOLE, p.conv)
                chains.append([p, above, (WHOLE, None), leaves])
                if parent is not None:
                    parent.tops.append(len(chains) - 1)
                    parent.kids += 1
                    parent.leaves += leaves
                    parent.below += p.below + (p.hi - p.lo) * int(total[off[p.lo] + p.depth] - total[off[p.lo] + above])

        for i in np.argsort(-lcp, kind="stable").tolist():
            depth = int(lcp[i])
            if depth < 0:
                break
            a, b = find(i - 1), find(i)
            x, y = parts[a], parts[b]
            if x.depth == y.depth == depth:
                if len(x.tops) < len(y.tops):
                    x.tops, y.tops = y.tops, x.tops
                x.tops += y.tops
                x.kids, x.leaves, x.below = x.kids + y.kids, x.leaves + y.leaves, x.below + y.below
                x.ends += y.ends
                x.join(y)
            elif x.depth == depth:
                close(y, depth, x)
                x.join(y)
            elif y.depth == depth:
                close(x, depth, y)
                y.join(x)
                x = y
            else:
                z = _Part(x.lo, depth, x.conv, 0, 0, 0, [])
                close(x, depth, z)
                close(y, depth, z)
                z.join(x)
                z.join(y)
                x = z
            root[b] = a
            parts[a] = x
        for i in range(m):
            if root[i] == i:
                close(parts[i], -1, None)

        if chains:
            yield _chain_rows(chains, off, total, top, d, first_depth, block)
        yield _edge_rows(edge, columns, lcp, off, total, first_depth)

    return run


def _chain_rows(chains, off, total, top, d, first_depth: int, block: int) -> pa.RecordBatch:
    lo, hi, depth, above, conv, kids, leaves, below = (np.array(x, np.int64) for x in zip(*[(p.lo, p.hi, p.depth, a, p.conv, p.kids, n, p.below) for p, a, _, n in chains], strict=True))
    n = depth - above
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + above[row] + 1  # depth within the block
    upper, lower = at == above[row] + 1, at == depth[row]
    words = total[off[lo[row]] + depth[row]] - total[off[lo[row]] + np.maximum(at - 1, 0)]
    kind, parent, parent_conv = np.zeros(len(row), np.int32), [None] * len(row), conv[row].tolist()
    key, ends = [None] * len(row), [_NOTHING] * len(row)
    for i in np.flatnonzero(upper).tolist():
        p, above_, (k, whose), _ = chains[row[i]]
        if k == TOP:  # below a node on the task's edge
            kind[i], parent[i], parent_conv[i] = TOP, _keys(top[p.lo], d[p.lo][: _D * above_])[-1], None
        elif above_ < 0:  # the trie's root itself
            key[i], parent_conv[i] = top[p.lo], None
        else:
            parent_conv[i] = whose
    if first_depth:  # the node above is in the block before
        for i in np.flatnonzero(at == 1).tolist():
            kind[i], parent[i], parent_conv[i] = TOP, top[chains[row[i]][0].lo], None
    for i in np.flatnonzero(at == block).tolist():
        p = chains[row[i]][0]
        key[i] = _keys(top[p.lo], d[p.lo])[-1]
    for i in np.flatnonzero(lower).tolist():
        if own := chains[row[i]][0].ends:
            ends[i] = hashlib.sha256(",".join(map(str, sorted(own))).encode()).hexdigest()
    values = (kind, np.zeros(len(row), np.int64), key, parent, conv[row], at + first_depth, parent_conv, (hi - lo + 1)[row], np.where(lower, kids[row], 1), leaves[row], below[row] + (hi - lo)[row] * words, None, ends)
    return pa.RecordBatch.from_arrays([pa.nulls(len(row), k) if v is None else pa.array(v, k) for v, (_, k) in zip(values, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _edge_rows(edge, columns, lcp, off, total, first_depth: int) -> pa.RecordBatch:
    """A row for each node on the paths of the task's first and last row, with what this task knows of it."""
    m, conv = len(lcp), np.array(columns["conv"], np.int64)
    all_alike = int(lcp[1:].min()) if m > 1 else int(off[1])
    rows = []
    for side, i in ((0, 0), (1, m - 1)):
        names = _keys(columns["top"][i], columns["d"][i])
        # members of the node of each depth: rows from this side on, as far as the least common depth allows
        alike = np.minimum.accumulate(lcp[1:] if side == 0 else lcp[:0:-1])
        low = np.minimum.accumulate(conv if side == 0 else conv[::-1])
        for at, key in enumerate(names):
            own = side == 0 or at > all_alike
            n = 1 + int(np.searchsorted(-alike, -at, "right")) if own else 0
            p = edge[side].get(at) if own else None
            kids, leaves, below, ends = (p.kids, p.leaves, p.below, ",".join(map(str, sorted(p.ends)))) if p else (0, 0, 0, "")
            words = int(total[off[i] + at] - total[off[i] + at - 1]) if at else 0
            rows.append((EDGE, 2 * columns["part"][0] + side, key, names[at - 1] if at else None, int(low[n - 1]) if own else None, first_depth + at, None, n, kids, leaves, below, words, ends))
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _hashed(batches):
    """key, ends_sha256 of sorted pieces of lists: the hash runs along the pieces, so that no list is ever whole."""
    key, h = None, None
    for batch in batches:
        done = []
        for k, t in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(t.encode())
            else:
                h.update(f",{t}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in done], pa.string()) for c in range(2)], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "ends_sha256"])


def _merge(edges: DataFrame) -> DataFrame:
    """key, parent, conv, depth, n, kids, leaves, saved, ends_sha256 of the nodes on the tasks' edges, over all tasks.

    Members and whole children add up. A node belongs to the first path that has it, and what a path owns is the end of it; so sums over a node's subtree are sums
    over its paths of what they own from there on, and every node counts once."""
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    nodes = cut(edges.groupBy("key").agg(*sums, F.min("conv").alias("conv"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.min("path").alias("owner")))
    kids = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more")).where("key IS NOT NULL")
    own = cut(nodes.join(kids, "key", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).drop("more"))
    drop(nodes)
    gain, leaf = (F.col("n") - 1) * F.col("words") + F.col("saved"), F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves"))
    value = own.select("key", "owner", gain.alias("gain"), leaf.alias("leaf"))
    mine = F.col("owner") == F.col("path")
    w = Window.partitionBy("path").orderBy(F.desc("depth"))
    along = edges.select("path", "depth", "key").join(value, "key").select("path", "depth", "key", F.when(mine, F.col("gain")).otherwise(0).alias("gain"), F.when(mine, F.col("leaf")).otherwise(0).alias("leaf"))
    along = along.withColumns({"gain": F.sum("gain").over(w), "leaf": F.sum("leaf").over(w)})
    subtrees = along.groupBy("key").agg(F.sum("gain").alias("saved"), F.sum("leaf").alias("leaves"))
    ended = edges.where("ends <> ''").select("key", "path", "ends").repartition("key").sortWithinPartitions("key", "path").select("key", "ends").mapInArrow(_hashed, "key string, ends_sha256 string")
    out = own.drop("saved", "leaves").join(subtrees, "key").join(ended, "key", "left")
    return cut(out.select("key", "parent", "conv", "depth", "n", "kids", "leaves", "saved", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256")))


def trie(pieces: DataFrame, block: int = BLOCK, rows_per_task: int = 20_000) -> DataFrame:
    """Every distinct beginning of the conversations (pieces as of :func:`sequences`), the empty one too: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, one row each.

    Conversations are sorted by their turns over range partitions (copies by id, so that a group of any size spreads). Each task makes
    the nodes of its stretch by union-find (:func:`_forest`); nodes on the edges between tasks are merged by name, a table of two paths a task.
    Blocks of turns beyond the first have tries of their own, from the deepest up, whose sums go into the node above: so many rounds as the longest
    conversation has blocks of 4,096 turns. No conversation gives no rows."""
    items = cut(_blocks(pieces, block))
    most, rows = items.agg(F.max("block"), F.count("*")).first()
    if not rows:
        return items.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    if most:
        full = items.select("conv", "block", F.md5("d").alias("x"))
        listed = full.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "x"))).alias("l"))
        name = lambda b: F.aggregate(F.filter("l", lambda v: v["block"] < b), F.lit(""), lambda a, v: F.md5(F.concat(a, v["x"])))
        named = listed.where(F.size("l") > 1).select("conv", F.explode(F.transform("l", lambda v: F.struct(v["block"].alias("block"), name(v["block"]).alias("top"), (v["block"] == F.size("l") - 1).alias("over")))).alias("v"))
        chain = cut(named.select("conv", "v.block", "v.top", "v.over"))
        items = items.join(chain, ["conv", "block"], "left")
    else:
        items = items.withColumns({"top": F.lit(None).cast("string"), "over": F.lit(None).cast("boolean")})
    items = items.withColumns({"top": F.coalesce("top", F.lit("")), "over": F.coalesce("over", F.lit(True))})
    whole, named, below = None, None, None
    zero = F.lit(0).cast("long")
    add = lambda a, b: b if a is None else a.unionByName(b)
    for b in range(most, -1, -1):
        own = items.where(F.col("block") == b)
        if below is None:
            own = own.withColumns({"kids": zero, "leaves": zero, "saved": zero})
        else:
            own = own.join(below, "conv", "left").withColumns({k: F.coalesce(k, zero) for k in ("kids", "leaves", "saved")})
        tasks = tasks_for(rows, rows_per_task)
        order = ["top", "d", "conv"]
        ordered = own.select("top", "d", "conv", "w", "over", "kids", "leaves", "saved").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        made = cut(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_forest(b * block, block), _SCHEMA))
        edges = _merge(made.where(F.col("kind") == EDGE))
        inner = made.where(F.col("kind") != EDGE)
        if b:
            roots = edges.where(F.col("depth") == b * block).select("conv", "kids", "leaves", "saved")
            below = cut(roots.unionByName(inner.where(F.col("depth") == b * block).select("conv", "kids", "leaves", "saved")))
            edges, inner = edges.where(F.col("depth") > b * block), inner.where(F.col("depth") > b * block)
        whole = add(whole, inner.select("conv", "depth", "kind", "parent", "parent_conv", "n", "kids", "leaves", "saved", F.col("ends").alias("ends_sha256")))
        whole = whole.unionByName(edges.select("conv", "depth", F.when(F.col("parent").isNull(), WHOLE).otherwise(TOP).alias("kind"), "parent", F.lit(None).cast("long").alias("parent_conv"), "n", "kids", "leaves", "saved", "ends_sha256"))
        named = add(named, edges.select(F.col("key").alias("parent"), F.col("conv").alias("found")))
        named = named.unionByName(inner.where("key IS NOT NULL").select(F.col("key").alias("parent"), F.col("conv").alias("found")))
    result = [F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"]
    known = whole.where(F.col("kind") == WHOLE).withColumn("parent_conv_id", F.col("parent_conv")).select(*result)
    return known.unionByName(whole.where(F.col("kind") == TOP).join(named, "parent").withColumn("parent_conv_id", F.col("found")).select(*result))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """:func:`trie` of conversations (conv_id, turn, role, text) as they are. Turns are in order, null first, ties by what they say; null role and text are
    empty; repeated rows are turns of their own; rows without conv_id are left out; other columns are ignored; an empty table gives no rows."""
    return trie(sequences(turns))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """:func:`trie` of all ``conversations``, rebuilt with shared heads (:func:`with_shared_heads`); nulls, repeated rows and empty tables as in :func:`prefix_trie`."""
    return trie(cut(with_shared_heads(sequences(table(spark, sf_dir, "conversations")))))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of an ASCII text: bit by bit."""
    step = "xor(z >> 1, CASE WHEN (z & 1) = 1 THEN 3988292384 ELSE 0 END)"
    bits = f"list_reduce(range(8), lambda z, i: {step}, xor(a, ascii(substring({text}, k::INT, 1)))::BIGINT)"
    return f"xor(list_reduce(range(1, length({text}) + 1), lambda a, k: {bits}, 4294967295::BIGINT), 4294967295)"


#: By names of all beginnings (hashes along the turns) and sums over each conversation's turns, from the end.
OP12_SQL = rf"""
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT c, {crc32_sql("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM o)),
p AS (
  SELECT ids.c, 0 AS own, o.i, o.g, o.w FROM ids JOIN o ON o.c = ids.c - ids.c % 20 AND o.i < ids.h
  UNION ALL SELECT ids.c, 1, o.i, o.g, o.w FROM ids JOIN o ON o.c = ids.c AND o.i >= ids.h
), t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, g, w FROM p),
k AS (
  SELECT c, d, w, md5(string_agg(g, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM t
  UNION ALL SELECT c, 0, 0, '' FROM ids
), q AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, min(c) OVER (PARTITION BY key) AS owner, max(d) OVER (PARTITION BY c) AS last FROM k),
kids AS (SELECT up AS key, count(DISTINCT key) AS kids FROM q WHERE up IS NOT NULL GROUP BY up),
s AS (
  SELECT q.*, coalesce(kids, 0) AS kids, sum(w) OVER z AS all_words, sum(CASE WHEN owner = c THEN w ELSE 0 END) OVER z AS own_words,
         sum(CASE WHEN owner = c AND kids IS NULL THEN 1 ELSE 0 END) OVER z AS own_leaves
  FROM q LEFT JOIN kids USING (key) WINDOW z AS (PARTITION BY c ORDER BY d DESC)
), n AS (
  SELECT key, min(c) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(kids) AS n_children, sum(own_leaves) AS n_leaves, sum(all_words) - sum(own_words) AS saved_tokens,
         sha256(coalesce(string_agg(CASE WHEN d = last THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM s GROUP BY key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, n.n_leaves::BIGINT AS n_leaves, n.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n u ON n.up = u.key
"""

"""Document fingerprints: MinHash signatures, the effect of an edit on them, and near documents by signature bands."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import cut, minhash, shingles, shipped, table, tasks_for, universal
from docmill.llm.components import components
from docmill.llm.near_dedup import _crowd_links, common_counts

shipped(__name__)

#: Permutations of a fingerprint; 16 bits of each smallest value are kept.
PERMUTATIONS = 128


class Fingerprinter:
    """Fingerprints of texts: the lower 16 bits of each permutation's smallest value (the upper ones are near 0 in
    all long texts), as bytes; none for an empty set."""

    def __init__(self, k: int = 5, permutations: int = PERMUTATIONS):
        self.k = k
        self.a, self.b = universal(permutations, seed=23)

    def values(self, text: str) -> np.ndarray | None:
        own = shingles(text.encode(), self.k)
        return self.marks(own) if len(own) else None

    def marks(self, own: np.ndarray) -> np.ndarray:
        return minhash(own, self.a, self.b).astype(np.uint16).astype(">u2")

    @staticmethod
    def packed(values: np.ndarray | None) -> bytes:
        return b"" if values is None else values.tobytes()

    @staticmethod
    def likeness(x: np.ndarray | None, y: np.ndarray | None) -> float:
        """Share of equal values, an estimate of the Jaccard similarity; two empty sets: 1, one: 0."""
        if x is None or y is None:
            return float(x is None and y is None)
        return float((x == y).mean())

    def row(self, text: str, values: np.ndarray | None, following: str, following_values: np.ndarray | None) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = self.values(edited)
        return len(text), hashlib.sha256(edited.encode()).digest(), self.packed(values), self.packed(own), self.likeness(values, own), self.likeness(values, following_values)


_RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _along(batches, k: int):
    """Rows sorted by id, descending: each with the next one; ends of the partition carry their text."""
    maker, held, first = Fingerprinter(k), None, True
    kind = None

    def out(rows):
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(cols[0], kind), *[pa.array(c, t) for c, t in zip(cols[1:7], _KINDS, strict=True)], pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.int32()), pa.array(cols[9], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, [*_NAMES, "_part", "_edge", "_text"])

    part = None
    for batch in batches:
        kind = batch.column("doc_id").type
        ids = batch.column("doc_id").to_pylist()
        for at in range(0, batch.num_rows, 500):
            made = []
            for doc, text, part in zip(ids[at : at + 500], batch.column("text").slice(at, 500).to_pylist(), batch.column("_part").slice(at, 500).to_pylist(), strict=True):
                values = maker.values(text)
                if first:
                    made.append((None, None, None, None, None, None, None, part, 1, text))
                    first = False
                else:
                    made.append((held[0], *maker.row(held[1], held[2], text, values), part, 0, None))
                held = (doc, text, values)
            if made:
                yield out(made)
    if held is not None:
        yield out([(held[0], None, None, None, None, None, None, part, 2, held[1])])


def _ends(batches, k: int):
    maker = Fingerprinter(k)
    for batch in batches:
        made = [maker.row(t, maker.values(t), f, maker.values(f)) for t, f in zip(batch.column("_text").to_pylist(), batch.column("_following").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([m[i] for m in made], t) for i, t in enumerate(_KINDS)]], _NAMES)


def edited_fingerprints(docs: DataFrame, k: int = 5, rows_per_task: int = 5_000) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many (or all) of the next
    document in descending id (after the last: the first). Fingerprints are MinHash signatures of ``PERMUTATIONS``
    universal permutations over distinct ``k``-word shingles, in hexadecimal; likeness is the share of equal values.

    Texts move once: a range partitioning by id, descending; a document and the next one are then in one task, but
    for the last of each partition, which meets the next partition's first in a join of as many rows as partitions.
    Null text is empty (fingerprint '', like another empty one and nothing else); null ids come last; rows that
    repeat an id follow each other in the order of a hash of their texts; other columns are ignored; an empty table
    gives no rows.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tasks = tasks_for(docs.count(), rows_per_task)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = own.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    found = cut(ranged.mapInArrow(lambda b: _along(b, k), f"doc_id {kind}, {_RESULT}, _part int, _edge int, _text string"))
    heads = found.where("_edge = 1").select(F.col("_part").alias("_next"), F.col("_text").alias("_following"))
    parts = heads.select(F.col("_next").alias("_part"))
    first = parts.agg(F.min("_part").alias("_first"))
    follows = parts.withColumn("_next", F.lead("_part").over(Window.orderBy("_part"))).crossJoin(F.broadcast(first)).select("_part", F.coalesce("_next", "_first").alias("_next"))
    ends = found.where("_edge = 2").join(follows, "_part").join(heads, "_next").select("doc_id", "_text", "_following")
    ends = ends.mapInArrow(lambda b: _ends(b, k), f"doc_id {kind}, {_RESULT}")
    shown = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return found.where("_edge = 0").select(*_NAMES).unionByName(ends).withColumns(shown)


def _classed(batches, k: int):
    maker = Fingerprinter(k)
    for batch in batches:
        n, keys, prints = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            own = shingles(text, k)
            n.append(len(own))
            keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            prints.append(maker.packed(maker.marks(own)) if len(own) else None)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(prints, pa.binary())], ["_id", "n", "set_key", "fingerprint"])


def _linked(left: list, right: list, percent: int):
    """Rows of both blocks (lists of node, n, shingles) that are linked, by whole sets, and the place of each block's first row."""
    other = right or left
    nodes, n = (np.array([r[i] for r in other], np.int64) for i in (0, 1))
    for at, c in common_counts([r[2] for r in left], [r[2] for r in other]):
        own = np.array([r[:2] for r in left[at : at + len(c)]], np.int64)
        yield own[:, 0], nodes, (100 * c >= percent * (own[:, 1:] + n[None, :] - c)) & (own[:, :1] != nodes[None, :])


def _pairs(left: list, right: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked nodes of two blocks, or within one."""
    found = [(a[i], b[j]) for a, b, m in _linked(left, right, percent) for i, j in [np.nonzero(m)]]
    a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    once = slice(None) if right else a < b
    return np.minimum(a, b)[once], np.maximum(a, b)[once]


def _counts(left: list, right: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many nodes of the other block each node is linked with."""
    nodes, n, across = [], [], 0
    for a, b, m in _linked(left, right, percent):
        nodes.append(a)
        n.append(m.sum(axis=1))
        across, others = across + m.sum(axis=0), b
    if right:
        nodes.append(others)
        n.append(across)
    some = np.concatenate(n) > 0
    return np.concatenate(nodes)[some], np.concatenate(n)[some]


def _near(docs: DataFrame, k: int, percent: int, rows: int, tested, **blocks) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets, their classes, and what ``tested`` makes of each two blocks of classes that may be near.

    Copies of a set are one class. Bands of ``rows`` values of the fingerprints are joined to the smallest class that has
    them; what is so connected is a crowd, and all of a crowd meets in blocks of bounded size, on whole sets: no band
    and no group is gathered in one task, and pairs are not made before they are tested."""
    named = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = cut(named.withColumnRenamed("doc_id", "_id").mapInArrow(lambda b: _classed(b, k), f"_id {kind}, n long, set_key binary, fingerprint binary"))
    classes = sets.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("_id").alias("first_id"), F.min(F.struct("n", "fingerprint")).alias("s"))
    classes = cut(classes.select("set_key", "first_id", "s.n", "s.fingerprint", F.monotonically_increasing_id().alias("node")))
    bands = [F.struct(F.lit(i).alias("i"), F.xxhash64(F.substring("fingerprint", 2 * rows * i + 1, 2 * rows)).alias("v")) for i in range(PERMUTATIONS // rows)]
    banded = classes.select("node", F.explode(F.array(*bands)).alias("band")).select("node", "band.i", "band.v")
    shared = banded.groupBy("i", "v").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    links = banded.join(shared, ["i", "v"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    crowds = components(links).withColumnRenamed("component", "crowd")
    found = _crowd_links(crowds, classes.select("node", F.col("node").alias("comp")), classes, named, "doc_id", k, percent, tested=tested, **blocks)
    return sets, classes, found


def near_documents(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 5, **blocks) -> DataFrame:
    """Links (a, b: ids, a < b) between documents of different shingle sets, all that share a band of ``rows`` values of their
    fingerprints with ``percent`` or more of exact Jaccard similarity (others of the same crowd too). A pair of similarity 0.8 shares one of the
    25 bands with probability 1 - 5e-5. Copies of a set are one class, named by its smallest id; its result is as large as the links are
    many (:func:`near_counts` is not). Null and empty texts have no links; null ids are left out; an empty table gives no rows."""
    _, classes, found = _near(docs, k, percent, rows, _pairs, **blocks)
    name = lambda c: classes.select(F.col("node").alias(c), F.col("first_id").alias(f"id_{c}"))
    named_links = found.distinct().join(name("a"), "a").join(name("b"), "b")
    return named_links.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def near_counts(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 5, **blocks) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id with the same shingle set, its own if that is empty), n_links (other classes
    that the class is near to, as in :func:`near_documents`). Rows with null ids are left out; rows that repeat an id are kept."""
    sets, classes, found = _near(docs, k, percent, rows, _counts, **blocks)
    n = found.groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n_links"))
    known = classes.select("set_key", "first_id", "node").join(n, "node", "left")
    j = sets.select("_id", "set_key").join(known, "set_key", "left")
    return j.select(F.col("_id").alias("doc_id"), F.coalesce("first_id", "_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """:func:`edited_fingerprints` of all ``documents``; nulls, repeated rows and empty tables as there."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_links(spark, sf_dir: str) -> DataFrame:
    """:func:`near_counts` of all ``documents``; nulls, repeated rows and empty tables as there."""
    return near_counts(table(spark, sf_dir, "documents"))


#: Brute force over all pairs of classes that share a shingle: for small tables only.
LINKS_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g
  FROM w
), k AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS key, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT key, min(doc_id) AS class_id, any_value(n) AS n FROM k GROUP BY key),
t AS (SELECT class_id, n, g FROM c JOIN s ON s.doc_id = class_id),
p AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS x, b.n AS y, count(*) AS m FROM t a JOIN t b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY ALL),
l AS (SELECT a, count(*) AS n_links FROM p WHERE 100 * m >= 80 * (x + y - m) GROUP BY a)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN c ON c.key = k.key LEFT JOIN l ON l.a = c.class_id
"""

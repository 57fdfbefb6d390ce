"""An inverted file of vectors: coarse cells, product-quantised residuals in folders by cell, exact scores of the best few."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.dedup import top_k
from docmill.operators.search import _packed
from docmill.sources.stored import shipped

shipped(__name__)

#: Components of a vector that share one byte of its code.
WIDTH = 2
#: Rows at most that the cells and code books are learnt from.
SAMPLE = 20_000
#: Codes that are scored at once, and packs of them in a task.
PACK, PACKS = 2048, 16


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` under ``path``: key, other columns, code, embedding, in folders by cell. ``probes``: cells that a query looks into."""

    path: str
    key: str
    cells: np.ndarray
    books: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the squared length of x: enough to order centres."""
    return (centres**2).sum(axis=1) - 2 * x @ centres.T


def _centres(x: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; a centre without rows stays where it is."""
    out = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        near = _apart(x, out).argmin(axis=1)
        n = np.bincount(near, minlength=len(out))[:, None]
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        out = np.where(n > 0, sums / np.maximum(n, 1), out)
    return out


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, parts, WIDTH), the last part filled with zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH))).reshape(len(x), -1, WIDTH)


def _codes(x: np.ndarray, cells: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's cell, and for each part of its residual the nearest entry of the part's book."""
    cell = _apart(x, cells).argmin(axis=1)
    parts = _parts(x - cells[cell])
    return cell, np.stack([_apart(parts[:, j], book).argmin(axis=1) for j, book in enumerate(books)], axis=1).astype(np.uint8)


def _probes(x: np.ndarray, cells: np.ndarray, recall: float, k: int = 10, asked: int = 256) -> int:
    """Cells to look into, nearest first, so that sample rows find the share ``recall`` of their ``k`` nearest in the sample.

    Neighbours in a sample are farther away than those in the table, so the share in the table is no lower."""
    q = x[:asked]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    if near.size == 0:
        return 1
    place = np.argsort(np.argsort(_apart(q, cells), axis=1), axis=1)
    own = _apart(x, cells).argmin(axis=1)
    found = np.take_along_axis(place, own[near], axis=1)
    return int(np.quantile(found, recall, method="higher")) + 1


def _model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/model")


def write_vector_index(corpus: DataFrame, path: str, key: str = "vec_id", kept: tuple[str, ...] = (), recall: float = 0.95, sample: int = SAMPLE, seed: int = 3) -> VectorIndex | None:
    """Write every row of ``corpus`` (key, embedding, the columns ``kept`` for filters) by cell, with its code.

    Cells (the root of the number of rows, 8 to 1,024) and code books are learnt from at most ``sample`` rows, chosen by the
    hash of their key. Rows with a null key, without a vector, of another width than the first key's, or of length 0 are left out:
    they have no cosine. None if no row is left."""
    known = corpus.where(F.col(key).isNotNull() & F.col("embedding").isNotNull() & F.exists("embedding", lambda v: v != 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)))
    first = known.select(F.min_by(F.size("embedding"), key).alias("n")).first()
    if first.n is None:
        return None
    known = known.where(F.size("embedding") == first.n).select(key, *kept, "embedding")
    taken = known.select("embedding", F.xxhash64(key).alias("_h"), key).orderBy("_h", key).limit(sample).collect()
    x = _unit(np.array([r.embedding for r in taken], np.float64))
    rng = np.random.default_rng(seed)
    cells = _centres(x, int(np.clip(np.sqrt(known.count()), 8, 1024)), rng)
    left = _parts(x - cells[_apart(x, cells).argmin(axis=1)])
    books = np.stack([_centres(left[:, j], 256, rng) for j in range(left.shape[1])])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            v = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
            cell, codes = _codes(v, cells, books)
            made = [pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "cell", "code"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema) + ", cell int, code binary"
    known.mapInArrow(run, schema).hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/rows")
    index = VectorIndex(path, key, cells, books, _probes(x, cells, recall))
    spark = corpus.sparkSession
    told = [("cells", cells.shape[1], cells.ravel().tolist()), ("books", books.shape[1], books.ravel().tolist()), ("probes", index.probes, [])]
    spark.createDataFrame(told, "name string, n int, v array<double>").coalesce(1).write.parquet(f"{path}/model")
    return index


def read_vector_index(spark: SparkSession, path: str, key: str = "vec_id") -> VectorIndex:
    told = {r.name: r for r in _model(spark, path).collect()}
    cells = np.array(told["cells"].v).reshape(-1, told["cells"].n)
    parts = -(-told["cells"].n // WIDTH)
    return VectorIndex(path, key, cells, np.array(told["books"].v).reshape(parts, told["books"].n, WIDTH), told["probes"].n)


def _looked_into(q: np.ndarray, cells: np.ndarray, probes: int) -> np.ndarray:
    """(queries, cells): whether a query looks into a cell."""
    out = np.zeros((len(q), len(cells)), bool)
    np.put_along_axis(out, np.argsort(_apart(q, cells), axis=1, kind="stable")[:, :probes], True, axis=1)
    return out


def _shortlists(cells: np.ndarray, books: np.ndarray, probes: int, shortlist: int):
    """A map of (qids, qv, cell, ids, code) to the best few of each query in a pack, by the scores of their codes."""

    def run(batches):
        import pyarrow as pa

        block, of = None, None
        for batch in batches:
            for qids, qv, cell, ids, code in zip(*[batch.column(c) for c in ("qids", "qv", "cell", "ids", "codes")], strict=True):
                qids = qids.values.to_numpy(zero_copy_only=False)
                if block is None or not np.array_equal(block, qids):
                    q = _unit(qv.values.to_numpy(zero_copy_only=False).reshape(len(qids), -1))
                    of = q, _looked_into(q, cells, probes), np.einsum("qjw,jcw->jcq", _parts(q), books).astype(np.float32)
                    block = qids
                q, looks, gains = of
                asking = np.nonzero(looks[:, cell.as_py()])[0]
                ids, codes = ids.values.to_numpy(zero_copy_only=False), np.frombuffer(code.as_py(), np.uint8).reshape(-1, len(books))
                if not len(asking) or not len(ids):
                    continue
                scores = np.repeat((q[asking] @ cells[cell.as_py()]).astype(np.float32)[None], len(ids), axis=0)
                for j in range(len(books)):
                    scores += gains[j][codes[:, j]][:, asking]
                order = np.argsort(ids, kind="stable")
                top = order[np.argsort(-scores[order], axis=0, kind="stable")[:shortlist]]
                n = len(top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(qids[asking], n)), pa.array(np.full(top.size, cell.as_py(), np.int32)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(scores, top, axis=0).ravel().astype(np.float64))],
                    ["qid", "cell", "vec_id", "score"],
                )

    return run


def _packs(rows: DataFrame, key: str, size: int = PACK) -> DataFrame:
    """cell, ids, codes: rows of a batch by their cell, codes one after the other."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, size):
                part = whole.slice(at, size)
                cell, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cell", key))
                codes = part.column("code").to_pylist()
                for c in np.unique(cell):
                    own = np.nonzero(cell == c)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([ids[own]], pa.list_(pa.int64())), pa.array([b"".join(codes[i] for i in own)], pa.binary())], ["cell", "ids", "codes"])

    return rows.select("cell", key, "code").mapInArrow(run, "cell int, ids array<long>, codes binary")


def probed_cells(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """qid, place, cell: the cells of each query, nearest first."""
    cells, probes = index.cells, probes or index.probes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            q = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
            near = np.argsort(_apart(q, cells), axis=1, kind="stable")[:, :probes]
            n = near.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("qid").to_numpy(zero_copy_only=False), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)), pa.array(near.ravel().astype(np.int32))], ["qid", "place", "cell"])

    return queries.select(F.col("qid").cast("long").alias("qid"), "embedding").mapInArrow(run, "qid long, place int, cell int").where(F.col("place") < probes)


def shortlists(index: VectorIndex, queries: DataFrame, size: int, where: Column | None = None, probes: int | None = None, block: int = 2048) -> DataFrame:
    """qid, cell, vec_id, score, rank: the ``size`` best of each query by the scores of their codes, from the cells it looks into.

    Only folders of such cells are read (partitions pruned by the queries' cells), and of these only keys and codes. Queries meet
    packs of codes in blocks, as in the exact search."""
    spark = queries.sparkSession
    cells = probed_cells(index, queries, probes).select("cell").distinct()
    rows = index.rows(spark)
    rows = (rows if where is None else rows.where(where)).join(F.broadcast(cells), "cell", "left_semi")
    blocks = max(1, -(-queries.count() // block))
    q = _packed(queries, "qid", F.pmod(F.xxhash64("qid"), F.lit(blocks)), block).select(F.col("ids").alias("qids"), F.col("v").alias("qv"))
    # a joined row has a whole block of queries, and a task's rows go to Python in one batch: few packs a task, whatever the table's size
    packs = _packs(rows, index.key)
    packs = packs.repartition(max(1, -(-rows.count() // (PACK * PACKS))), F.xxhash64("ids"))
    pairs = packs.crossJoin(F.broadcast(q) if blocks == 1 else q)
    run = _shortlists(index.cells, index.books, probes or index.probes, size)
    return top_k(pairs.mapInArrow(run, "qid long, cell int, vec_id long, score double"), size, tie="vec_id")


def vector_search_approx(queries: DataFrame, index: VectorIndex | None, k: int = 10, floor: float = 0.3, shortlist: int = 100, where: Column | None = None, probes: int | None = None) -> DataFrame:
    """qid, vec_id, score, rank: as the exact search, from a stored index (long keys): the ``shortlist`` best by code, ranked by their exact cosines.

    ``where`` filters by kept columns before anything is scored. Queries without a vector or of another width have no hits; nor has
    any query without an index (None: no row had a vector)."""
    if index is None:
        return queries.select("qid", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).where("false")
    asked = queries.where(F.col("qid").isNotNull() & (F.size("embedding") == index.cells.shape[1]) & F.exists("embedding", lambda v: v != 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v))).select("qid", "embedding")
    near = shortlists(index, asked, shortlist, where, probes).select("qid", "cell", "vec_id").distinct()
    rows = index.rows(queries.sparkSession)
    rows = (rows if where is None else rows.where(where)).select(F.col(index.key).alias("vec_id"), "cell", "embedding")
    pairs = rows.join(near, ["cell", "vec_id"]).join(asked.withColumnRenamed("embedding", "q"), "qid")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = F.round(dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q"))), 6)
    return top_k(pairs.withColumn("score", cosine).where(F.col("score") >= floor).select("qid", "vec_id", "score"), k, tie="vec_id")

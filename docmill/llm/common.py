"""What the corpus operators share: reading, lineage cuts, global running sums, shingle hashing."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space and its complement, as the word rule of all operators here.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shipped(module_name: str) -> None:
    """Send a module's functions to the executors by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


shipped(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``. Where that is unset, a temporary one, but only
    for a master that runs in this process (tests); on a cluster executors could not read each other's, so it is an error."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root


def cut(df: DataFrame, rows: int | None = None, rows_per_task: int = 50_000) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from that: no lineage, survives lost executors.

    With ``rows``, the size at most of a result that comes from a shuffle, it is written by as many tasks as those rows need.

    The table goes when the application ends (or by :func:`drop`); its statistics are those of its files.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, math.ceil(rows / rows_per_task)))).write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`cut` wrote and nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_cut_path", None)):
            sc = t.sparkSession.sparkContext
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Tasks of a global sort, at most; beyond it tasks hold more rows, so that a row for each task is always a small table.
MOST_TASKS = 20_000


def tasks_for(rows: int, rows_per_task: int) -> int:
    return min(MOST_TASKS, max(1, math.ceil(rows / rows_per_task)))


def packed(docs: DataFrame) -> DataFrame:
    """The rows as one struct column ``_doc``, beside which columns of any name may stand; ``select("_doc.*")`` undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def spread(df: DataFrame, rows: int, order: list[Column], rows_per_task: int = 20_000) -> DataFrame:
    """Globally sorted and cut: adds ``_part`` (the sorted partition's number) and ``_pos`` (rising with the order).

    Range partitions are as many as ``rows`` need for about ``rows_per_task`` in each, up to ``MOST_TASKS``.
    """
    n = tasks_for(rows, rows_per_task)
    out = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(out.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}))


def running(ordered: DataFrame, value: str, name: str) -> DataFrame:
    """Add the running sum of ``value`` (own row included) along the order that :func:`spread` made.

    Two levels: sums of the partitions (one row each, ``MOST_TASKS`` at most, broadcast), then a window inside each partition.
    """
    per = ordered.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = per.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn(name, inside).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_before")


_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(3).integers(1, 2**63, 256, np.uint64)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Longest stretch of a text that is hashed at once; longer texts are cut at white space.
_BLOCK = 1 << 18
_TABLES: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; made where they are first used, so that no task is sent them."""
    if not _TABLES:
        _TABLES["up"] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_BLOCK, _BASE)])
        _TABLES["down"] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_BLOCK, np.uint64(pow(int(_BASE), -1, 1 << 64)))])
    return _TABLES["up"], _TABLES["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in order, A-Z as a-z: differences of a running polynomial hash."""
    if len(text) > _BLOCK:
        at = max(text.rfind(c, 0, _BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if at <= 0:  # a word longer than a block
            end = next((i for i in range(_BLOCK, len(text)) if _BLANK[text[i]]), len(text))
            own = np.frombuffer(hashlib.blake2b(text[:end].lower().strip(b" \n\t\r\x0b\x0c"), digest_size=8).digest(), np.uint64)
            return np.concatenate([own, word_hashes(text[end:])])
        parts = []
        while len(text) > _BLOCK and at > 0:
            parts.append(word_hashes(text[:at]))
            text = text[at:]
            at = max(text.rfind(c, 0, _BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        return np.concatenate([*parts, word_hashes(text)])
    data = np.frombuffer(text, np.uint8)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    ends = np.flatnonzero(blank[1:] != blank[:-1])
    total = np.zeros(len(data) + 1, np.uint64)
    up, down = _powers()
    np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends[1::2]] - total[ends[::2]]) * down[ends[::2]])


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The set of hashed k-word shingles, sorted. Fewer words than k: the whole sequence is one; none: empty."""
    h = word_hashes(text or b"")
    if not len(h):
        return h
    width = min(k, len(h))
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for i in range(width):
        acc = mixed(acc + h[i : i + n])
    acc.sort()
    return acc[np.r_[True, acc[1:] != acc[:-1]]]


def universal(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``count`` permutations x -> a*x + b of the 32-bit integers."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count, np.uint32)


def minhash(values: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """Smallest value of each permutation over a set of 64-bit hashes; all ones for an empty set."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), block):
        np.minimum(low, (x[at : at + block][None, :] * a[:, None] + b[:, None]).min(axis=1), out=low)
    return low

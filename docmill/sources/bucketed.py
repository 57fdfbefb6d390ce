"""Tables in buckets of a key's hash: writes touch only the buckets of their keys, and show by one manifest that is put in place at the end."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docmill.sources.stored import _path


@dataclass(frozen=True)
class Manifest:
    """One version of a table: its unique ``keys``, the columns ``by`` whose hash is the bucket, and the folder of each bucket that has rows."""

    version: int
    keys: list[str]
    by: list[str]
    buckets: int
    schema: str
    folders: dict[str, str]


def _versions(spark: SparkSession, path: str) -> list[int]:
    hadoop, fs = _path(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    version = _versions(spark, path)[-1] if version is None else version
    return Manifest(**json.loads(spark.read.text(f"{path}/manifests/{version}.json", wholetext=True).first().value))


def _publish(spark: SparkSession, path: str, m: Manifest) -> None:
    """The manifest is written beside the others, then renamed: readers see the version before it or this one. A version that another
    writer has published meanwhile is an error, and the table stays theirs."""
    temporary, fs = _path(spark, f"{path}/manifests/{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(m.__dict__).encode()))
    out.close()
    final, _ = _path(spark, f"{path}/manifests/{m.version}.json")
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise RuntimeError(f"version {m.version} of {path} has been written by another job")


def _bucket(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def _latest_rows(rows: DataFrame, keys: list[str], order: Column | None) -> DataFrame:
    """One row a key: the last by ``order`` (ties, and no order: by hash of the row); rows with a null in their key are left out. Combined before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    last = F.struct(*([order] if order is not None else []), F.xxhash64(F.to_json(whole)))
    kept = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max_by(whole, last).alias("_row"))
    return kept.select("_row.*")


def _write(rows: DataFrame, path: str, by: list[str], buckets: int) -> dict[str, str]:
    """Rows in a new folder by bucket (large buckets as several files), and the folders that hold any."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    rows.withColumn("_bucket", _bucket(by, buckets)).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    hadoop, fs = _path(spark, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()]
    return {n.partition("=")[2]: f"{folder}/{n}" for n in names}


def create(rows: DataFrame, path: str, keys: list[str], by: list[str] | None = None, buckets: int = 256, order: Column | None = None) -> Manifest:
    """A table of one row a key, in ``buckets`` by the hash of ``by`` (some of the keys; all of them if not given)."""
    by = by or keys
    if not set(by) <= set(keys):
        raise ValueError("a bucket must follow from the key")
    m = Manifest(0, keys, by, buckets, rows.schema.json(), _write(_latest_rows(rows, keys, order), path, by, buckets))
    _publish(rows.sparkSession, path, m)
    return m


def _read(spark: SparkSession, path: str, m: Manifest, only: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(m.schema))
    folders = [f"{path}/{f}" for b, f in sorted(m.folders.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or an older one that has not been cleared."""
    return _read(spark, path, manifest(spark, path, version))


def _touched(rows: DataFrame, m: Manifest) -> set[str]:
    """Buckets of these rows: at most the table's number of buckets pass the driver."""
    return {str(r.b) for r in rows.select(_bucket(m.by, m.buckets).alias("b")).distinct().collect()}


def _replace(spark: SparkSession, path: str, m: Manifest, rows: DataFrame, touched: set[str]) -> Manifest:
    kept = {b: f for b, f in m.folders.items() if b not in touched}
    new = Manifest(m.version + 1, m.keys, m.by, m.buckets, m.schema, kept | (_write(rows, path, m.by, m.buckets) if touched else {}))
    _publish(spark, path, new)
    return new


def upsert(path: str, rows: DataFrame, order: Column | None = None) -> Manifest:
    """``rows`` in place of those of equal keys; repeating it changes no row. Buckets without any of its keys are neither read nor written."""
    spark = rows.sparkSession
    m = manifest(spark, path)
    new = _latest_rows(rows.select(*StructType.fromJson(json.loads(m.schema)).names), m.keys, order)
    touched = _touched(new, m)
    left = _read(spark, path, m, touched).join(new.select(*m.keys), m.keys, "left_anti")
    return _replace(spark, path, m, left.unionByName(new), touched)


def delete(path: str, gone: DataFrame) -> Manifest:
    """Rows whose ``by`` columns stand in ``gone`` go, such as all chunks of a document where chunks are bucketed by document."""
    spark = gone.sparkSession
    m = manifest(spark, path)
    gone = gone.select(*m.by).where(" AND ".join(f"`{k}` IS NOT NULL" for k in m.by)).distinct()
    touched = _touched(gone, m) & set(m.folders)
    return _replace(spark, path, m, _read(spark, path, m, touched).join(gone, m.by, "left_anti"), touched)


def clear(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete manifests but the newest ``keep``, and folders that no manifest left names (crashed writes too, so no writer may be at work);
    the number of folders that went."""
    for v in _versions(spark, path)[:-keep]:
        old, fs = _path(spark, f"{path}/manifests/{v}.json")
        fs.delete(old, False)
    used = {f for v in _versions(spark, path) for f in manifest(spark, path, v).folders.values()}
    hadoop, fs = _path(spark, f"{path}/data")
    gone = [b.getPath() for f in fs.listStatus(hadoop) for b in fs.listStatus(f.getPath()) if b.isDirectory() and f"data/{f.getPath().getName()}/{b.getPath().getName()}" not in used]
    for p in gone:
        fs.delete(p, True)
    return len(gone)

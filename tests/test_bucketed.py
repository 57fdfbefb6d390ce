"""Tables in buckets: what a write touches, what readers see, and statistics of a write."""

import json

import pytest
from pyspark.sql import functions as F

from docmill.operators.aggregate import write_indexed
from docmill.sources import bucketed

SCHEMA = "doc long, chunk long, text string"


@pytest.fixture
def path(spark, tmp_path):
    rows = spark.createDataFrame([(d, c, f"t{d}.{c}") for d in range(40) for c in range(3)], SCHEMA)
    bucketed.create(rows, str(tmp_path / "t"), ["doc", "chunk"], by=["doc"], buckets=8)
    return str(tmp_path / "t")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_only_touched_buckets_are_written(spark, path):
    before = bucketed.manifest(spark, path)
    assert len(before.folders) > 5
    new = spark.createDataFrame([(3, 1, "new"), (3, 9, "more"), (None, 1, "no key"), (3, None, "no key")], SCHEMA)
    after = bucketed.upsert(path, new)
    assert [b for b in before.folders if before.folders[b] != after.folders[b]] == [str(new.select(bucketed._bucket(["doc"], 8)).first()[0])]
    want = {(d, c): f"t{d}.{c}" for d in range(40) for c in range(3)} | {(3, 1): "new", (3, 9): "more"}
    assert rows_of(bucketed.read(spark, path)) == sorted((*k, v) for k, v in want.items())
    bucketed.upsert(path, new)
    assert rows_of(bucketed.read(spark, path)) == sorted((*k, v) for k, v in want.items())


def test_untouched_buckets_are_not_read(spark, path):
    """With the other buckets' files gone, the write still works."""
    from docmill.sources.stored import delete as drop

    m = bucketed.manifest(spark, path)
    own = str(spark.sql("SELECT 7L AS doc").select(bucketed._bucket(["doc"], 8)).first()[0])
    for b, f in m.folders.items():
        if b != own:
            drop(spark, f"{path}/{f}")
    assert bucketed.upsert(path, spark.createDataFrame([(7, 0, "x")], SCHEMA)).version == 1


def test_last_of_a_key_wins(spark, path):
    new = spark.createDataFrame([(1, 1, "a"), (1, 1, "ccc"), (1, 1, "bb")], SCHEMA)
    bucketed.upsert(path, new, order=F.length("text"))
    assert bucketed.read(spark, path).where("doc = 1 AND chunk = 1").collect()[0].text == "ccc"


def test_delete_by_document(spark, path):
    gone = spark.createDataFrame([(5,), (6,), (6,), (999,), (None,)], "doc long")
    bucketed.delete(path, gone)
    assert rows_of(bucketed.read(spark, path)) == sorted((d, c, f"t{d}.{c}") for d in range(40) for c in range(3) if d not in (5, 6))
    bucketed.delete(path, spark.range(40).select(F.col("id").alias("doc")))
    assert bucketed.read(spark, path).count() == 0 and bucketed.manifest(spark, path).folders == {}
    bucketed.upsert(path, spark.createDataFrame([(1, 1, "again")], SCHEMA))
    assert rows_of(bucketed.read(spark, path)) == [(1, 1, "again")]
    bucketed.upsert(path, spark.createDataFrame([], SCHEMA))
    assert rows_of(bucketed.read(spark, path)) == [(1, 1, "again")]


def test_a_crash_leaves_the_old_version(spark, path, monkeypatch):
    old = rows_of(bucketed.read(spark, path))

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(bucketed, "_publish", crash)
    new = spark.createDataFrame([(2, 0, "new")], SCHEMA)
    with pytest.raises(OSError):
        bucketed.upsert(path, new)
    assert rows_of(bucketed.read(spark, path)) == old
    monkeypatch.undo()
    bucketed.upsert(path, new)
    assert (2, 0, "new") in rows_of(bucketed.read(spark, path))
    assert rows_of(bucketed.read(spark, path, version=0)) == old
    assert bucketed.clear(spark, path, keep=1) >= 2
    assert (2, 0, "new") in rows_of(bucketed.read(spark, path))


def test_two_writers_of_one_version(spark, path):
    """The second to publish a version fails; the first one's rows stay."""
    m = bucketed.manifest(spark, path)
    bucketed.upsert(path, spark.createDataFrame([(2, 0, "first")], SCHEMA))
    with pytest.raises(RuntimeError, match="another job"):
        bucketed._replace(spark, path, m, bucketed.read(spark, path), set())
    assert (2, 0, "first") in rows_of(bucketed.read(spark, path))
    assert json.loads(m.schema)["type"] == "struct"


def test_a_bucket_follows_from_the_key(spark, tmp_path):
    with pytest.raises(ValueError):
        bucketed.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "x"), ["doc"], by=["chunk"])


def test_statistics_of_a_write(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("b", 1, None), (None, 1, [1.0, 1.0]), ("c", 1, [5.0, 6.0])], "chunk_id string, page_number int, v array<double>").repartition(3)
    path = str(tmp_path / "w")
    told = write_indexed(rows, F.when(F.col("v").isNull(), "no vector"), path, vector="v").first()
    assert (told.attempted, told.indexed, told.failed, told.dimension) == (5, 2, 3, 2) and told.seconds > 0 and told.ms_per_row == 500 * told.seconds
    assert sorted((r.chunk_id, r.page_number) for r in spark.read.parquet(path).collect()) == [("a", 1), ("c", 1)]
    none = write_indexed(rows.where("false"), F.lit(None).cast("string"), str(tmp_path / "none")).first()
    assert (none.attempted, none.indexed, none.failed, none.dimension) == (0, 0, 0, None)

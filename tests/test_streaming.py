import random

import pytest
from pyspark.sql import functions as F

from docmill.functions.text import terms
from docmill.operators.extract import recursive_split
from docmill.streaming import ingest, rate_limit


def test_admit():
    assert rate_limit.admit([0, 10, 20, 59, 60], 2, 60)[0] == [True, True, False, False, True]


def test_batch_rate_limit_equals_brute_force(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = sorted((r.user_id, r.ts.timestamp(), r.event_id) for r in e.collect())
    want, held = {}, {}
    for user, t, event in rows:
        ok, held[user] = rate_limit.admit([t], 3, 86_400.0, held.get(user))
        want[event] = ok[0]
    got = {r.event_id: r.admitted for r in rate_limit.rate_limit(e, "user_id", "ts", "event_id", 3, 86_400.0).collect()}
    assert got == want and len(set(want.values())) == 2


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_rate_limit_stream_equals_batch(spark, tmp_path, rocksdb):
    """Shuffled over batches within the allowed lateness, the stream decides as the batch form does; a row later than that is left out."""
    r = random.Random(4)
    rows = [(u, 1_700_000_000 + r.randrange(0, 900) + r.random(), 0) for u in range(4) for _ in range(60)]
    rows = [(u, t, i) for i, (u, t, _) in enumerate(rows)]
    frame = lambda x: spark.createDataFrame(x, "u long, s double, e long").select("u", F.timestamp_seconds("s").alias("ts"), "e")
    order = sorted(rows, key=lambda x: x[1] + r.uniform(0, 250))  # up to 250 s late
    late, last = (1, 1_700_000_000 - 500.0, 5000), (99, 1_700_100_000.0, 6000)
    parts = [order[:60], order[60:150], order[150:], [last], [late, (99, 1_700_100_001.0, 6001)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame(rows[:0]).write.parquet(source)
    for part in parts:
        frame(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("u long, ts timestamp, e long").parquet(source)
        q = rate_limit.rate_limit_stream(stream, "u", "ts", "e", 5, 60.0, "300 seconds").writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {x.e: x.admitted for x in spark.read.parquet(out).collect()}
    want = {x.e: x.admitted for x in rate_limit.rate_limit(frame(rows), "u", "ts", "e", 5, 60.0).collect()}
    assert {k: v for k, v in got.items() if k < 5000} == want and len(set(want.values())) == 2
    assert 5000 not in got


def feed(spark, source, target, state):
    q = ingest.document_stream(spark, source, "doc_id long, text string, v long", 100, F.col("v")).writeStream.foreachBatch(ingest.ingest_to(target, size=60, overlap=10)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def test_ingest_keeps_the_newest_version(spark, tmp_path):
    """Doubled, late, emptied and repeated documents over four batches against a dictionary of newest texts."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    r, newest = random.Random(2), {}
    text = lambda: ". ".join(" ".join(r.choice("abcdefgh") * r.randrange(1, 6) for _ in range(8)) for _ in range(r.randrange(1, 6)))
    for batch in range(4):
        rows = [(r.randrange(12), r.choice([text(), text(), "", None, "  \n"]), 100 * batch + r.randrange(250)) for _ in range(15)]
        rows = list({(d, v): (d, t, v) for d, t, v in rows if newest.get(d, (-1,))[0] != v}.values()) + [(None, "no id", 1)]
        for d, t, v in rows:
            if d is not None and v > newest.get(d, (-1,))[0]:
                newest[d] = (v, t)
        spark.createDataFrame(rows, "doc_id long, text string, v long").repartition(3).write.mode("append").parquet(source)
        feed(spark, source, target, state)
        live = [(d, t) for d, (_, t) in newest.items() if (t or "").strip()]
        want = recursive_split(spark.createDataFrame(live, "doc_id long, text string"), ["doc_id"], 60, 10)
        got = ingest.current(spark, target).select("doc_id", "pos", "start", "text")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    df, n = ingest.statistics(spark, target)
    words = want.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").count()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, words.collect()))
    total = want.agg(F.count("*"), F.avg(F.size(terms(F.col("text"))))).first()
    assert n.first()[0] == total[0] and abs(n.first()[1] - total[1]) < 1e-9
    # the last batch again, as after a failure: nothing changes
    last = spark.createDataFrame(rows, "doc_id long, text string, version long").withColumn("origin", F.lit("zz"))
    ingest.ingest_to(target, size=60, overlap=10)(last, 3)
    assert sorted(map(tuple, ingest.current(spark, target).select("doc_id", "pos", "start", "text").collect())) == sorted(map(tuple, want.collect()))
    one = str(tmp_path / "one")
    ingest.compact(spark, target, one)
    assert sorted(map(tuple, ingest.current(spark, one).select("doc_id", "pos", "text").collect())) == sorted(map(tuple, want.select("doc_id", "pos", "text").collect()))
    older = spark.createDataFrame([(d, "an old text", -5, "x") for d in newest], "doc_id long, text string, version long, origin string")
    ingest.ingest_to(one, size=60, overlap=10)(older, 0)
    assert ingest.current(spark, one).count() == want.count()

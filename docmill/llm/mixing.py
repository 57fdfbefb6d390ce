"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import WORD, cut, packed, running, spread, table, text_or_empty


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source (``source``, null is one): source_size, source_rank, start (words of the sources before it), target.

    Sources in code point order, null last, get ``weights`` in turn and share ``share`` times all words by weight;
    none gets more than ``most`` times its own words, and what it leaves is shared again among the rest. Along
    rising most*size/weight the full sources come first, so that two running sums find them in one pass.
    """
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = per.count()
    ranked = running(spread(per, n, [F.col("source").asc_nulls_last()]).withColumn("_one", F.lit(1)), "_one", "_rank")
    ranked = running(ranked, "source_size", "_end")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.select("source", "source_size", F.col("_rank").alias("source_rank"), (F.col("_end") - F.col("source_size")).alias("start"), turn.alias("weight"))
    ranked = cut(ranked.withColumn("full_at", F.lit(float(most)) * F.col("source_size")))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all_words"), F.sum("weight").alias("all_weight"))
    by_fill = spread(ranked, n, [F.col("full_at") / F.col("weight"), F.col("source_rank")])
    by_fill = running(running(by_fill, "full_at", "_full"), "weight", "_weight").crossJoin(F.broadcast(total))
    budget = F.lit(float(share)) * F.col("all_words")
    left = (budget - (F.col("_full") - F.col("full_at"))) / (F.col("all_weight") - (F.col("_weight") - F.col("weight")))
    by_fill = cut(by_fill.withColumns({"capped": F.col("full_at") <= left * F.col("weight"), "budget": budget}))
    rest = by_fill.agg(F.sum(F.when(F.col("capped"), F.col("full_at")).otherwise(0.0)).alias("_taken"), F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).alias("_open"))
    level = (F.col("budget") - F.col("_taken")) / F.col("_open")
    target = F.when(F.col("capped"), F.col("full_at")).otherwise(F.col("weight") * level)
    return by_fill.crossJoin(F.broadcast(rest)).select("source", "source_size", "source_rank", "start", target.alias("target"), "all_words")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "", row: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times, taken, row (its place in the input, or
    the values of the column ``row``).

    Weighted fair queueing: each source queues its documents in a shuffled order (by the hash of id and ``seed``),
    ``most`` times over; a document's virtual finish time is the source's words up to and with it, divided by
    the source's target. All entries are range-sorted by finish time and taken while the words taken stay within
    ``share`` times all words. ``taken`` counts repeats, so it is at most ``most`` times ``size``. Whole documents
    are taken, hence a source is within about one document of its target. The result depends on the rows alone,
    not on their order. A hot source is spread over many tasks: running sums have two levels (see ``spread``).

    Null text has size 0; a null source is a source, the last; null ids shuffle as the empty string; rows that
    repeat an id are separate documents; other columns are ignored; an empty table gives no rows.
    """
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    place = F.monotonically_increasing_id() if row is None else F.col(row)
    sized = cut(docs.select("doc_id", "source", size.alias("size"), place.alias("row")))
    n = sized.count()
    targets = cut(source_targets(sized, weights, share, most))
    key = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))), 1, 16)
    joined = sized.withColumn("key", key).join(targets, sized.source.eqNullSafe(targets.source)).drop(targets.source)
    queued = running(spread(joined, n, [F.col("source_rank"), F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")]), "size", "_end")
    queued = cut(queued.withColumn("end", F.col("_end") - F.col("start")).drop("_end", "_part", "_pos", "start"))
    finish = lambda p: (F.col("end") + F.lit(p) * F.col("source_size")) / F.col("target")
    entry = lambda p: F.struct(finish(p).alias("finish"), "source_rank", "key", "doc_id", "size", "row", F.lit(p).alias("pass"))
    entries = queued.where("size > 0").select("all_words", F.explode(F.array(*[entry(p) for p in range(most)])).alias("e")).select("all_words", "e.*")
    order = ["finish", "source_rank", "key", "doc_id", "size", "row", "pass"]
    in_time = running(spread(entries, n * most, [F.col(c) for c in order]), "size", "so_far").where(F.col("so_far") <= F.lit(float(share)) * F.col("all_words"))
    last = in_time.agg(F.max(F.struct(*order)).alias("last"))
    times = sum((F.when((F.col("size") > 0) & (entry(p) <= F.col("last")), 1).otherwise(0) for p in range(most)), F.lit(0))
    out = queued.crossJoin(F.broadcast(last)).withColumn("times", times)
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).cast("long").alias("taken"), "row")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mix` takes it (not at all, once, ...).

    The rows are written once with a number each, by which decisions go back to them, so equal ids or rows are no group.
    Nulls and ties as in :func:`mix`; further columns pass through, whatever their names; an empty table gives no rows.
    """
    own = cut(packed(docs).withColumn("_row", F.monotonically_increasing_id()))
    taken = mix(own.select("_doc.doc_id", "_doc.text", "_doc.source", "_row"), row="_row", **how).where("times > 0").select(F.col("row").alias("_row"), "times")
    copies = own.join(taken, "_row").select("_doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy"))
    return copies.select("_doc.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """:func:`mix` of all ``documents``; nulls, ties and empty tables as there."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         left(md5(coalesce(doc_id::VARCHAR, '')), 16) AS key
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (source_rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS full_at, sum(source_size) OVER ()::BIGINT AS all_words
  FROM per
), filled AS (
  SELECT *, 1.5::DOUBLE * all_words AS budget,
         sum(weight) OVER () AS all_weight,
         sum(full_at) OVER (ORDER BY full_at / weight, source_rank ROWS UNBOUNDED PRECEDING) AS so_full,
         sum(weight) OVER (ORDER BY full_at / weight, source_rank ROWS UNBOUNDED PRECEDING) AS so_weight
  FROM weighed
), flagged AS (
  SELECT *, full_at <= (budget - (so_full - full_at)) / (all_weight - (so_weight - weight)) * weight AS capped FROM filled
), targets AS (
  SELECT source, source_size, source_rank, all_words,
         CASE WHEN capped THEN full_at
              ELSE weight * ((budget - sum(CASE WHEN capped THEN full_at ELSE 0 END) OVER ())
                             / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target
  FROM flagged
), queued AS (
  SELECT s.*, source_size, source_rank, target, all_words,
         sum(size) OVER (PARTITION BY source_rank ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS so_far
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), entries AS (
  SELECT q.*, p.pass, (so_far + p.pass * source_size)::DOUBLE / target AS finish
  FROM queued q, (VALUES (0), (1)) p(pass) WHERE size > 0
), taken AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, key, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS words FROM entries
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.n, 0)::BIGINT AS taken
FROM queued q LEFT JOIN (SELECT doc_id, sum(size) AS n FROM taken WHERE words <= 1.5::DOUBLE * all_words GROUP BY doc_id) t USING (doc_id)
"""

"""Duplicates, ranks, budgets and splits by windows and grouped minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.sources.stored import stored


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``; rows with a null key pass through."""
    known = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    ranked = known.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return ranked.unionByName(df.where(" OR ".join(f"{k} IS NULL" for k in keys)))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dedup_chunks(chunks: DataFrame, cleaned: Column) -> DataFrame:
    """Within a document the first chunk of equal cleaned text; kept chunks of a page are numbered from 0."""
    own = chunks.withColumn("cleaned", cleaned)
    same = Window.partitionBy("document_id", F.xxhash64("cleaned"), "cleaned").orderBy("page_number", "chunk_index")
    kept = own.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return kept.withColumn("new_index", F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("chunk_index")) - 1)


def mark_duplicate_files(registry: DataFrame) -> DataFrame:
    """Files of equal checksum: the first by path is the master, the others are duplicates of it.

    A grouped minimum, stored, and an equi join of two exchanges, which Spark splits where a checksum is frequent (blank files have one);
    not a window."""
    first = stored(registry.groupBy("checksum_sha256").agg(F.min(F.struct("relative_path", "document_id")).alias("_first")))
    j = registry.join(first, "checksum_sha256")
    other = F.col("_first.document_id") != F.col("document_id")
    return j.select(*[c for c in registry.columns if c != "status"], F.when(other, "duplicate").otherwise(F.col("status")).alias("status"), F.when(other, F.col("_first.document_id")).alias("is_duplicate_of"))


def repeated(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Add ``_repeated``: whether an earlier row (by ``order``, unique) has the same key; false where the key is null or blank.

    A grouped minimum, combined before it moves and stored, and an equi join of two exchanges that Spark splits: no key is gathered in one task."""
    keyed = rows.withColumn("_key", F.when(F.trim(key) != "", key))
    first = stored(keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.min(order).alias("_first")))
    return keyed.join(first, "_key", "left").withColumn("_repeated", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_key", "_first")


def mark_duplicate_questions(rows: DataFrame, query: str = "query", order: str = "row_number") -> DataFrame:
    """Second and later rows of equal folded query; blank and null queries are no duplicates."""
    return repeated(rows, F.lower(F.trim(query)), order).withColumnRenamed("_repeated", "is_duplicate")


def ranked(hits: DataFrame, score: str = "score", tie: str = "chunk_id", key: str = "qid") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie)))


def top_k(hits: DataFrame, k: int, score: str = "score", tie: str = "chunk_id", key: str = "qid") -> DataFrame:
    """The ``k`` best of each query (the feature is a top list); Spark prunes each task's rows to k a query first."""
    return ranked(hits, score, tie, key).where(F.col("rank") <= k)


def best_per_document(hits: DataFrame) -> DataFrame:
    """First hit per (document, page) in rank order; then one a document: the first beyond page 1 if there is any."""
    doc = F.lower("document_name")
    one = hits.withColumn("_n", F.row_number().over(Window.partitionBy("qid", doc, "page_number").orderBy("rank"))).where("_n = 1")
    best = Window.partitionBy("qid", doc).orderBy((F.col("page_number") == 1).cast("int"), "rank")
    return one.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def context_budget(chunks: DataFrame, key: str, order: list, most: int = 3000) -> DataFrame:
    """Chunks in order while the running number of words stays within ``most``."""
    words = F.regexp_count(F.col("text"), F.lit(r"\S+"))
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("words", F.sum(words).over(w)).where(F.col("words") <= most)


def last_exchanges(turns: DataFrame, most: int = 10) -> DataFrame:
    """Per conversation: question turns with the answer that follows, the last ``most`` of them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'user' AND next_role = 'assistant'")
    return pairs.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= most).select("conv_id", "turn", F.col("text").alias("question"), "answer", "back")


def history(exchanges: DataFrame) -> DataFrame:
    """Questions of the kept exchanges, oldest first, one a line."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "question"))), lambda x: F.concat(F.lit("Q: "), x["question"]))
    return exchanges.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("history"))


def select_pages(pages: DataFrame, boilerplate: Column, low: Column, most: int = 3, least_chars: int = 1000) -> DataFrame:
    """Up to ``most`` pages a document: pages in the category's range first, then others, long and no boilerplate;
    where they are fewer, the longest pages fill up."""
    good = (F.length(F.trim("text")) > least_chars) & ~boilerplate
    w = Window.partitionBy("document_id").orderBy(good.desc(), F.when(good, (F.col("page_number") < low).cast("int")), F.when(~good, -F.length("text")), "page_number")
    return pages.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= most)


def assign_split(rows: DataFrame, key: str, stratum: str, ratios: tuple[float, float, float], seed: str = "7", digits: int = 4) -> DataFrame:
    """train, validation or test by ratio within each stratum, in the order of a seeded hash; ratios sum to 1 at most.

    Ranks have two levels: counts by the hash's first ``digits`` hex digits (65,536 rows a stratum at most), summed along,
    and a window within each of these small groups; so a stratum with most of the rows spreads over tasks. A null stratum is one."""
    if len(ratios) != 3 or sum(ratios) > 1 + 1e-9:
        raise ValueError("three ratios of a sum of at most 1 are needed")
    own = rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).withColumns({"_b": F.substring("_h", 1, digits), "_s": F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))})
    per = own.groupBy("_s", "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_s")
    before = per.withColumns({"_n": F.sum("_c").over(w), "_before": F.sum("_c").over(w.orderBy("_b")) - F.col("_c")}).drop("_c")
    ranked_rows = own.withColumn("_i", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key))).join(before, ["_s", "_b"])
    n, i = F.col("_n"), F.col("_before") + F.col("_i")
    first, second = F.floor(n * ratios[0]), F.floor(n * ratios[1])
    return ranked_rows.select(*rows.columns, F.when(i <= first, "train").when(i <= first + second, "validation").otherwise("test").alias("split"))

"""Joins of names, references, citations and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.sources.stored import shipped, stored

shipped(__name__)


def map_sources(golden: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct source names of valid rows with their registry entry by folded name (the first one), and is_indexed."""
    k = lambda c: F.lower(F.trim(c))
    names = golden.where("status = 'valid'").select(F.col("source_document"), k("source_document").alias("k")).distinct()
    reg = registry.groupBy(k("file_name").alias("k")).agg(F.min(F.struct("document_id", "category", "pages")).alias("r"))
    return names.join(reg, "k", "left").select("source_document", "r.document_id", "r.category", "r.pages", F.col("r").isNotNull().alias("is_indexed"))


def propagate_to_duplicates(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """Question rows, and a copy of a master's rows for each file that is marked as its duplicate."""
    dups = registry.where("is_duplicate_of IS NOT NULL").select(F.col("document_id").alias("copy"), F.col("is_duplicate_of").alias("document_id"))
    copies = questions.join(dups, "document_id").withColumn("document_id", F.col("copy")).drop("copy")
    return questions.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)))


#: Lengths of the grams that strings meet by: a string's are the longest that it has.
GRAMS = (8, 4, 2, 1)


def _grams(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, q, gram: the distinct strings of each length in ``q`` (an array) of a text; in one pass over its letters, a bounded number of rows at a time."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        held: tuple[list, list, list] = ([], [], [])

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (None, pa.int32(), pa.string()), strict=True)], [key, "q", "gram"])
            for c in held:
                c.clear()
            return made

        for batch in batches:
            for k, t, lengths in zip(*[batch.column(c).to_pylist() for c in ("key", "text", "q")], strict=True):
                for q in lengths:
                    for gram in {t[i : i + q] for i in range(len(t) - q + 1)}:
                        held[0].append(k)
                        held[1].append(q)
                        held[2].append(gram)
                        if len(held[0]) >= 20_000:
                            yield out()
        if held[0]:
            yield out()

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text"), "q").mapInArrow(run, f"{key} {kind}, q int, gram string")


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Pairs (needle, hay) of the distinct strings of two one-column tables where the hay contains the needle.

    Each needle is keyed by the rarest of its grams: strings of 8 letters (4, 2 or 1 for short needles). Hays give only grams that some needle has; these
    are counted, meet the needles that are keyed by them in an equi join, and the pair is verified. So a hay is held as often as it has letters, one length of
    gram at a time, and frequent grams are no keys unless a needle has nothing else. Empty needles are in every hay, which is a join with one row."""
    needles = needles.toDF("needle").where("needle IS NOT NULL").distinct()
    hays = hays.toDF("hay").where("hay IS NOT NULL").distinct().withColumn("_h", F.xxhash64("hay"))
    n, size = F.length("needle"), F.lit(None).cast("int")
    for q in reversed(GRAMS):
        size = F.when(n >= q, q).otherwise(size)
    own = stored(needles.select("needle", size.alias("q")))
    grams = stored(_grams(own.where("q IS NOT NULL").select("needle", F.array("q").alias("q")), "needle", "needle"))
    lengths = [r.q for r in grams.select("q").distinct().collect()]  # four at most
    wanted = stored(grams.select("q", "gram").distinct())
    pairs = hays.crossJoin(F.broadcast(own.where("q IS NULL").select("needle"))).select("needle", "hay")
    if not lengths:
        return pairs
    given = _grams(hays.withColumn("q", F.array(*[F.lit(q) for q in lengths])), "_h", "hay")
    given = stored(given.join(wanted, ["q", "gram"], "left_semi"))
    counts = stored(given.groupBy("q", "gram").agg(F.count("*").alias("n")))
    held = grams.join(counts, ["q", "gram"], "left")  # a gram that no hay has: nor does any have the needle
    keys = held.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "q", "gram")).alias("k")).where("k.n > 0").select("needle", "k.q", "k.gram")
    met = given.join(stored(keys), ["q", "gram"]).select("needle", "_h").join(hays, "_h")
    return met.where(F.col("hay").contains(F.col("needle"))).select("needle", "hay").unionByName(pairs)


def _first_two(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the first row by ``order`` and the first one of another document_id. The rows are read twice, so they are stored."""
    rows = stored(rows.select(key, F.struct(*order).alias("o")))
    first = stored(rows.groupBy(key).agg(F.min("o").alias("f")))
    second = rows.join(first, key).where("o.document_id <> f.document_id").groupBy(key).agg(F.min("o").alias("f"))
    return first.unionByName(second).select(key, "f.*")


def resolve_references(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct (source_id, matched) to a document: the first in order whose stem contains the folded text or is
    contained in it; else on normalised names where the text has 4 characters or more; never the source itself.

    Distinct texts meet distinct stems by equi joins on substrings (:func:`contained`), at any size. Since only the
    source itself is ruled out, the first two documents of a stem, and then of a text, are all that can be a target."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[ -]", "_")
    texts = stored(found.select("matched").distinct().withColumn("low", F.lower("matched")).withColumn("norm", fold("matched")))
    docs = documents.where("document_id IS NOT NULL").select("document_id", "ord", F.lower("stem").alias("stem"))
    docs = stored(_first_two(docs.where("stem IS NOT NULL"), "stem", ["ord", "document_id"]).withColumn("norm_name", fold("stem")))

    def pairs(text: str, name: str, own: DataFrame, of: DataFrame, number: int) -> DataFrame:
        t, n = own.select(text), of.select(name)
        both = contained(t, n).select(F.col("needle").alias(text), F.col("hay").alias(name))
        both = both.unionByName(contained(n, t).where("needle <> hay").select(F.col("hay").alias(text), F.col("needle").alias(name)))
        return own.join(both, text).join(of, name).select("matched", F.lit(number).alias("pass"), "ord", "document_id")

    cand = pairs("low", "stem", texts, docs, 1)
    # where folding changes neither text nor name, the second pass finds what the first one has found
    long, changed = texts.where(F.length("norm") >= 4), docs.where("norm_name <> stem")
    for own, of in ((long.where("norm <> low"), docs), (long.where("norm = low"), changed)):
        if not own.isEmpty() and not of.isEmpty():
            cand = cand.unionByName(pairs("norm", "norm_name", own, of, 2))
    cand = _first_two(cand, "matched", ["pass", "ord", "document_id"])
    first = F.min(F.struct("pass", "ord", "document_id"))
    j = found.select("source_id", "matched").distinct().join(cand, "matched").where("source_id <> document_id")
    return j.groupBy("source_id", "matched").agg(first.alias("f")).select("source_id", "matched", F.col("f.document_id").alias("target_id"), F.col("f.pass").alias("pass"))


def chunks_to_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.explode("chunk_ids").alias("chunk_id"))


def resolve_citations(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """Cited (document, page) to a hit of that document: the exact page if there is one, else the best rank;
    an unresolved citation keeps its page and has no snippet."""
    h = hits.select("qid", F.lower("document_name").alias("d"), F.col("page_number").alias("hit_page"), "rank", "text")
    j = citations.withColumn("d", F.lower("document")).join(h, ["qid", "d"], "left")
    best = F.min(F.struct((F.col("hit_page") != F.col("page")).cast("int").alias("other"), "rank", "hit_page", "text"))
    out = j.groupBy("qid", "document", "page").agg(best.alias("b"))
    return out.select("qid", "document", F.col("page").alias("cited_page"), F.coalesce("b.hit_page", "page").alias("page"), F.col("b.text").alias("snippet"))


def attach_chunks(citations: DataFrame, hits: DataFrame, most: int = 10) -> DataFrame:
    """Citation to one of the first ``most`` hits of its document: snippet contained, else same page, else same
    document; a hit on page 1 gives way to the best later page of that document."""
    h = hits.where(F.col("rank") <= most).select("qid", F.lower("document_name").alias("d"), F.col("page_number").alias("hit_page"), "rank", "text")
    j = citations.withColumn("d", F.lower("document")).join(h, ["qid", "d"])
    why = F.when(F.coalesce(F.col("text").contains(F.col("snippet")), F.lit(False)), 1).when(F.col("hit_page") == F.col("page"), 2).otherwise(3)
    w = Window.partitionBy("qid", "document", "page").orderBy((F.col("hit_page") == 1).cast("int"), "why", "rank")
    return j.withColumn("why", why).withColumn("n", F.row_number().over(w)).where("n = 1").select("qid", "document", "page", "hit_page", "why", "rank")


def verify_text(chunks: DataFrame, pages: DataFrame, width: int = 150) -> DataFrame:
    """Whether the letters and digits of a chunk's first ``width`` characters occur in its page's."""
    fold = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    p = pages.select("document_id", "page_number", fold("text").alias("page_text"))
    j = chunks.join(p, ["document_id", "page_number"], "left")
    return j.withColumn("verified", F.coalesce(F.col("page_text").contains(fold(F.substring("text", 1, width))), F.lit(False))).drop("page_text")


def mentioned_documents(answers: DataFrame, documents: DataFrame, key: list[str]) -> DataFrame:
    """Documents whose file name or stem is a token of an answer: tokens of the answers meet names by an equi join."""
    tokens = answers.select(*key, F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_.-]+"))).alias("t")).withColumn("t", F.regexp_replace("t", r"\.$", ""))
    names = documents.select("document_id", F.explode(F.array_distinct(F.array(F.lower("file_name"), F.regexp_replace(F.lower("file_name"), r"\.[^.]*$", "")))).alias("t"))
    return tokens.join(names, "t").select(*key, "document_id").distinct()


def passages_in(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """pid, tid, at (1 for the first character): the texts (tid, text) that hold a passage (pid, text), and where first.

    What stands between white space inside a passage stands so in a text that holds it. Texts give the words that are such inner words of some
    passage; these are counted, and the rarest inner word is the passage's key in an equi join; then the whole passage is looked for. Passages without
    an inner word meet texts by their rarest gram (:func:`contained`). Null and empty passages are in none."""
    split = lambda c: F.split(c, r"\s+")
    own = passages.where("text <> ''").select("pid", F.col("text").alias("passage"))
    inner = own.select("pid", F.explode(F.array_distinct(F.slice(split("passage"), 2, F.greatest(F.size(split("passage")) - 2, F.lit(0))))).alias("word")).where("word <> ''")
    inner = stored(inner)
    words = texts.select("tid", F.explode(F.array_distinct(split("text"))).alias("word"))
    given = stored(words.join(stored(inner.select("word").distinct()), "word", "left_semi"))
    counts = stored(given.groupBy("word").agg(F.count("*").alias("n")))
    keys = inner.join(counts, "word", "left").groupBy("pid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("k")).select("pid", "k.n", "k.word")
    keys = stored(keys)
    found = given.join(keys.where("n > 0"), "word").select("tid", "pid").join(own, "pid").join(texts, "tid")
    hits = found.withColumn("at", F.instr(F.col("text"), F.col("passage"))).where("at > 0").select("pid", "tid", "at")
    short = own.join(keys, "pid", "left_anti")
    if short.isEmpty():
        return hits
    whole = contained(short.select("passage"), texts.select("text"))
    rest = short.join(whole, F.col("passage") == F.col("needle")).join(texts, F.col("text") == F.col("hay"))
    return hits.unionByName(rest.select("pid", "tid", F.instr(F.col("text"), F.col("passage")).alias("at")))

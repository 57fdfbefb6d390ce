"""Extraction jobs over a text column, driven by pattern tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.sources.stored import shipped

shipped(__name__)


_TOKEN = re.compile(r"\\[bBdDwWsSAzZ]|\\.|\[(?:\\.|[^\]\\])*\]|\(\?[:i]?|.", re.S)


def required(pattern: str) -> tuple[str, ...]:
    """Strings in lower case of which every match of a pattern holds one (none: no such strings are known): the longest run of literal
    letters outside of optional parts (with and without an optional letter), or the runs of each alternative of a group. Of the syntax it knows groups, classes, ``|``, ``?*+{}`` and escapes."""
    tokens = _TOKEN.findall(pattern.removeprefix("(?i)"))
    at = 0

    def alternatives(inside: bool) -> list[tuple[str, ...]]:
        """For each alternative up to the closing bracket: its best literals."""
        nonlocal at
        out, best, run = [], (), {""}

        def better(new) -> None:
            nonlocal best
            new = tuple(sorted(x for x in new if not any(y != x and y in x for y in new)))
            if new and min(map(len, new)) > min(map(len, best), default=0):
                best = new

        while at < len(tokens):
            t = tokens[at]
            at += 1
            if t == ")" and inside:
                break
            if t == "|":
                better(run)
                out.append(best)
                best, run = (), {""}
                continue
            group = None
            if t.startswith("("):
                found = alternatives(True)
                group = tuple(x for a in found for x in a) if all(found) else ()
            times = tokens[at] if at < len(tokens) and tokens[at] in ("?", "*", "+", "{") else ""
            if times == "{":
                end = tokens.index("}", at)
                times = "*" if tokens[at + 1] == "0" else "+"
                at = end + 1
            elif times:
                at += 1
            if times and at < len(tokens) and tokens[at] == "?":
                at += 1
            letter = t if group is None and len(t) == 1 and t not in ".^$" else t[1] if t[0] == "\\" and not t[1].isalnum() else ""
            if letter and times in ("", "?") and len(run) <= 8:
                run = {x + letter.lower() for x in run} | (run if times else set())
                continue
            if letter and times == "+":
                run = {x + letter.lower() for x in run}
            if t not in ("\\b", "\\B"):
                better(run)
                run = {""}
            if group and times in ("", "+"):
                better(group)
        better(run)
        out.append(best)
        return out

    found = alternatives(False)
    return tuple(dict.fromkeys(x for a in found for x in a)) if all(found) else ()


def matches(rows: DataFrame, key: str, patterns, text: str = "text") -> DataFrame:
    """key, matched, kind, confidence, p (the pattern's number), i (the match's number): every match of every pattern.

    One narrow pass: the patterns are literals, so a row is read once and no join is needed. A pattern runs only where one of the strings that
    it needs (:func:`required`) stands in the text's lower case, which is a search for a few letters instead of a match from every place."""
    none = F.array().cast("array<string>")

    def of(n: int, pattern: str, kind: str, confidence: float):
        one = lambda m, i: F.struct(F.trim(m).alias("matched"), F.lit(kind).alias("kind"), F.lit(float(confidence)).alias("confidence"), F.lit(n).alias("p"), i.alias("i"))
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), 0)
        needed = [F.col("_low").contains(s) for s in required(pattern)]
        if needed:
            found = F.when(reduce(Column.__or__, needed), found).otherwise(none)
        return F.transform(found, one)

    found = [of(n, *p) for n, p in enumerate(patterns)]
    own = rows.select(key, text, F.lower(text).alias("_low"))
    return own.select(key, F.explode(F.flatten(F.array(*found))).alias("m")).select(key, "m.*")


def distinct_matches(found: DataFrame, key: str, by_kind: bool = True) -> DataFrame:
    """The first match of each folded text (and kind) of a row; white space counts as one space."""
    own = found.withColumn("folded", F.lower(F.regexp_replace("matched", r"\s+", " ")))
    keys = [key, "kind", "folded"] if by_kind else [key, "folded"]
    first = own.groupBy(*keys).agg(F.min(F.struct("p", "i", "matched", "confidence", F.col("kind").alias("k"))).alias("f"))
    return first.select(key, "f.matched", F.col("f.k").alias("kind"), "f.confidence", "folded", "f.p", "f.i")


def entities(rows: DataFrame, key: str, patterns, most: int = 30) -> DataFrame:
    """Distinct matches per kind, by falling confidence, then pattern and place; the first ``most`` of a row."""
    d = distinct_matches(matches(rows, key, patterns), key)
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "p", "i")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def sections(rows: DataFrame, key: str, patterns, least: int = 3) -> DataFrame:
    """Distinct matches of at least ``least`` characters, numbered in order."""
    d = distinct_matches(matches(rows, key, patterns), key, by_kind=False).where(F.length("folded") >= least)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("p", "i")))


def relations(rows: DataFrame, key: str, patterns, least: float = 0.4) -> DataFrame:
    """(kind, target, confidence) of at least ``least``, distinct per kind."""
    return distinct_matches(matches(rows, key, patterns).where(F.col("confidence") >= least), key)


def knowledge_chunks(rows: DataFrame, key: str, entity_patterns, section_patterns, reference_patterns, keywords: DataFrame, least: int = 5) -> DataFrame:
    """Each row of at least ``least`` characters with arrays of its entities, sections, relations and keywords."""
    own = rows.where(F.length(F.trim("text")) >= least)
    lists = {
        "entities": entities(own, key, entity_patterns).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "matched", "kind", "confidence"))).alias("entities")),
        "sections": sections(own, key, section_patterns).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "matched"))).alias("sections")),
        "relations": relations(own, key, reference_patterns).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("kind", "matched", "confidence"))).alias("relations")),
        "keywords": keywords.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("keywords")),
    }
    out = own.select(key, "document_id", "category")
    for name, side in lists.items():
        out = out.join(side, key, "left").withColumn(name, F.coalesce(name, F.array().cast(side.schema[name].dataType)))
    return out


def active_heading(chunks: DataFrame, headings: DataFrame, key: list[str]) -> DataFrame:
    """Each chunk with the last heading whose offset is at or before its own: a union of both along the offset."""
    cols = [*key, "offset"]
    both = headings.select(*cols, F.col("heading"), F.lit(0).alias("is_chunk"), F.lit(None).cast("string").alias("text")).unionByName(chunks.select(*cols, F.lit(None).cast("string").alias("heading"), F.lit(1).alias("is_chunk"), "text"))
    w = Window.partitionBy(*key).orderBy("offset", "is_chunk").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("heading", F.last("heading", ignorenulls=True).over(w)).where("is_chunk = 1")
    return out.select(*cols, "text", "heading", F.when(F.col("heading").isNull(), F.col("text")).otherwise(F.concat(F.lit("["), "heading", F.lit("] "), "text")).alias("prefixed"))


def sentence_candidates(pages: DataFrame, key: list[str], keywords: tuple[str, ...], marks: tuple[str, ...] = ()) -> DataFrame:
    """Sentences of 100 to 280 characters that start in upper case, with the number of keyword hits, best first."""
    s = pages.select(*key, F.posexplode(F.split(F.regexp_replace(F.substring("text", 1, 2000), r"\s+", " "), r"(?<=[.!?])\s+")).alias("pos", "sentence"))
    s = s.withColumn("sentence", F.trim("sentence")).where(F.length("sentence").between(100, 280) & F.col("sentence").rlike(r"^\p{Lu}"))
    for m in marks:
        s = s.where(~F.upper("sentence").contains(m))
    hits = F.regexp_count(F.lower("sentence"), F.lit("|".join(keywords)))
    return s.withColumn("hits", hits).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("hits"), "pos")))


def question_rows(sentences: DataFrame, key: list[str], templates: dict[str, str], default: str) -> DataFrame:
    """A question, answer and citation from the best sentence of each page; the template goes by category."""
    best = sentences.where("rank = 1")
    words = F.array_join(F.slice(F.split("sentence", " "), 1, 6), " ")
    q = F.lit(default)
    for category, text in templates.items():
        q = F.when(F.col("category") == category, F.lit(text)).otherwise(q)
    return best.select(*key, F.replace(q, F.lit("{topic}"), words).alias("query"), F.col("sentence").alias("expected_answer"), F.format_string("%s, page %d", F.col("document_name"), F.col("page_number")).alias("citation"))


def split_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[tuple[int, str]]:
    """(start, piece) of a text: pieces of at most ``size`` characters at the first separator that helps, neighbours
    sharing up to ``overlap`` characters; the separator stays at the start of the piece that follows it."""

    def cut(at: int, part: str, seps: tuple[str, ...]) -> list[tuple[int, str]]:
        if len(part) <= size:
            return [(at, part)]
        sep = next((s for s in seps if s and s in part), "")
        if not sep:
            return [(at + i, part[i : i + size]) for i in range(0, len(part), size)]
        out, pos = [], 0
        for i, piece in enumerate(part.split(sep)):
            piece = piece if i == 0 else sep + piece
            if piece:
                out += cut(at + pos, piece, seps[seps.index(sep) + 1 :])
            pos += len(piece)
        return out

    done: list[tuple[int, str]] = []
    held: list[tuple[int, str]] = []
    total = 0
    for at, piece in cut(0, text, separators):
        if held and total + len(piece) > size:
            done.append((held[0][0], "".join(p for _, p in held)))
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0)[1])
        held.append((at, piece))
        total += len(piece)
    if held:
        done.append((held[0][0], "".join(p for _, p in held)))
    out = []
    for at, piece in done:
        lead = len(piece) - len(piece.lstrip())
        if piece.strip():
            out.append((at + lead, piece.strip()))
    return out


def recursive_split(pages: DataFrame, key: list[str], size: int = 1800, overlap: int = 230, separators: tuple[str, ...] = ("\n\n", ". ", "\n", " "), text: str = "text") -> DataFrame:
    """Pages to overlapping chunks: key columns, pos, start, text; one Arrow pass over pages, which stay spread."""
    import pyarrow as pa

    kinds = {f.name: f for f in pages.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k].dataType.simpleString()}" for k in key), "pos int", "start int", "text string"])

    def run(batches):
        for batch in batches:
            rows = [(n, i, s, t) for n, page in enumerate(batch.column(text).to_pylist()) for i, (s, t) in enumerate(split_pieces(page or "", size, overlap, separators))]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in key], pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())], [*key, "pos", "start", "text"])

    return pages.select(*key, text).mapInArrow(run, schema)

"""Licence scans: canonical digests of whole texts and of their lines, joined to known licences; no Python."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import cut, table, text_or_empty

#: Spellings that count as equal (fixed values), as words in lower case without punctuation: each left one becomes the right one, in this order.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("sub license", "sublicense"), ("sub licenses", "sublicenses"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
    ("https", "http"), ("version 2 0", "version 2"), ("version 3 0", "version 3"), ("v2 0", "version 2"), ("v3 0", "version 3"),
)

#: Known licences by the texts of their notices (fixed values); further and longer texts are a parameter.
KNOWN = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Apache License 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "GNU General Public License v3.0"), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Copyright lines: by a sign, a year, a placeholder or a name. A line of a licence's own text that merely begins with the word
#: (as "copyright notice") stays, so that it does not matter where a text is wrapped.
NOTICE = r"^[ \t]*(?:(?i:copyright)[ \t]*(?:\([cC]\)|©|[0-9<\[])|\([cC]\)|©|Copyright[ \t]+(?:by[ \t]+)?\p{Lu})[^\n]*$|(?i:all[ \t\r\n\f]+rights[ \t\r\n\f]+reserved)\.?"
#: Titles that copies of a text may begin with (fixed values).
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License")}


def known_texts() -> list[tuple[str, str]]:
    """license_id, text of the full licence texts in ``license_texts``: with and without their title or what follows
    their terms, and for BSD with and without numbers and with one or more copyright holders."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        forms, name = [path.read_text(encoding="utf-8")], path.name.removesuffix(".txt")
        terms, end, _ = forms[0].partition("END OF TERMS AND CONDITIONS")
        forms += [terms + end, terms] if end else []
        if name.startswith("BSD"):
            forms += [re.sub(r"(?m)^\d\. ", "* ", t) for t in forms]
            forms += [t.replace("HOLDER OR", "HOLDERS OR") for t in forms]
        out += [(name, t) for t in forms] + [(name, f"{title}\n\n{t}") for title in TITLES.get(name, ()) for t in forms]
    return out


def canonical(c: Column) -> Column:
    """Without copyright lines, lower case, words of letters and digits alone, equal spellings made one: the words, joined by
    one space, however the text is wrapped or punctuated. Spellings are replaced as whole words: each word stands
    between two spaces of its own meanwhile."""
    words = F.regexp_replace(F.lower(F.regexp_replace(c, f"(?md){NOTICE}", "")), r"[^\p{L}\p{N}]+", "  ")
    out = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_licenses(spark: SparkSession, known=KNOWN) -> DataFrame:
    """digest, license_id of the known texts (license_id, text); one row per distinct digest, the smallest id of several.
    Texts without letters and digits are no licence; an empty list gives no rows."""
    rows = spark.createDataFrame(list(known), "license_id string, text string").select("license_id", canonical(F.col("text")).alias("c"))
    return rows.where("c <> ''").select(F.sha2("c", 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame, most_known: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, text_digest, license_id (the whole text's by its digest, else null), n_notices (lines
    that are a known text), notices (their distinct licences, sorted, joined by a comma; '' if none).

    ``known`` (digest, license_id) is broadcast only up to ``most_known`` rows, else Spark joins by digest. Texts
    never leave the task that reads them; only digests do. Null text is empty and matches nothing (nor does any
    text without letters and digits); null ids and repeated rows keep rows of their own; other columns are
    ignored; an empty table gives no rows.
    """
    small = known.count() <= most_known
    side = F.broadcast(known) if small else known
    lines = F.filter(F.transform(F.split(text_or_empty(), "\n"), canonical), lambda x: x != "")
    whole = canonical(text_or_empty())
    own = docs.select("doc_id", F.sha2(whole, 256).alias("text_digest"), F.transform(lines, lambda x: F.unhex(F.sha2(x, 256))).alias("_lines"))
    own = cut(own.withColumn("_row", F.monotonically_increasing_id()))
    found = own.select("_row", F.explode("_lines").alias("_d")).select("_row", F.lower(F.hex("_d")).alias("digest")).join(side, "digest")
    found = found.groupBy("_row").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    out = own.drop("_lines").join(side, F.col("text_digest") == F.col("digest"), "left").drop("digest").join(found, "_row", "left")
    return out.select("doc_id", "text_digest", "license_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """:func:`license_scan` of all ``documents`` for notices and full licence texts; nulls and empty tables as there."""
    return license_scan(table(spark, sf_dir, "documents"), known_licenses(spark, [*KNOWN, *known_texts()]))


def _sql_canonical(c: str) -> str:
    out = f"' ' || trim(regexp_replace(lower(regexp_replace({c}, '(?m){NOTICE}', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
    for a, b in EQUIVALENT:
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


def words_of(text: str) -> str:
    """The same as :func:`canonical`, word by word in plain Python: for the SQL's table of full texts, and for tests."""
    kept = regex.sub(r"(?i)all[ \t\r\n\f]+rights[ \t\r\n\f]+reserved\.?", "", "\n".join("" if regex.match(NOTICE.split("[^\\n]*$")[0], line) else line for line in text.split("\n")))
    words = regex.findall(r"[\p{L}\p{N}]+", kept.lower())
    for a, b in EQUIVALENT:
        own, out, at = a.split(" "), [], 0
        while at < len(words):
            hit = words[at : at + len(own)] == own
            out += b.split(" ") if hit else [words[at]]
            at += len(own) if hit else 1
        words = out
    return " ".join(words)


_TEXTS = sorted({(name, hashlib.sha256(words_of(text).encode()).hexdigest()) for name, text in known_texts()})
OP6_SQL = f"""
WITH known AS (
  SELECT digest, min(l) AS license_id FROM (
    SELECT l, sha256({_sql_canonical('t')}) AS digest FROM (VALUES {', '.join(f"('{i}', '{t}')" for i, t in KNOWN)}) k(l, t)
    UNION ALL VALUES {', '.join(f"('{i}', '{d}')" for i, d in _TEXTS)}
  ) GROUP BY digest
), d AS (
  SELECT doc_id, sha256({_sql_canonical("coalesce(text, '')")}) AS text_digest FROM documents
), lines AS (
  SELECT doc_id, {_sql_canonical('line')} AS c FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
), found AS (
  SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices
  FROM lines JOIN known ON digest = sha256(c) WHERE c <> '' GROUP BY doc_id
)
SELECT d.doc_id, text_digest, license_id, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN known ON digest = text_digest LEFT JOIN found f ON f.doc_id = d.doc_id
"""

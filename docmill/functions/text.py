"""Column functions on texts, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"(?U)\s+"


def chunk_id(document_id: Column, page: Column, index: Column) -> Column:
    """``<prefix>_PAGE%03d_CHUNK%03d``; prefix: the id up to its first ``-``, or its first 8 characters if it has none.

    Ids that share a prefix collide: for display only, joins use (document, page, index)."""
    prefix = F.when(document_id.contains("-"), F.substring_index(document_id, "-", 1)).otherwise(F.substring(document_id, 1, 8))
    return F.format_string("%s_PAGE%03d_CHUNK%03d", prefix, page.cast("int"), index.cast("int"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, half to even, at least 1; 0 for an empty or null text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / 4).cast("int")))


def clean_chunk_text(text: Column) -> Column:
    """Trimmed; three or more line feeds become two, three or more spaces one."""
    return F.regexp_replace(F.regexp_replace(F.trim(text, F.lit(" \t\r\n")), r"\n{3,}", "\n\n"), r" {3,}", " ")


@F.pandas_udf(T.StringType())
def _nfc(s):
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def clean_query(query: Column, lowercase: bool = False, compose: bool = True) -> Column:
    """Trimmed, composed (NFC, by Arrow batches), without control characters, white space collapsed."""
    out = _nfc(query) if compose else query
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.trim(F.regexp_replace(out, SPACES, " "))
    return F.lower(out) if lowercase else out


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name: SHA-1 with the version and variant digits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: Name spaces of version 5 UUIDs (fixed values).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def document_id(checksum: Column, relative_path: Column) -> Column:
    return uuid5(NAMESPACE_URL, F.concat(checksum, F.lit("::"), relative_path))


def point_id(chunk: Column) -> Column:
    return uuid5(NAMESPACE_DNS, chunk)


def node_id(document_name: Column) -> Column:
    return F.concat(F.lit("node_"), F.substring(F.sha2(document_name, 256), 1, 12))


def record_id(query: Column, source: Column) -> Column:
    folded = F.concat(F.lower(F.trim(query)), F.lit("|"), F.lower(F.trim(source)))
    return F.substring(F.sha2(folded, 256), 1, 12)


def knowledge_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"okf_{kind}_"), F.substring(F.sha2(key, 256), 1, 12))


def stem(file_name: Column) -> Column:
    """A file name without folders and its last extension."""
    base = F.element_at(F.split(file_name, "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def derive_title(file_name: Column) -> Column:
    """Stem with ``_`` and ``-`` as spaces; letters after any non-letter in upper case, others in lower case."""
    words = F.trim(F.regexp_replace(F.regexp_replace(stem(file_name), "[_-]", " "), SPACES, " "))
    runs = F.regexp_extract_all(words, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def detect_category(path: Column, root: str) -> Column:
    """First folder below ``root``."""
    return F.nullif(F.regexp_extract(path, rf"{root}/([^/]+)/", 1), F.lit(""))


def relative_path(path: Column, root: str) -> Column:
    return F.regexp_replace(path, rf"^.*?{root}/", "")


def human_size(size: Column, places: int = 2) -> Column:
    """Steps of 1024 from Bytes to TB."""
    out, units = None, ["Bytes", "KB", "MB", "GB", "TB"]
    for i, unit in enumerate(units):
        shown = F.format_string(f"%.{places}f {unit}", F.bround(size.cast("double") / float(1024**i), places))
        out = F.when(size < 1024 ** (i + 1), shown) if out is None else out.when(size < 1024 ** (i + 1), shown) if i < 4 else out.otherwise(shown)
    return out


def size_mb(size: Column) -> Column:
    return F.round(size / F.lit(1024.0 * 1024.0), 3)


def sanitize_text(value: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(F.trim(value), F.lit(""))


def sanitize_page(value: Column) -> Column:
    """Whole part of a number in a text, if positive."""
    n = F.trim(value).try_cast("double").cast("int")
    return F.when(n > 0, n)


def summary_text(text: Column, most: int = 250) -> Column:
    """White space folded; longer texts are cut at the last space before ``most`` and get an ellipsis."""
    t = whitespace_fold(text)
    head = F.substring(t, 1, most)
    at_space = F.regexp_extract(head, r"^(.+) ", 1)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(at_space != "", at_space).otherwise(head), F.lit("…")))


def truncate(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def normalize_doc_name(name: Column) -> Column:
    """Lower case without ``.pdf`` and without volume and version suffixes."""
    n = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit(".pdf"), F.lit(""))
    n = F.regexp_replace(n, r"(_|-)?vol(ume)?_?\d+", "")
    return F.trim(F.regexp_replace(n, r"(_|-)?v_?\d+", ""))


def slice_and_normalize(vector: Column, width: int) -> Column:
    """First ``width`` components at length 1; a zero vector stays as it is."""
    head = F.transform(F.slice(vector, 1, width), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(head, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def round_half_away(x: Column, digits: int) -> Column:
    """A double times a power of ten, rounded to whole numbers with halves away from 0, and divided by it, as SQL engines do on doubles and Spark, which rounds
    the decimal text, does not. What is negative stays so: the small ones become -0.0."""
    scaled = F.abs(x) * F.lit(10.0**digits)
    low = F.floor(scaled).cast("double")
    whole = F.when(scaled - low >= 0.5, low + F.lit(1.0)).otherwise(low) / F.lit(10.0**digits)
    return F.when(x < 0, F.negative(whole)).otherwise(F.when(x.isNotNull() & ~F.isnan(x), whole).otherwise(x))


def whitespace_fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def page_number_resolve(page_number: Column, page: Column, meta_page: Column, strict: bool = False) -> Column:
    """First of the three that is neither null nor 0; null, or an error when ``strict``, if none is."""
    found = F.coalesce(*[F.nullif(c.cast("int"), F.lit(0)) for c in (page_number, page, meta_page)])
    return F.coalesce(found, F.raise_error(F.lit("no page number")).cast("int")) if strict else found


def page_gap_score(page: Column, expected: Column) -> Column:
    """1.0, 0.95 or 0.85 for a gap of 0, 1 or 2 pages, else 0.5."""
    gap = F.abs(page - expected)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.95).when(gap == 2, 0.85).otherwise(0.5)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)

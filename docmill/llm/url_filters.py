"""URLs judged by rules and by the templates of their paths: a tree per host, whose templates are accepted by the share of good labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import ascii_lower, cut, drop, packed, table

#: verdict, host, path: a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rules that one expression may hold.
MOST_RULES = 1000
#: Endings of file names that a wildcard keeps (fixed values).
ENDINGS = "html?|php|aspx?|jsp|pdf|xml|json|txt"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and the path then up to ``?``, ``#`` or the end;
    both empty for null and where there is no ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)")), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path), and its verdict; null if none does. Of equally long ones that of the longer host."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def segments(path: Column, depth: int) -> Column:
    """The path's parts between slashes, the first ``depth``; what lies deeper is ``**``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.concat(F.slice(parts, 1, depth), F.when(F.size(parts) > depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")))


def wildcard(segment: Column) -> Column:
    """What a variable segment looks like: a number, a hexadecimal name, one with digits, or a word; with a usual file ending."""
    ending = F.regexp_extract(segment, rf"(?i)(\.(?:{ENDINGS}))$", 1)
    stem = F.regexp_replace(segment, rf"(?i)\.(?:{ENDINGS})$", "")
    kind = F.when(stem.rlike(r"^[0-9][0-9_.:-]*$"), "{number}").when(stem.rlike("^(?i)[0-9a-f-]{8,}$"), "{hex}").when(stem.rlike("[0-9]"), "{mixed}").otherwise("{word}")
    return F.concat(kind, F.lower(ending))


def _alike(a: Column, b: Column, z: float) -> Column:
    """Whether shares of good labels, and of URLs that end here, of two branches don't differ at level ``z`` (two proportions)."""

    def same(k: str, n: str) -> Column:
        x, y, m, o = a[k], b[k], F.greatest(a[n], F.lit(1)), F.greatest(b[n], F.lit(1))
        p = (x + y) / (m + o)
        return (a[n] == 0) | (b[n] == 0) | (F.pow(x / m - y / o, 2) * m * o <= z * z * p * (1 - p) * (m + o))

    return same("good", "labelled") & same("ends", "n")


_GROUP = "array<struct<n:long,labelled:long,good:long,ends:long,names:array<string>>>"


def _grouped(branches: Column, z: float) -> Column:
    """Branches of a node, in order, with those alike merged with the ones before."""

    def add(groups: Column, b: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        both = F.struct(*[(last[c] + b[c]).alias(c) for c in ("n", "labelled", "good", "ends")], F.concat(last["names"], b["names"]).alias("names"))
        rest = F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0)))
        return F.when(F.coalesce(_alike(last, b, z), F.lit(False)), F.concat(rest, F.array(both))).otherwise(F.concat(groups, F.array(b)))

    return F.aggregate(branches, F.array().cast(_GROUP), add)


def _level(urls: DataFrame, d: int, share: float, least: int, z: float, weight: float) -> DataFrame:
    """host, template, names, to: where the segments of level ``d`` lead from each node (a map of name to template and purity).

    Names with ``share`` of their node's URLs and ``least`` at least are branches of their own, so a node has a bounded number of them;
    others are wildcards. Counts are summed before they move, and a host of any size is only counts then."""
    s = F.get("segments", F.lit(d))
    kids = urls.where(F.size("segments") > d).groupBy("host", "template", s.alias("segment"))
    kids = kids.agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("good"), F.count_if(F.size("segments") == d + 1).alias("ends"), F.max("purity").alias("purity"))
    kids = cut(kids)
    total = cut(kids.groupBy("host", "template").agg(F.sum("n").alias("all")))
    own = (F.col("n") >= share * F.col("all")) & (F.col("n") >= least) | (F.col("segment") == "**")
    named = kids.join(total, ["host", "template"]).withColumn("name", F.when(own, F.col("segment")).otherwise(wildcard(F.col("segment"))))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good", "ends")]
    branches = named.groupBy("host", "template", "name").agg(*sums, F.max("purity").alias("purity"))
    order = [(F.col("ends") * 2 >= F.col("n")).alias("leaf"), ((F.col("good") + 1) / (F.col("labelled") + 2)).alias("p"), F.col("name")]
    struct = F.struct("n", "labelled", "good", "ends", F.array("name").alias("names"))
    nodes = branches.groupBy("host", "template").agg(F.max("purity").alias("purity"), F.sort_array(F.collect_list(F.struct(*order, struct.alias("b")))).alias("list"))
    groups = nodes.select("host", "template", "purity", F.explode(_grouped(F.col("list.b"), z)).alias("g"))
    label = F.when(F.size("g.names") == 1, F.col("g.names")[0]).otherwise(F.concat(F.lit("{"), F.array_join(F.array_sort("g.names"), "|"), F.lit("}")))
    to = F.struct(F.concat("template", F.lit("/"), label).alias("t"), ((F.col("g.good") + weight * F.col("purity")) / (F.col("g.labelled") + weight)).alias("p"))
    pairs = groups.select("host", "template", to.alias("to"), "g.names").select("host", "template", "to", F.explode("names").alias("name"))
    out = cut(pairs.groupBy("host", "template").agg(F.map_from_entries(F.collect_list(F.struct("name", "to"))).alias("to")))
    drop(kids, total)
    return out


def judge(urls: DataFrame, rules=RULES, threshold: float = 0.5, depth: int = 6, share: float = 0.02, least: int = 5, z: float = 1.64, weight: float = 8.0) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block), template and purity to every row of ``urls`` (url; label: 1 good, 0 bad, null
    unknown). The longest rule that fits decides; else the URL's template, which is rejected if its purity is below ``threshold``.

    A tree of path segments per host, built level by level: a node's frequent segments are its branches, the others wildcards
    by their looks; branches whose shares of good labels and of ends don't differ significantly (``z``) are merged. A template's purity is its
    share of good labels with its parent's as ``weight`` more labels, the host's with that of all hosts, which starts at one half.
    Segments beyond ``depth`` are one (``**``), so there are at most depth + 1 levels, however long a URL is.

    Null URLs and such without ``://`` have the empty host and path; all hosts, the empty one too, have a tree. Repeated rows and null ids keep rows of
    their own; other columns stay, those of the added names are replaced; without labels purity is one half, which is accepted; an empty table gives no rows."""
    names = ["host", "path", "rule", "verdict", "template", "purity"]
    own = urls.drop(*names)
    if "label" not in own.columns:
        own = own.withColumn("label", F.lit(None).cast("int"))
    rows = packed(own).withColumn("_u", F.col("_doc.url"))
    host, path = host_and_path(F.col("_u"))
    rows = cut(rows.select("_doc", F.col("_doc.label").cast("long").alias("label"), host.alias("host"), path.alias("path")).withColumn("segments", segments(F.col("path"), depth)))
    deepest, labelled, good = rows.agg(F.max(F.size("segments")), F.count("label"), F.sum("label")).first()
    prior = ((good or 0) + 1) / (labelled + 2)
    hosts = cut(rows.groupBy("host").agg(((F.coalesce(F.sum("label"), F.lit(0)) + weight * prior) / (F.count("label") + weight)).alias("purity")))
    walked = cut(rows.join(hosts, "host").withColumn("template", F.lit("")))
    drop(rows, hosts)
    for d in range(deepest or 0):
        tree = _level(walked, d, share, least, z, weight)
        s = F.get("segments", F.lit(d))
        found = F.when(F.size("segments") > d, F.coalesce(F.try_element_at("to", s), F.try_element_at("to", wildcard(s))))
        step = walked.join(tree, ["host", "template"], "left").withColumn("_to", found)
        step = step.select("_doc", "label", "host", "path", "segments", F.coalesce("_to.t", "template").alias("template"), F.coalesce("_to.p", "purity").alias("purity"))
        before, walked = walked, cut(step)
        drop(before, tree)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("purity") < threshold, "block").otherwise("allow")
    out = walked.select("_doc", F.struct("host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), F.concat("host", "template").alias("template"), "purity").alias("_j"))
    return out.select("_doc.*", "_j.*")


def op11_url_filters(spark, sf_dir: str) -> DataFrame:
    """:func:`judge` of all ``pages``. A page is labelled where ``labels`` knows the document whose number ends its path: good if of quality and not
    toxic. Nulls, repeated rows and empty tables as there."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("_u", F.col("url"))
    number = F.regexp_extract(host_and_path(F.col("_u"))[1], r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.min("quality") * (1 - F.max("toxic"))).alias("label"))
    urls = pages.select("page_id", "url", F.when(number != "", number).cast("long").alias("doc_id")).join(labels, "doc_id", "left")
    return judge(urls.select("page_id", "url", "label")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")

"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html as htmllib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import cut, shipped, table

shipped(__name__)

# Fixed values of HTML and of common page templates.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template iframe object embed svg math canvas audio video select option button textarea form head title nav aside footer dialog menu noembed noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NOISE = frozenset("ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager masthead topbar footer comments comment commentlist respond replies reply disqus share sharing social related recommended recommendations toolbar skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[^a-z]+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): htmllib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def events(html: str):
    """("start", tag, attributes), ("end", tag, None) and ("text", text, None) of a page; comments are left out."""
    at = 0
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            yield "text", html[at : m.start()], None
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            yield "end", tag, None
            continue
        rest = m[3] if m[2] else m[6]
        yield "start", tag, attributes(rest or "")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else len(html)
    if at < len(html):
        yield "text", html[at:], None


def label(tag: str, a: dict[str, str]) -> str:
    """What nodes are matched by: the tag and the first class or the id, without digits."""
    name = (a.get("class") or a.get("id") or "").split()
    return f"{tag}.{re.sub(r'[0-9]+', '', name[0].lower())}" if name else tag


def noise(tag: str, a: dict[str, str], in_article: bool) -> bool:
    """Whether an element is no main text by its meaning: menus, adverts, notices, forms, comments and the like."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not a or tag in ("html", "body", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    parts = set(_PARTS.split(f"{a.get('class', '')} {a.get('id', '')}".lower()))
    return bool(parts & NOISE) or "header" in parts and not in_article and tag not in HEADINGS


class Node:
    """An element of a page with like siblings folded into one: its path (a hash), own text, and what its subtree holds."""

    __slots__ = ("path", "parent", "depth", "holds", "heading", "children", "text", "mass", "heads")

    def __init__(self, path: int, parent: Node | None, tag: str):
        self.path, self.parent, self.depth, self.holds, self.heading = path, parent, parent.depth + 1 if parent else 0, tag in CONTAINERS, tag in HEADINGS
        self.children, self.text, self.mass, self.heads = {}, [], 0, 0


#: Elements that may be the slot of a page's main text.
CONTAINERS = frozenset("article center div main section table tbody td tr".split())
_PATHS: dict[tuple[int, str], int] = {}


def below(path: int, name: str) -> int:
    """The path of the children of that label; a task remembers some."""
    found = _PATHS.get((path, name))
    if found is None:
        found = xxhash.xxh64_intdigest(f"{path}/{name}") >> 1
        if len(_PATHS) < 50_000:
            _PATHS[path, name] = found
    return found


NONE: frozenset[int] = frozenset()


def walk(html: str, slot: int | None = None, inside_slot: frozenset[int] = NONE, elsewhere: frozenset[int] = NONE, tree: bool = False):
    """One pass over a page: its blocks as (text, in the slot, in an article), and the nodes of its tree (parents first)
    if asked for, menus, scripts, noise and the like left out. ``slot``, ``inside_slot`` and ``elsewhere`` are paths of the
    host's wrapper: the main text's container, and whose text is template in and outside it."""
    root = Node(0, None, "")
    #: tag, node, path, dropped, in the slot, in an article, only headings count
    stack = [("", root, 0, False, False, False, False)]
    blocks, line, where = [], [], (False, False)
    nodes = [root]

    def flush():
        nonlocal line
        if line:
            text = " ".join("".join(line).split())
            if text:
                blocks.append((text, *where))
            line = []

    def close(tags, limits=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in limits:
                return

    for kind, tag, a in events(html):
        if kind == "text":
            _, node, path, gone, inside, article, headed = stack[-1]
            if gone:
                continue
            if tree and tag.strip():
                node.text.append(tag)
            if not headed and path not in (inside_slot if inside else elsewhere):
                line.append(htmllib.unescape(tag))
                where = (inside, article)
        elif kind == "start":
            if tag == "br":
                line.append(" ")
                continue
            if tag in BLOCKS:
                flush()
                close(("p",), ("div", "article", "section", "main", "body", "td", "li", "blockquote"))
                if tag in CLOSES:
                    close(CLOSES[tag], LIMITS[tag])
            if tag in VOID:
                continue
            _, node, path, gone, inside, article, headed = stack[-1]
            now = article or tag in ("article", "main") or a.get("role") in ("main", "article")
            gone = gone or noise(tag, a, article if tag == "header" else now)
            path = below(path, label(tag, a))
            if tree and not gone:
                child = node.children.get(path)
                if child is None:
                    child = node.children[path] = Node(path, node, tag)
                    nodes.append(child)
                node = child
            if tag == "header" and article:
                headed = True
            if headed and tag in HEADINGS:
                headed = False
            stack.append((tag, node, path, gone, inside or path == slot, now, headed))
        else:
            if tag in BLOCKS or tag == "br":
                flush()
            if tag == "p" and all(s[0] != "p" for s in stack):
                continue
            close((tag,))
    flush()
    return blocks, nodes


def main_text(html: str | None, slot: int | None = None, inside_slot: frozenset[int] = NONE, elsewhere: frozenset[int] = NONE) -> str:
    """Blocks of the wrapper's slot without the template's text, joined by one line feed. A page that has not that slot, or a host
    without one: the blocks of what the page marks as its article, or of all that is left where it marks none."""
    blocks, _ = walk(html or "", slot, inside_slot, elsewhere)
    return "\n".join([t for t, i, _ in blocks if i] or [t for t, _, i in blocks if i] or [t for t, _, _ in blocks])


def paired(order: dict[int, int], nodes: list[Node]) -> set[int]:
    """Simple tree matching of a page (its nodes, parents first) with its host's template, whose paths have an ``order``: the paths of the nodes
    that it pairs, the most that keep parents and the order of siblings. Siblings have different labels, so only nodes of one path
    can pair; where their orders differ, the heaviest rising run of pairs stays."""
    weight: dict[int, int] = {}
    chosen: dict[int, list[int]] = {}
    for node in reversed(nodes):
        if node.path not in order:
            continue
        both = [p for p in node.children if p in weight]
        if all(order[x] < order[y] for x, y in zip(both, both[1:], strict=False)):
            kept = both
        else:
            best: list[tuple[int, list[int]]] = []
            for p in both:
                before = max((b for b in best if order[b[1][-1]] < order[p]), default=(0, []), key=lambda b: b[0])
                best.append((before[0] + weight[p], [*before[1], p]))
            kept = max(best, key=lambda b: b[0])[1]
        chosen[node.path] = kept
        weight[node.path] = 1 + sum(weight[p] for p in kept)
    out, todo = set(), [0] if 0 in weight else []
    while todo:
        p = todo.pop()
        out.add(p)
        todo += chosen[p]
    return out


#: A template's row for a path: pages that pair it, low and high hash of their texts, text below it, of that in headings, and so on.
PAGES, LOW, HIGH, MASS, HEADS, DEPTH, HOLDS = range(7)


def align(template: dict[int, list], order: dict[int, int], nodes: list[Node]) -> None:
    """Add a page to the sums of its host's template: the texts of the nodes that tree matching pairs, the mass of all."""
    for node in reversed(nodes):
        node.mass += sum(map(len, node.text))
        if node.heading:
            node.heads = node.mass
        if node.parent is not None:
            node.parent.mass += node.mass
            node.parent.heads += node.heads
    same = paired(order, nodes)
    for node in nodes:
        if node.path not in order:
            continue
        row = template.get(node.path)
        if row is None:
            row = template[node.path] = [0, (1 << 63) - 1, -1, 0, 0, node.depth, node.holds]
        if node.path in same:
            text = " ".join(" ".join(node.text).split())
            digest = xxhash.xxh64_intdigest(text) >> 1 if text else -1
            row[PAGES] += 1
            row[LOW], row[HIGH] = min(row[LOW], digest), max(row[HIGH], digest)
        row[MASS] += node.mass
        row[HEADS] += node.heads


def host(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("/")[0].split("?")[0].split("#")[0]


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_PLACES = "host string, path long, pages long, places long"
_TEMPLATE = "host string, path long, pages long, low long, high long, mass long, heads long, depth int, holds boolean"


def _sums(schema: str, add, most_nodes: int):
    """Rows of (host, path) that ``add`` sums over a task's pages; handed on whenever they are ``most_nodes``, as Spark sums them again."""
    fields = [c.split(" ") for c in schema.split(", ")]

    def run(batches):
        held: dict[str, dict[int, list]] = {}
        total = 0

        def out():
            rows = [(h, p, *r) for h, t in held.items() for p, r in t.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
                own = held.setdefault(host(row[0]), {})
                before = len(own)
                add(own, *row)
                total += len(own) - before
                if total >= most_nodes:
                    yield out()
                    held.clear()
                    total = 0
        if held:
            yield out()

    return run


def _add_places(own: dict[int, list], url, page) -> None:
    for node in walk(page or "", tree=True)[1]:
        if node.parent is None:
            own.setdefault(node.path, [0, 0])[0] += 1
        for i, p in enumerate(node.children):
            row = own.setdefault(p, [0, 0])
            row[0] += 1
            row[1] += i


def _add_texts(own: dict[int, list], url, page, order) -> None:
    if order:
        align(own, {p: i for i, p in enumerate(order)}, walk(page or "", tree=True)[1])


#: Rows of up to so many bytes are broadcast; beyond that Spark joins pages and rows by host.
BROADCAST_BYTES = 16 << 20


def _with_host_rows(pages: DataFrame, side: DataFrame, size) -> DataFrame:
    """Pages (``_host``) with their host's row of a table, ``size`` bytes of which a row has."""
    bytes_ = side.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return pages.join(F.broadcast(side) if bytes_ <= BROADCAST_BYTES else side, F.col("_host") == F.col("_h"), "left")


def _hosted(pages: DataFrame, *columns: str) -> DataFrame:
    name = F.regexp_extract(F.regexp_replace(F.lower(F.trim("url")), "^[a-z][a-z0-9+.-]*://", ""), "^[^/?#]*", 0)
    return pages.select(*columns, "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(name, F.lit("")).alias("_host"))


def induce(pages: DataFrame, least: int = 3, least_inside: int = 8, share: float = 0.8, support: float = 0.01, most_nodes: int = 100_000) -> DataFrame:
    """host, slot, inside, elsewhere: the wrapper of every host with at least ``least`` pages that are not all the same.

    Two passes over the pages, whose DOM trees have like siblings folded into one node. First the template of a host: the paths of at least ``least``
    pages and a ``support`` of all (so it has no more than a hundred pages' nodes, on a host of any size), siblings ordered by their mean place.
    Then every page is aligned with that template by simple tree matching. Both are sums by (host, path), partial in each task, so
    neither the order of pages nor how they fall into tasks matters, and no host is gathered.
    A node whose text is constant on all pages that pair it (``least``; in the slot ``least_inside``) is template, others are varying slots. ``slot`` is the
    deepest container that holds ``share`` of the host's text and all of its headings, menus, scripts and noise left out: the slot of the main text (null: there is none).
    Null urls are one host, the empty name; null pages have no text; an empty table gives no rows.
    """
    places = pages.select("url", "html").mapInArrow(_sums(_PLACES, _add_places, most_nodes), _PLACES)
    places = cut(places.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.sum("places").alias("places")))
    all_pages = places.where("path = 0").select("host", F.col("pages").alias("all"))
    usual = places.join(all_pages, "host").where(F.col("pages") >= F.greatest(F.lit(least), F.ceil(support * F.col("all"))))
    orders = usual.groupBy(F.col("host").alias("_h")).agg(F.sort_array(F.collect_list(F.struct((F.col("places") / F.col("pages")).alias("place"), "path"))).alias("l"))
    orders = cut(orders.select("_h", F.col("l.path").alias("_order")))
    aligned = _with_host_rows(_hosted(pages), orders, F.length("_h") + 8 * F.size("_order")).select("url", "html", "_order")
    rows = aligned.mapInArrow(_sums(_TEMPLATE, _add_texts, most_nodes), _TEMPLATE)
    sums = [F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("mass").alias("mass"), F.sum("heads").alias("heads"), F.max("depth").alias("depth"), F.max("holds").alias("holds")]
    nodes = cut(rows.groupBy("host", "path").agg(*sums))
    whole = nodes.groupBy("host").agg(F.max(F.when(F.col("path") == 0, F.struct("pages", "mass", "heads"))).alias("all"), F.max((F.col("low") < F.col("high")).cast("int")).alias("varies"))
    known = nodes.join(whole.where(F.col("varies") == 1).where(F.col("all.pages") >= least), "host")
    dominant = F.col("holds") & (F.col("mass") >= share * F.col("all.mass")) & (F.col("heads") == F.col("all.heads")) & (F.col("pages") >= F.col("all.pages") / 2)
    slot = F.max(F.when(dominant, F.struct("depth", "path"))).alias("s")
    constant = (F.col("low") == F.col("high")) & (F.col("low") >= 0) & (F.col("pages") >= least)
    paths = lambda c, n: F.transform(F.filter(c, lambda x: x["pages"] >= n), lambda x: x["path"])
    made = known.groupBy("host").agg(slot, F.collect_list(F.when(constant, F.struct("path", "pages"))).alias("t"))
    return made.select("host", F.col("s.path").alias("slot"), paths("t", least_inside).alias("inside"), paths("t", least).alias("elsewhere"))


def _texts(batches):
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("html", "_slot", "_inside", "_elsewhere")], strict=True)
        texts = [main_text(page, slot, frozenset(inside or ()), frozenset(elsewhere or ())) for page, slot, inside, elsewhere in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text, '' if none), n_chars of every page; whole pages.

    Main text is what stands in the slot of the host's wrapper (:func:`induce`), less its template. Hosts without a
    wrapper, and pages without that slot: what the page marks as its article (or main part), else all that is left. Menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go by their elements, roles and
    names in all. Character references are decoded, white space inside a block becomes one space, blocks
    are joined in page order by one line feed. Null html is empty; null urls share the empty host; repeated
    rows and null ids keep rows of their own; elements may be nested to any depth; other columns are ignored; an empty table gives no rows.
    """
    wrappers = cut(induce(pages))
    side = wrappers.select(F.col("host").alias("_h"), F.col("slot").alias("_slot"), F.col("inside").alias("_inside"), F.col("elsewhere").alias("_elsewhere"))
    joined = _with_host_rows(_hosted(pages, "page_id"), side, F.length("_h") + 8 * (F.size("_inside") + F.size("_elsewhere") + 1))
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "_slot", "_inside", "_elsewhere").mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    """:func:`extract` of all ``pages``; nulls, repeated rows and empty tables as there."""
    return extract(table(spark, sf_dir, "pages"))

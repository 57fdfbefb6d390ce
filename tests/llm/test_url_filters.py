"""URL templates held against the same tree in plain Python; rules against a loop over all of them."""

import math
import re
from collections import defaultdict

from docmill.llm.url_filters import RULES, judge, op11_url_filters


def plain_parts(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    best = (None, None)
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best[0] or ""):
            best = (h + p, verdict)
    return best


def look(s):
    stem, ending = re.fullmatch(r"(?is)(.*?)((?:\.(?:html?|php|aspx?|jsp|pdf|xml|json|txt))?)", s).groups()
    kind = "{number}" if re.fullmatch(r"[0-9][0-9_.:-]*", stem) else "{hex}" if re.fullmatch(r"(?i)[0-9a-f-]{8,}", stem) else "{mixed}" if re.search("[0-9]", stem) else "{word}"
    return kind + ending.lower()


def same(a, b, k, n, z):
    if not a[n] or not b[n]:
        return True
    p = (a[k] + b[k]) / (a[n] + b[n])
    return (a[k] / a[n] - b[k] / b[n]) ** 2 * a[n] * b[n] <= z * z * p * (1 - p) * (a[n] + b[n])


def plain_judge(rows, share=0.02, least=5, z=1.64, weight=8.0, threshold=0.5):
    """url, label rows to (template, purity) by recursion over each host's URLs."""
    known = [v for _, v in rows if v is not None]
    prior = (sum(known) + 1) / (len(known) + 2)
    smooth = lambda labels, p: (sum(labels) + weight * p) / (len(labels) + weight)
    out = {}

    def node(items, d, template, purity):
        deeper = []
        for i, segs, v in items:
            if len(segs) > d:
                deeper.append((i, segs, v))
            else:
                out[i] = (template, purity)
        counts = defaultdict(int)
        for _, segs, _ in deeper:
            counts[segs[d]] += 1
        name = lambda s: s if counts[s] >= share * len(deeper) and counts[s] >= least else look(s)
        branches = defaultdict(list)
        for item in deeper:
            branches[name(item[1][d])].append(item)
        stats = []
        for b, its in branches.items():
            labels = [v for _, _, v in its if v is not None]
            stats.append({"names": [b], "n": len(its), "labelled": len(labels), "good": sum(labels), "ends": sum(len(s) == d + 1 for _, s, _ in its)})
        stats.sort(key=lambda s: (s["ends"] * 2 >= s["n"], (s["good"] + 1) / (s["labelled"] + 2), s["names"][0]))
        groups = []
        for s in stats:
            if groups and same(groups[-1], s, "good", "labelled", z) and same(groups[-1], s, "ends", "n", z):
                groups[-1] = {k: groups[-1][k] + s[k] for k in s}
            else:
                groups.append(s)
        for g in groups:
            label = g["names"][0] if len(g["names"]) == 1 else "{" + "|".join(sorted(g["names"])) + "}"
            node([x for b in g["names"] for x in branches[b]], d + 1, f"{template}/{label}", (g["good"] + weight * purity) / (g["labelled"] + weight))

    hosts = defaultdict(list)
    for i, (url, v) in enumerate(rows):
        host, path = plain_parts(url)
        hosts[host].append((i, [s for s in path.split("/") if s], v))
    for host, items in hosts.items():
        node(items, 0, host, smooth([v for _, _, v in items if v is not None], prior))
    return [(*out[i], "block" if out[i][1] < threshold else "allow") for i in range(len(rows))]


def made_up():
    rows = []
    for i in range(240):
        rows.append((f"https://Site.test/news/{i}-story-{i * 7}.html?x={i}", i % 5 != 0 if i % 3 else None))
        rows.append((f"https://site.test/tag/{'abcdefgh'[i % 8]}{i}/", i % 9 == 0))
        rows.append((f"http://site.test/blog/2024/{i:02d}/post{i}", i % 4 != 0))
        rows.append((f"http://other.test/{i:08x}beef", None))
    rows += [(None, 1), ("no scheme", None), ("https://", None), ("https://site.test", 0), ("https://site.test/a/b/c/d/e/f", 1), ("mailto:a://b//c", None)] * 3
    return [(u, None if v is None else int(v)) for u, v in rows]


def test_tree_is_the_plain_one(spark):
    rows = made_up()
    frame = spark.createDataFrame([(i, u, v, "kept", 5) for i, (u, v) in enumerate(rows)], "n long, url string, label int, segments string, to int").repartition(7)
    got = judge(frame)
    assert got.columns == ["n", "url", "label", "segments", "to", "host", "path", "rule", "verdict", "template", "purity"]
    got = {r["n"]: r for r in got.collect()}
    assert len(got) == len(rows)
    verdicts = set()
    for i, ((url, _), (template, purity, verdict)) in enumerate(zip(rows, plain_judge(rows), strict=True)):
        r = got[i]
        assert (r["host"], r["path"]) == plain_parts(url) and r["rule"] is None
        assert r["template"] == template and math.isclose(r["purity"], purity) and r["verdict"] == verdict
        verdicts.add(verdict)
    assert verdicts == {"allow", "block"}


def test_op11_rules_and_templates(spark, sf_dir):
    got = op11_url_filters(spark, sf_dir).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        host, path = plain_parts(pages[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["purity"] < 0.5 else "allow"))


def test_deep_null_and_empty(spark):
    long = "https://deep.test/" + "/".join(f"s{i}" for i in range(40))
    rows = spark.createDataFrame([(1, long), (1, long), (None, None), (2, "ftp://x.test/#/a"), (3, "https://m.net/es/1"), (4, "https://net/fr/"), (5, "https://x.com")], "page_id long, url string")
    got = {r["url"]: r for r in judge(rows).collect()}
    assert judge(rows).count() == 7 and judge(rows.limit(0)).count() == 0
    assert got[long]["template"].endswith("/**") and got[long]["verdict"] == "allow"
    assert (got[None]["host"], got[None]["path"], got[None]["template"]) == ("", "", "")
    assert got["https://m.net/es/1"]["rule"] == "net/es/" and got["https://net/fr/"]["verdict"] == "block" and got["https://x.com"]["rule"] is None

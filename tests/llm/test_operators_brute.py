"""Classifiers, pages, crowded near duplicates and the pipeline against plain Python."""

import collections
import math
import random
import re
import zlib
from html.parser import HTMLParser

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm import html_extract, licenses, mixing, near_dedup, quality, toxicity


def statistics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines, n, c = text.split("\n"), len(words), max(1, len(text))
    letters = len(regex.findall(r"\p{L}", text))
    rate = lambda p: len(regex.findall(p, text)) / c
    return {
        "x_words": math.log1p(n), "x_chars_per_word": len(text) / max(1, n), "x_distinct_words": len(set(words)) / max(1, n), "x_upper": len(regex.findall(r"\p{Lu}", text)) / max(1, letters), "x_letters": letters / c,
        "x_digits": rate(r"\p{Nd}"), "x_symbols": rate(r"[#$%&*+/<=>@\\^_`|~{}\[\]]"), "x_marks": rate("[!?]"), "x_stops": rate("[.,;:]"), "x_repeated_marks": sum(1 for _ in regex.finditer(r"([!?#$%&*.|])\1", text)) / c,
        "x_distinct_lines": len(set(lines)) / len(lines), "x_words_per_line": math.log1p(n / len(lines)),
    }


def quality_score(rules, text):
    x, total = statistics(text), rules.intercept
    for rule, weight in rules.weights:
        parts = [p.split(" ") for p in rule.split(" AND ")]
        if all(x[n] <= float(at.rstrip("D")) if side == "<=" else x[n] > float(at.rstrip("D")) for n, side, at in parts):
            total += weight
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_quality_rules_by_hand(docs, labels, odd):
    rules = quality.train(docs, labels)
    assert rules.weights
    for df in (docs, odd):
        rows = quality.classify(df, rules).collect()
        assert len(rows) == df.count()
        for r in rows:
            want = quality_score(rules, r.text)
            assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.3)


def test_held_out_rows_teach_nothing(spark, docs, labels):
    out = F.udf(lambda i: zlib.crc32(str(i).encode()) % 5 == 0, "boolean")
    other = labels.withColumn("quality", F.when(out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels) == quality.train(docs, other)
    got = {r.doc_id: r.held_out for r in docs.select("doc_id", quality.held_out().alias("held_out")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}


def toxic_features(text, lexicon):
    """The 19 features, one after the other, in plain Python."""
    words = [w for w in (x.strip(toxicity._EDGES) for x in text.lower().split()) if w]
    n = len(words)
    if not n:
        return [0.0] * 19
    bytes_ = text.encode()
    count = lambda chars: sum(bytes_.count(ch.encode()) for ch in chars)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    found = {words[i] for i in hits}
    spaced = ["".join(c for c in m[0] if c.isalpha()).lower() for m in re.finditer(r"(?:(?<=\s)|^)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?=\W|$)", text)]
    odd = sorted({w for w in words if not w.isalpha()})
    stretched = sorted({w for w in words if re.search(r"([^\W\d_])\1{2,}", w)})
    hidden = 0
    for w in odd + spaced:
        plain = set()
        for a, b in (("013457@$!|€", "oieastasiie"), ("013457@$!|€", "oleastaslle")):
            plain.add("".join(c for c in "".join(b[a.index(c)] if c in a else c for c in w) if c.isalpha()))
        hidden += (bool(plain & set(lexicon)) and w not in lexicon) or (w in spaced and w in lexicon)
    hidden += sum(1 for w in stretched if w not in lexicon and re.sub(r"([^\W\d_])\1{2,}", r"\1", w) in lexicon)
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = sum(1 for i in hits if any(abs(i - j) <= 5 for j in second))
    upper, lower = sum(65 <= b <= 90 for b in bytes_), sum(97 <= b <= 122 for b in bytes_)
    total = len(bytes_)
    mixed = sum(1 for w in odd if re.search(r"[^\W\d_][0-9@$!|*€]+[^\W_]|[^\W_][@$!|*€]+[^\W_]", w))
    return [
        math.log1p(n), (len(hits) + hidden) / n, float(len(hits) + hidden > 0), len(found) + hidden, sum(lexicon[w] for w in found), hidden / n, near / n, len(second) / n, upper / max(1, upper + lower),
        len(re.findall(r"\b[A-Z]{3,}\b", text)) / n if upper > 2 else 0.0, count("!?") / total, sum(33 <= b <= 47 or 58 <= b <= 64 for b in bytes_) / total, count("0123456789") / total, count("#$%&*@^_|~") / total,
        mixed / n, len(spaced) / n, len(stretched) / n, (sum(words[i] in toxicity.INSULTS for i in hits) + hidden) / n, len(found & set(toxicity.INSULTS)) + hidden,
    ]


def toxic_score(model, text):
    x, margin = toxic_features(text or "", model.lexicon), 0.0
    for tree, weight in zip(model.trees.trees, model.trees.treeWeights, strict=True):
        node = tree._call_java("rootNode")
        while node.numDescendants():
            node = node.leftChild() if x[node.split().featureIndex()] <= node.split().threshold() else node.rightChild()
        margin += weight * node.prediction()
    raw = 1 / (1 + math.exp(-2 * margin))
    at, value = list(model.calibration.boundaries.toArray()), list(model.calibration.predictions.toArray())
    if raw <= at[0]:
        own = value[0]
    elif raw >= at[-1]:
        own = value[-1]
    else:
        i = next(i for i, b in enumerate(at) if b >= raw)
        own = value[i] if at[i] == raw else value[i - 1] + (value[i] - value[i - 1]) * (raw - at[i - 1]) / (at[i] - at[i - 1])
    return 0.999 * min(1.0, max(0.0, own)) + 0.001 * raw


def test_toxicity_by_hand(spark, docs, labels, odd):
    model = toxicity.train(docs, labels)
    assert model.trees is not None
    more = spark.createDataFrame([(1, "You are an 1d10t and a m0ron, YOU i d i o t!"), (2, "stuuuupid " * 3000), (3, "!!! ??? 12"), (3, "!!! ??? 12")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").limit(60), odd.select("doc_id", "text"), more):
        own = df.collect()
        got = collections.Counter((str(r.doc_id), round(r.score, 7), r.predicted) for r in model.score(df).collect())
        want = collections.Counter((str(r.doc_id), round(s := toxic_score(model, r.text), 7), int(s >= 0.5)) for r in own)
        assert got == want


class Article(HTMLParser):
    """What stands in ``article``, as blocks, by the standard library's parser."""

    BLOCKS = {"p", "h1", "h2", "li", "ul", "div", "article"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in self.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.blocks.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside > 0:
            self.blocks[-1] += data


def article(page):
    a = Article()
    a.feed(page)
    return "\n".join(t for t in (" ".join(b.split()) for b in a.blocks) if t)


def test_pages_by_another_parser(spark, sf_dir):
    """The given pages mark their article; the wrapper finds it without that mark on every host of three pages or more."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want
    bare = pages.withColumn("html", F.regexp_replace("html", r"<(/?)article>", "<$1div>"))
    big = html_extract.induce(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert big.where("slot IS NOT NULL").count() >= 30
    hosts = {r.host for r in html_extract.induce(bare).where("slot IS NOT NULL").collect()}
    got = [r for r in html_extract.extract(bare).collect() if html_extract.host(r.url) in hosts]
    assert all(r.text == want[r.page_id] for r in got)


def site(i, words):
    return f"<body><div id=a><span>Home</span><span>Topics</span></div><div id=b><div class=s>Read {words[i % 7]} too</div><div class=t><h2>{words[i % 11]} {i}</h2><p>{' '.join(words[i : i + 60])}</p><div class=u><p>Printed on paper</p></div></div></div><div id=c>All about us</div></body>"


def test_slots_without_marks(spark):
    """Pages that mark nothing: the slot of the text is found, what is constant in it goes, and what varies outside is no text."""
    words = [f"word{i}" for i in range(200)]
    rows = [(i, f"http://h.example/{i}", site(i, words)) for i in range(20)] + [(50, "http://one.example/", site(1, words)), (51, "http://h.example/x", "<p>another kind of page</p>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[i] == f"{words[i % 11]} {i}\n{' '.join(words[i : i + 60])}" for i in range(20))
    assert got[50].startswith("HomeTopics\nRead") and got[51] == "another kind of page"


def test_deep_pages(spark):
    n = 5000
    pages = ["<div>" * n + "text", "<span>" * n + "<p>text", "<b>" * n + "<p>" * n + "text", "<ul><li>" * n + "text"]
    rows = [(i, f"http://deep/{i}", p) for i, p in enumerate(pages * 2)]
    assert {r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"text"}


def test_matching_keeps_the_order_of_siblings():
    tree = lambda page: html_extract.walk(page, tree=True)[1]
    order = {n.path: i for i, n in enumerate(tree("<div class=a>1<b>x</b></div><div class=b>2</div><div class=c>3</div>"))}
    other = tree("<div class=c>3</div><div class=a>1<b>x</b></div><div class=b>2</div>")
    same = html_extract.paired(order, other)
    names = {html_extract.below(0, f"div.{c}"): c for c in "abc"}
    assert {names[p] for p in same if p in names} == {"a", "b"} and len(same) == 4
    assert html_extract.paired(order, tree("<p>none of these")) == {0}


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(sets):
    """Smallest id reachable, by all pairs."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k, most", [(2, 14), (5, 7)])
def test_planted_group(spark, k, most):
    """A large group of near copies of which many link with few or none, in blocks so small that a crowd has dozens, among texts
    of other lengths that share a passage."""
    rng = random.Random(k)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(420):
        own = list(base)
        for j in rng.sample(range(150), rng.randint(1, most)):
            own[j] = f"v{i}_{j}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base[: 30 + 3 * i] + [f"u{i}_{j}" for j in range(5)])) for i in range(40)] + [(2000, None), (2001, ""), (2002, rows[3][1].upper())]
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=k, block_rows=40, block_shingles=6_000).collect()}
    want = components({i: shingle_set(t, k) for i, t in rows})
    assert got == want and 3 < len(set(want.values())) < 400


def test_common_counts():
    import numpy as np

    rng = random.Random(1)
    some = lambda: [np.array(sorted(rng.sample(range(-500, 500), rng.randint(1, 80)))) for _ in range(33)]
    a, b = some(), [*some(), np.array([10**9])]
    for at, m in near_dedup.common_counts(a, b, rows=10, columns=64):
        for i, row in enumerate(m):
            assert row.tolist() == [len(set(a[at + i].tolist()) & set(y.tolist())) for y in b]


def test_license_words_by_hand(spark):
    """Whole texts equal but for wrapping, case, copyright lines, punctuation and spellings; the SQL's words are the same."""
    text = "Permission is granted to the copyright\nowner to sub-license\nthis, free of charge, at ten per\ncent.\nVersion 2.0"
    same = ["Copyright (c) 2001 A. B.\n" + text, text.upper().replace("\n", "  \r\n "), "permission is granted to the Copyright  Holder to sublicense this free of charge at ten percent version 2", "Copyright Jane Doe\nAll Rights\nReserved.\n" + text.replace("\n", " ")]
    other = [text + " not", text.replace("charge", "charges"), "", "...", None]
    known = licenses.known_licenses(spark, [("X", text)])
    rows = list(enumerate([*same, *other]))
    got = {r.doc_id: r.license_id for r in licenses.license_scan(spark.createDataFrame([*rows, *rows], "doc_id long, text string"), known).collect()}
    assert got == {i: "X" if i < len(same) else None for i, _ in rows}
    for _, t in licenses.known_texts():
        assert licenses.words_of(t)
    values = [t for _, t in rows if t is not None] + ["licence licence LICENCE", "© 2020 x\ny", "Éa b c\x85d"]
    shown = spark.createDataFrame([(v,) for v in values], "t string").select("t", licenses.canonical(F.col("t")).alias("c")).collect()
    assert all(r.c == licenses.words_of(r.t) for r in shown)


def test_pipeline_by_stages(spark, sf_dir, docs, labels, duck):
    """Each stage on the rows that its predecessor kept, by plain Python or SQL."""
    kept = [r.asDict() for r in docs.collect()]
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    def stage(n):
        out = [r.asDict() for r in corpus_pipeline.STAGES[n][1](spark, frame(kept), sf_dir).collect()]
        assert all(tuple(r) == tuple(docs.columns) for r in out)
        return out

    rules = quality.train(frame(kept), labels)
    got = stage(0)
    assert ids(got) == ids([r for r in kept if quality_score(rules, r["text"]) >= 0.3]) and len(got) < len(kept)
    kept = got
    last = {}
    for r in kept:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
        last[low] = max(last.get(low, -1), r["doc_id"])
    got = stage(1)
    assert ids(got) == sorted(last.values()) and len(got) < len(kept)
    kept = got
    comps = components({r["doc_id"]: shingle_set(r["text"], 5) for r in kept})
    got = stage(2)
    assert ids(got) == sorted(i for i, c in comps.items() if i == c) and len(got) < len(kept)
    kept = got
    import pandas as pd

    duck.register("kept", pd.DataFrame(kept))
    want = {i: t // s if s else 0 for i, s, t in duck.execute(f"WITH documents AS (FROM kept), {mixing.OP1_SQL.strip().removeprefix('WITH')}".replace("FROM queued q LEFT JOIN", "FROM queued q LEFT JOIN")).df()[["doc_id", "size", "taken"]].itertuples(index=False)}
    got = stage(3)
    assert collections.Counter(r["doc_id"] for r in got) == {i: n for i, n in want.items() if n}
    tokenizers = pytest.importorskip("tokenizers")
    from docmill.llm.bpe import word_bpe_path

    theirs = tokenizers.Tokenizer.from_file(word_bpe_path())
    rows = corpus_pipeline.bpe(spark, frame(got), sf_dir).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r["doc_id"] for r in got)
    text = {r["doc_id"]: r["text"] for r in got}
    for r in rows:
        enc = theirs.encode(text[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == enc and r.n_tokens == len(enc) and r.decoded == theirs.decode(enc, skip_special_tokens=False)


def test_text_is_the_same_for_any_split(spark):
    """Siblings in several orders, hosts of different sizes, null urls: however pages fall into tasks and sums are handed on."""
    words = [f"w{i}" for i in range(90)]
    notice, body = "<div class=x><p>same words here</p></div>", "<div class=y><h2>{0}</h2><p>{1}</p></div>"
    rows = []
    for i in range(36):
        parts = [notice, body.format(f"{words[i]} head", " ".join(words[i : i + 40])), f"<div class=z>{words[i % 2]}</div>", "<div class=w>foot</div>"]
        order = [(0, 1, 2, 3), (1, 0, 3, 2), (3, 2, 1, 0)][i % 3]
        rows.append((i, f"http://many.example/{i}" if i % 4 else None, "<body>" + "".join(parts[k] for k in order) + "</body>"))
    own = [f"<p>{' '.join(words[k : k + 30])}</p>" for k in (0, 20, 40)]
    rows += [(100, "http://x.example/1", notice + own[0]), (101, "http://x.example/2", own[1] + notice), (102, "http://x.example/3", own[2] + notice)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda df: {r.page_id: r.text for r in html_extract.extract(df).collect()}
    one = texts(frame.coalesce(1))
    assert len(one) == len(rows) and texts(frame.repartition(3)) == one and texts(frame.orderBy(F.desc("page_id")).repartition(len(rows), "page_id")) == one
    plain = lambda df: sorted((r.host, r.slot, sorted(r.inside), sorted(r.elsewhere)) for r in df.collect())
    assert plain(html_extract.induce(frame.repartition(5), most_nodes=3)) == plain(html_extract.induce(frame.coalesce(1)))
    assert all("same words here" not in one[i] for i in (100, 101, 102))

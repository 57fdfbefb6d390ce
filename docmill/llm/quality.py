"""Quality classifier: a sparse ensemble of tree-path rules, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import cut, packed, table, text_or_empty

#: Labelled rows that the classifier is fitted on, at most: a sample by hash, whose size does not grow with the corpus.
FIT_ROWS = 20_000

_T = "_t"


def _rate(pattern: str) -> Column:
    return F.regexp_count(F.col(_T), F.lit(pattern)) / F.greatest(F.length(_T), F.lit(1))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows as a struct ``_doc``, and one double column per statistic (``x_...``) of the whole text, with built-in
    expressions only; so columns of any name may be in ``docs``.

    Null text is empty; every statistic of an empty text is 0. Words are runs without ASCII white space.
    """
    own = packed(docs).withColumn(_T, text_or_empty(f"_doc.{text_col}")).withColumn("_words", F.filter(F.split(_T, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    own = own.withColumns({"_n": F.size("_words"), "_lines": F.split(_T, "\n")})
    one = lambda c: F.greatest(c, F.lit(1))
    letters = F.regexp_count(F.col(_T), F.lit(r"\p{L}"))
    made = {
        "x_words": F.log1p(F.col("_n").cast("double")),
        "x_chars_per_word": F.length(_T) / one(F.col("_n")),
        "x_distinct_words": F.size(F.array_distinct("_words")) / one(F.col("_n")),
        "x_upper": F.regexp_count(F.col(_T), F.lit(r"\p{Lu}")) / one(letters),
        "x_letters": letters / one(F.length(_T)),
        "x_digits": _rate(r"\p{Nd}"),
        "x_symbols": _rate(r"[#$%&*+/<=>@\\^_`|~{}\[\]]"),
        "x_marks": _rate(r"[!?]"),
        "x_stops": _rate(r"[.,;:]"),
        "x_repeated_marks": _rate(r"([!?#$%&*.|])\1"),
        "x_distinct_lines": F.size(F.array_distinct("_lines")) / one(F.size("_lines")),
        "x_words_per_line": F.log1p(F.col("_n") / one(F.size("_lines"))),
    }
    return own.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()}).drop(_T, "_words", "_n", "_lines")


@dataclass(frozen=True)
class Rules:
    """A fitted ensemble: score = logistic(intercept + sum of the weights of the rules that hold)."""

    intercept: float
    weights: tuple[tuple[str, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(F.expr(rule), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(node, names: list[str], conditions: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Conjunctions of conditions from the root to every node below it."""
    out = [conditions] if conditions else []
    if node.numDescendants():
        name, at = names[node.split().featureIndex()], float(node.split().threshold())
        out += _paths(node.leftChild(), names, (*conditions, f"{name} <= {at!r}D"))
        out += _paths(node.rightChild(), names, (*conditions, f"{name} > {at!r}D"))
    return out


def _short(path: tuple[str, ...]) -> str:
    """A path as one rule: of several bounds of a statistic on one side only the tightest is kept."""
    bounds: dict[tuple[str, str], float] = {}
    for condition in path:
        name, side, at = condition.rstrip("D").split(" ")
        best = min if side == "<=" else max
        bounds[name, side] = best(bounds.get((name, side), float(at)), float(at))
    return " AND ".join(f"{n} {s} {at!r}D" for (n, s), at in sorted(bounds.items()))


def fit(labelled: DataFrame, label: str, trees: int = 24, depth: int = 3, penalty: float = 0.001, seed: int = 5) -> Rules:
    """Fit on rows with ``x_`` statistics and a 0/1 ``label``: a forest of shallow trees, every path of which is a
    candidate rule; logistic regression with an L1 penalty then drops all but a few.

    Rows with a null label are ignored. With one class or no rows the score is constant: that class's rate, smoothed.
    """
    names = sorted(c for c in labelled.columns if c.startswith("x_"))
    rows = cut(labelled.where(F.col(label).isNotNull()).select(*names, F.col(label).cast("double").alias("label")))
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    if not 0 < counts.ones < counts.n:
        import math

        return Rules(math.log((counts.ones + 0.5) / (counts.n - counts.ones + 0.5)), ())
    packed = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=max(2, counts.n // 1000), featureSubsetStrategy="0.6", seed=seed).fit(packed)
    rules = sorted({_short(p) for t in forest.trees for p in _paths(t._call_java("rootNode"), names)})
    held = cut(rows.select("label", F.array(*[F.when(F.expr(r), 1.0).otherwise(0.0) for r in rules]).alias("r")))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(held.select("label", array_to_vector("r").alias("features")))
    weights = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-9)
    return Rules(float(lasso.intercept), weights)


def held_out(c: str = "doc_id") -> Column:
    """The rows that no label is learnt from; a null id is never learnt from either."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """text and ``label`` of at most about ``rows`` labelled documents that are not held out, chosen by hash of id."""
    known = labels.where(F.col(label).isNotNull() & ~held_out()).select(F.col("doc_id").alias("_id"), F.col(label)).dropDuplicates(["_id"])
    n = known.count()
    share = min(1.0, rows / max(1, n))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # bounded by ``rows`` ids
    known = known.select("_id", F.col(label).alias("_label"))
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", F.col("_label").alias(label))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Rules:
    """Rules learnt from at most about ``rows`` labelled texts of ``docs``. Null labels and ids teach nothing, null texts
    are empty; a document with several labels counts with one of them; no rows or one class: a constant score."""
    return fit(statistics(labelled_texts(docs, labels, label, rows)).select(F.col(f"_doc.{label}"), "*"), label)


def classify(docs: DataFrame, rules: Rules, threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1, higher: better) and predicted (1 from ``threshold`` on) to every row of ``docs``.

    A narrow map: no shuffle, no Python. Null and empty texts get the score of an empty text; null ids, repeated
    rows and further columns, whatever their names, pass through unchanged, but columns that are named score or predicted are replaced;
    an empty table gives no rows.
    """
    rest = [f"_doc.`{c}`" for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = statistics(docs).select("_doc", rules.score().alias("_score"))
    return scored.select(*rest, F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by rules learnt from ``labels``; nulls, ties and empty tables as in :func:`classify`."""
    docs = table(spark, sf_dir, "documents")
    rules = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), rules).select("doc_id", held_out().alias("held_out"), "score", "predicted")

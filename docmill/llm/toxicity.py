"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import cut, shipped, table
from docmill.llm.quality import FIT_ROWS, held_out, labelled_texts

shipped(__name__)

#: Pronouns of the second person in the corpus's languages (fixed values).
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "tú", "ti", "tus")
#: Insults that any corpus's lexicon starts from (fixed values); what labels teach is added to them.
INSULTS = ("clown", "coward", "creep", "dirtbag", "disgusting", "dumb", "dumbass", "failure", "filth", "filthy", "fool", "freak", "garbage", "hate", "idiot", "idiotic", "ignorant", "imbecile", "jerk", "kill", "liar", "loser", "lowlife", "moron", "nasty", "parasite", "pathetic", "pig", "rat", "scum", "sick", "stupid", "trash", "ugly", "useless", "vermin", "vile", "worthless")
#: Signs that stand for letters in disguised words (fixed values).
LOOKALIKES = (str.maketrans("013457@$!|€", "oieastasiie"), str.maketrans("013457@$!|€", "oleastaslle"))
NAMES = ("words", "lexicon_rate", "lexicon_any", "lexicon_distinct", "lexicon_weight", "hidden_rate", "near_second_person", "second_person_rate", "capitals", "capital_words", "marks", "punctuation", "digits", "symbols", "mixed_words", "spaced_letters", "stretched", "insult_rate", "insults")

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‚‘’¡¿…–—"
_MIXED = re.compile(r"[^\W\d_][0-9@$!|*€]+[^\W_]|[^\W_][@$!|*€]+[^\W_]")
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?=\W|$)")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")


def terms(text: str) -> list[str]:
    """Lower-cased words of a text without the signs at their ends."""
    return [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features, in the order of ``NAMES``; all 0 for an empty text."""
    words = terms(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    hidden = 0
    joined = ["".join(c for c in m[0] if c.isalpha()).lower() for m in _SPACED.finditer(text)]
    odd = [w for w in set(words) if not w.isalpha()]
    for w in [*odd, *joined]:
        plain = {"".join(c for c in w.translate(t) if c.isalpha()) for t in LOOKALIKES}
        hidden += any(p in lexicon for p in plain) and w not in lexicon or w in joined and w in lexicon
    stretched = [w for w in set(words) if _STRETCHED.search(w)] if _STRETCHED.search(text.lower()) else []
    hidden += sum(_STRETCHED.sub(r"\1", w) in lexicon for w in stretched if w not in lexicon)
    second = np.array([i for i, w in enumerate(words) if w in SECOND_SET], np.int64)
    near = 0
    if len(second) and hits:
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
        near = int((gap <= 5).sum())
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    total = max(1, int(raw.sum()))
    upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum())
    punctuation = int(raw[33:48].sum() + raw[58:65].sum())
    symbols = int(raw[[35, 36, 37, 38, 42, 64, 94, 95, 124, 126]].sum())
    shouted = len(re.findall(r"\b[A-Z]{3,}\b", text)) if upper > 2 else 0
    found = {words[i] for i in hits}
    return [
        float(np.log1p(n)), (len(hits) + hidden) / n, float(len(hits) + hidden > 0), float(len(found) + hidden), float(sum(lexicon[w] for w in found)),
        hidden / n, near / n, len(second) / n, upper / max(1, upper + lower), shouted / n, (int(raw[33]) + int(raw[63])) / total, punctuation / total,
        int(raw[48:58].sum()) / total, symbols / total, sum(bool(_MIXED.search(w)) for w in odd) / n, len(joined) / n, len(stretched) / n,
        (sum(words[i] in INSULT_SET for i in hits) + hidden) / n, float(len(found & INSULT_SET) + hidden),
    ]


SECOND_SET, INSULT_SET = frozenset(SECOND_PERSON), frozenset(INSULTS)


def _featured(batches, lexicon: dict[str, float]):
    for batch in batches:
        made = [features(t or "", lexicon) for t in batch.column("text").to_pylist()]
        columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.list_(pa.float64()))], [*names, "f"])


def dense(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Replace ``text`` by the feature array ``f``; a narrow map over Arrow batches."""
    rest = [f"`{n}` {t}" for n, t in docs.dtypes if n != "text"]
    return docs.mapInArrow(lambda b: _featured(b, lexicon), ", ".join([*rest, "f array<double>"]))


def _term_rows(batches):
    for batch in batches:
        lists = [sorted(set(terms(t or ""))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([w for ws in lists for w in ws], pa.string()), pa.array(np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False), [len(x) for x in lists]).astype(np.int32))], ["term", "toxic"])


def learn_lexicon(labelled: DataFrame, most: int = 200, least_docs: int = 5, least_odds: float = 3.0) -> dict[str, float]:
    """``INSULTS`` and at most ``most`` terms with a high smoothed log odds of toxic against other documents, counted
    once a document. Fitted on the bounded sample of labelled rows; the result is as small on any corpus."""
    size = labelled.agg(F.coalesce(F.sum(F.col("toxic")), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    found = labelled.mapInArrow(_term_rows, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (size.p + 1.0)) - F.log((F.col("n") - F.col("p") + 0.5) / (size.n - size.p + 1.0))
    clean = F.length("term") >= 3
    kept = found.where((F.col("p") >= least_docs) & clean).withColumn("w", odds).where(F.col("w") >= least_odds).orderBy(F.col("p").desc(), "term").limit(most)
    return dict.fromkeys(INSULTS, least_odds) | {r.term: float(r.w) for r in kept.collect()}


class Toxicity:
    """A fitted scorer: lexicon, boosted trees, isotonic calibration."""

    def __init__(self, lexicon, trees, calibration, constant=None):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Replace ``text`` of ``docs`` by score (0 to 1, higher: more toxic) and predicted (1 from ``threshold`` on).

        A narrow map. Null text is empty and gets the score of an empty text; null ids, repeated rows and other
        columns, whatever their names, pass through, but columns that are named score or predicted are replaced; an empty table
        gives no rows. The score is the calibrated one, to which a thousandth of the trees' own is added, so that it ranks also within a
        step of the calibration.
        """
        rest = [f"_rest.`{c}`" for c in docs.columns if c.lower() not in ("text", "score", "predicted")]
        if self.constant is not None:
            score = F.lit(self.constant)
            own = docs.select(F.struct(*docs.columns).alias("_rest"))
        else:
            own = docs.select(F.struct(*[F.col(c.removeprefix("_rest.")) for c in rest] or [F.lit(0)]).alias("_rest"), "text")
            raw = self.trees.transform(dense(own, self.lexicon).withColumn("features", array_to_vector("f")))
            own = self.calibration.transform(raw.select("_rest", vector_to_array("probability")[1].alias("raw")))
            score = 0.999 * F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)) + 0.001 * F.col("raw")
        scored = own.withColumn("_score", score)
        return scored.select(*rest, F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, rounds: int = 20, depth: int = 3, seed: int = 5) -> Toxicity:
    """Fit on at most about ``rows`` labelled documents: the lexicon and the trees on four fifths of them, the
    calibration on the rest (on all where the rest lacks a class). One class or no rows: a constant score."""
    sample = cut(labelled_texts(docs, labels, "toxic", rows).select("text", F.col("toxic").cast("int").alias("toxic")))
    part = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(5))
    counts = sample.groupBy((part == 0).alias("calibrate")).agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).collect()
    n, p = sum(r.n for r in counts), sum(r.p for r in counts)
    if not 0 < p < n:
        return Toxicity({}, None, None, (p + 0.5) / (n + 1.0))
    mixed = {r.calibrate: 0 < r.p < r.n for r in counts}
    fit_on = sample.where(part != 0) if mixed.get(False) else sample
    lexicon = learn_lexicon(fit_on, least_docs=3 if p < 400 else 5)
    ready = cut(dense(sample.withColumn("part", part), lexicon).withColumnRenamed("toxic", "label"))
    ready = ready.withColumn("features", array_to_vector("f")).withColumn("label", F.col("label").cast("double"))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64, minInstancesPerNode=max(2, n // 2000), seed=seed).fit(ready.where("part != 0") if mixed.get(False) else ready)
    rest = ready.where("part = 0") if mixed.get(True) else ready
    margins = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(margins)
    return Toxicity(lexicon, trees, calibration)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from ``labels``; nulls, ties and empty tables as in :meth:`Toxicity.score`."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return model.score(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), "score", "predicted")

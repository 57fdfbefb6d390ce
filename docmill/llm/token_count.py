"""Token counts under a unigram vocabulary: best segmentation by dynamic programming, counts only."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import shipped, table

shipped(__name__)

SPACE = "▁"
#: How far below the worst piece an unknown character scores (fixed value of the unigram model).
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentence-piece model file, without unknown, control, byte and unused pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    return {model.id_to_piece(i): float(model.get_score(i)) for i in range(model.get_piece_size()) if not skip(i)}


class Counter:
    """Counts pieces of the best segmentation.

    Aho-Corasick lists the pieces that end at each place; the score of a place is the best sum up to it. Ties go to
    the piece that starts first, as in the tokenizer, which scans starts in rising order and replaces on strictly greater
    scores. A character that is no piece by itself may stand alone at the worst score less the penalty; it
    falls back to its bytes, so it counts once a byte. Scores are summed in double precision.

    Where no piece has a space after another character, texts split before each run of spaces without changing
    the best segmentation; counts of short stretches are remembered, ``most`` at most.
    """

    def __init__(self, scores: dict[str, float], most: int = 400_000):
        self.matches = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.most = most
        crossing = any(SPACE in p.lstrip(SPACE) for p in scores)
        self.stretch = re.compile("(?s).+" if crossing else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def best(self, text: str) -> int:
        n = len(text)
        if self.single.issuperset(text):  # no unknown character: matches come by rising end, the longest first
            total, tokens = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for end, (length, s) in self.matches.iter(text):
                start, end = end + 1 - length, end + 1
                t = total[start] + s
                if t > total[end]:
                    total[end], tokens[end] = t, tokens[start] + 1
            return tokens[n]
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.matches.iter(text):
            ends[end].append(piece)
        for end, c in enumerate(text):
            top, tokens = None, 0
            for length, s in sorted(ends[end], reverse=True):
                total = score[end + 1 - length] + s
                if top is None or total > top:
                    top, tokens = total, count[end + 1 - length] + 1
            if c not in self.single and (top is None or score[end] + self.unknown > top):
                top, tokens = score[end] + self.unknown, count[end] + len(c.encode("utf-8", "replace"))
            score[end + 1], count[end + 1] = top, tokens
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, known = 0, self.known
        for s in self.stretch.findall(SPACE + text.replace(" ", SPACE)):
            c = known.get(s)
            if c is None:
                c = self.best(s)
                if len(known) < self.most and len(s) <= 64:
                    known[s] = c
            total += c
        return total


def _counted(batches, scores):
    counter = Counter(scores.value)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([counter.count(t or "") for t in batch.column("text").to_pylist()], pa.int64())], ["doc_id", "n_tokens"])


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every row, whole texts; ``path`` is the vocabulary's model file, read by the driver and
    broadcast (bounded). A narrow map. Null and empty text: 0. Null ids and repeated rows pass through; other
    columns are ignored; an empty table gives no rows."""
    scores = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: _counted(b, scores), f"doc_id {kind}, n_tokens long")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """:func:`count_tokens` of all ``documents``; nulls, repeated rows and empty tables as there."""
    return count_tokens(table(spark, sf_dir, "documents"), piece_path())

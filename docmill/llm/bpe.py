"""BPE encoding and decoding with word ends, as a map over partitions."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import shipped, table

shipped(__name__)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def vocabulary(path: str) -> dict:
    """What encoding needs of a tokenizer file: ids of bytes within and at the end of words, merges by the pair of ids
    with rank and result, split pattern, special strings, names of ids."""
    spec = json.load(open(path, encoding="utf-8"))
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    ids, end = model["vocab"], model["end_of_word_suffix"] or ""
    letters = byte_letters()
    return {
        "first": [ids[c] for c in letters],  # a vocabulary that lacks a byte can't be used
        "last": [ids[c + end] for c in letters],
        "pairs": {ids[a] << 17 | ids[b]: (r, ids[a + b]) for r, (a, b) in reversed(list(enumerate(merges)))},
        "pattern": split.replace(r"\s", r"\p{White_Space}"),
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "names": {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]},
    }


class Encoder:
    """Encodes and decodes texts. Remembers the first ``most`` distinct words, and half as many chunks (runs without
    white space), which are most of any text."""

    def __init__(self, vocab: dict, most: int = 300_000):
        self.first, self.last, self.pairs, self.names, self.special = (vocab[k] for k in ("first", "last", "pairs", "names", "special"))
        self.words = regex.compile(vocab["pattern"])
        self.space = regex.compile(r"\p{White_Space}+")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.most = most
        self.known: dict[str, tuple[int, str, str] | None] = {}
        self.known_words: dict[str, tuple[int, str, str]] = {}

    def merged(self, word: str) -> list[int]:
        """Merge a word's symbols: a queue of (rank, place) over a doubly linked list, lowest rank first, then leftmost.

        ``wanted`` holds the merge that each place may make now; queued entries of another rank are stale, skipped."""
        data = word.encode()
        symbols = [self.first[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n, pairs = len(symbols), self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        wanted = [pairs.get(symbols[i] << 17 | symbols[i + 1]) for i in range(n - 1)] + [None]
        queue = [(m[0], i) for i, m in enumerate(wanted) if m]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            merge = wanted[i]
            if merge is None or merge[0] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            symbols[i], symbols[j], wanted[j], wanted[i] = merge[1], -1, None, None
            if k < n:
                before[k] = i
                wanted[i] = m = pairs.get(symbols[i] << 17 | symbols[k])
                if m:
                    heapq.heappush(queue, (m[0], i))
            h = before[i]
            if h >= 0:
                wanted[h] = m = pairs.get(symbols[h] << 17 | symbols[i])
                if m:
                    heapq.heappush(queue, (m[0], h))
        return [x for x in symbols if x >= 0]

    def word(self, word: str) -> tuple[int, str, str]:
        found = self.known_words.get(word)
        if found is None:
            ids = self.merged(word)
            found = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            if len(self.known_words) < self.most and len(word) <= 32:
                self.known_words[word] = found
        return found

    def chunk(self, text: str) -> tuple[int, str, str] | None:
        """Number of tokens, ids and token strings of a text without white space; None if it has no token."""
        folded = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        parts = [self.word(w) for w in self.words.findall(folded)]
        if len(parts) == 1:
            found = parts[0]
        elif parts:
            found = (sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))
        else:
            found = None
        if len(self.known) < self.most // 2 and len(text) <= 32:
            self.known[text] = found
        return found

    def plain(self, text: str) -> list[tuple[int, str, str]]:
        chunks = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [c for c in self.space.split(text) if c]
        known = self.known
        return [x for c in chunks if (x := known[c] if c in known else self.chunk(c))]

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, decimal ids joined by one space, decoded text (token strings joined by one space,
        since the file names no decoder). Special strings in the text are single tokens, found before folding."""
        if self.marks is None or not self.marks.search(text):
            parts = self.plain(text)
        else:
            parts, at = [], 0
            for m in self.marks.finditer(text):
                parts += [*self.plain(text[at : m.start()]), (1, str(self.special[m[0]]), m[0])]
                at = m.end()
            parts += self.plain(text[at:])
        return sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings of ids, joined by one space as the file names no decoder; unknown ids are left out. The decoding
        of a text is that of its words joined likewise, so that words are decoded once."""
        return " ".join([self.names[i] for i in ids if i in self.names])


def _encoded(batches, vocab, texts: bool, step: int = 500):
    encoder = Encoder(vocab.value)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for whole in batches:
        for at in range(0, whole.num_rows, step):  # outputs are larger than texts: a few at a time
            batch = whole.slice(at, step)
            out = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64())]
            if texts:
                columns += [pa.array([np.array(x[1].split(), np.int32) for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])
            else:
                columns += [pa.array([sha(x[1]) for x in out]), pa.array([sha(x[2]) for x in out])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, and ids and decoded text, or only their SHA-256 (``digests``).

    ``path`` is a BPE tokenizer file with a word end, read once by the driver and broadcast (a vocabulary: bounded).
    Texts are whole, each is encoded by itself, in a narrow map without a shuffle. Null text is empty: 0 tokens, no
    ids, empty decoded text. Null ids and rows that repeat an id are kept as they are; other columns are ignored;
    an empty table gives no rows.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda b: _encoded(b, vocab, not digests), f"doc_id {kind}, n_tokens long, {rest}")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """:func:`encode_documents` of all ``documents``, as digests; nulls, repeated rows and empty tables as there."""
    return encode_documents(table(spark, sf_dir, "documents"), word_bpe_path(), digests=True)

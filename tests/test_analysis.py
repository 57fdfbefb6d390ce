"""Stems of the published examples, and the readings of joined words."""

import re

import pytest
from pyspark.sql import functions as F

from docmill.functions.stemming import english_stem, porter
from docmill.operators import search

#: Examples of the algorithm's publication: word and stem.
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv
allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


@pytest.mark.parametrize(("word", "stem"), list(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True)))
def test_published_examples(word, stem):
    assert porter(word) == stem


def test_other_words_stay():
    assert [porter(w) for w in ("", "is", "as", "año", "a1s", "über", "by", "sss")] == ["", "is", "as", "año", "a1s", "über", "by", "sss"]


def test_stems_in_columns(spark):
    df = spark.createDataFrame([("ponies",), (None,), ("",), ("ponies",), ("irc-162",)], "t string")
    assert [r.s for r in df.select(english_stem(F.col("t")).alias("s")).collect()] == ["poni", None, "", "poni", "irc-162"]


def readings(text):
    """Plain Python: (pos, span, term) of a text."""
    out, pos = [], 0
    for word in re.findall(r"[^\W_]+(?:[-_.'’][^\W_]+)*", text.lower()):
        word = re.sub("['’]s$", "", word)
        parts = re.findall(r"[^\W_]+", word)
        out += [(pos + j, 1, p) for j, p in enumerate(parts)]
        if len(parts) > 1:
            out.append((pos, len(parts), word))
            at = 0
            while at < len(parts):
                end = at
                while end < len(parts) and parts[end].isdigit() == parts[at].isdigit():
                    end += 1
                if end - at > 1:
                    out.append((pos + at, end - at, "".join(parts[at:end])))
                at = end
        pos += len(parts)
    return sorted(out)


@pytest.mark.parametrize("text", ["IRC-162 of the act", "irc-162-163 x", "Anna's U.S.A. foo_bar 3.14.15-a-b2 9", "a-1-2-b-c-3", "'s -- ._ x", "it's b's-c", "", "ab"])
def test_word_graph(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    got = sorted((r.pos, r.span, r.term) for r in search.word_graph(df, ["k"], stopwords=()).collect())
    assert got == readings(text)


def test_parts_stand_where_analyze_puts_them(spark):
    """Phrases over parts match as before; stop words go but keep their places; null texts have no terms."""
    df = spark.createDataFrame([(1, "The foo_bar and IRC-162, ponies"), (2, None)], "k int, text string")
    graph = search.word_graph(df, ["k"], stem=english_stem)
    parts = sorted((r.pos, r.term) for r in graph.where("span = 1").collect())
    assert parts == sorted((r.pos, r.term) for r in search.analyze(df, ["k"], stem=english_stem).collect())
    assert (6, "poni") in parts and {r.term for r in graph.where("span > 1").collect()} == {"foo_bar", "foobar", "irc-162"}

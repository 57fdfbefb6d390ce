"""The default marks of pages without content, each on pages of both kinds."""

from pyspark.sql import functions as F

from docmill.functions.patterns import BOILERPLATE
from docmill.operators.checks import boilerplate


def plain(text):
    return any(m in text.upper() for m in BOILERPLATE) and (text.count("....") > 5 or text.count("----") > 5 or len(text) < 1200)


def test_all_marks(spark):
    fill = "words of a page " * 100
    texts = [t for m in BOILERPLATE for t in (m.lower(), m, f"{m} {fill}", f"{fill}{m.title()}" + " ...." * 6, f"{m}{fill}" + " ...." * 5, f"{m}{fill}" + "----" * 6)]
    texts += [fill, "short", "", "." * 40]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "n long, text string").orderBy("n").select(boilerplate(F.col("text"))).collect()]
    assert got == [plain(t) for t in texts] and set(got) == {True, False} and len(BOILERPLATE) == 17

"""English stems by Porter's published algorithm (An algorithm for suffix stripping, 1980, with the author's two later changes: bli and logi)."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.sources.stored import shipped

shipped(__name__)

# The endings of steps 2 to 4 and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x, y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _past(word: str) -> str:
    """Step 1b: eed, ed, ing."""
    end = _ending(word, ("eed", "ed", "ing"))
    stem = word.removesuffix(end or "")
    if end == "eed":
        return stem + "ee" if _measure(stem) > 0 else word
    if end is None or "v" not in _shape(stem):
        return word
    if stem.endswith(("at", "bl", "iz")) or (_measure(stem) == 1 and _short(stem)):
        return stem + "e"
    twice = len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"
    return stem[:-1] if twice and stem[-1] not in "lsz" else stem


@lru_cache(maxsize=1 << 18)
def porter(word: str) -> str:
    """The stem of a lower-case English word; words of one or two letters, and those with other signs than a to z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        end = _ending(word, rules)
        if end and _measure(word.removesuffix(end)) > 0:
            word = word.removesuffix(end) + rules[end]
    end = _ending(word, STEP_4)
    if end:
        stem = word.removesuffix(end)
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def english_stem(term: Column) -> Column:
    """Stems in Arrow batches: each distinct term of a batch once, and those that come again in a task are remembered, so that no term is
    shuffled for its stem (a join with a table of stems would be as uneven as the terms are). Null stays null."""
    @F.arrow_udf("string")
    def run(terms: pa.Array) -> pa.Array:
        coded = terms.cast(pa.string()).dictionary_encode()
        return pa.array([porter(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return run(term)

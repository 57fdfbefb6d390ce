"""Periodic runs of words in texts, found on a grammar of the text (Re-Pair), and texts without the repeats."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import WORD, packed, shipped, table

shipped(__name__)

#: Words that are worked on at once; a longer text is one piece.
_AT_ONCE = 400_000
_GRAM = 4


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each value's group (groups in order of value), and the groups' sizes."""
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return inverse, counts


def _pieces(ids: np.ndarray, unit: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of words that may hold runs: places in ``ids``, ids that no two pieces share, number of the piece.

    Every pair of neighbours within a run occurs twice in it, but for the middle one of a run of just two periods. So units
    (documents at first) are cut at pairs that they hold once, two stretches of at least half of ``least`` words on both sides of such a
    pair stay together, and what is left is a unit of the next pass. A text without near repeats is gone after a pass or two."""
    place, half = np.arange(len(ids)), least // 2
    while len(place):
        n = len(place)
        often = np.bincount(ids)[ids] > 1
        pair = np.flatnonzero((unit[1:] == unit[:-1]) & often[1:] & often[:-1])
        group, size = _groups(ids[pair] * n + ids[pair + 1])
        joined = np.zeros(n, bool)  # with the word before
        joined[pair[size[group] > 1] + 1] = True
        start = np.flatnonzero(~joined)
        length = np.diff(np.r_[start, n])
        long = length >= half
        first, last = start, np.r_[start[1:], n]
        chained = np.r_[False, long[1:] & long[:-1] & (unit[first[1:]] == unit[first[:-1]])]
        cluster = np.cumsum(~chained) - 1
        total = np.bincount(cluster, np.where(long, length, 0)).astype(np.int64)
        kept = long & (total[cluster] >= least)
        keep = np.repeat(kept, last - first)
        new = np.repeat(cluster, last - first)[keep]
        place, ids, unit = place[keep], ids[keep], np.unique(new, return_inverse=True)[1]
        if len(place):
            ids = np.unique(unit * n + ids, return_inverse=True)[1]
        if len(place) == n:
            break
    return place, ids, unit


def grammar(ids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """left, right, size of each symbol (left is -1 for words), and each unit's root: Re-Pair of all units at once.

    Frequent pairs become symbols, the most frequent first; pairs that don't touch a more frequent one are replaced in the same round, which
    is the same as one after the other. What is left when no pair occurs twice is paired evenly."""
    words = int(ids.max()) + 1
    left, right, size = [np.full(words, -1)], [np.full(words, -1)], [np.ones(words, np.int64)]
    symbols, seq, unit = words, ids.copy(), unit.copy()
    repeats = True
    while True:
        inner = unit[1:] == unit[:-1]
        if not inner.any():
            break
        if repeats:
            # of overlapping equal pairs (x x x) every second counts
            same = np.r_[False, inner & (seq[1:] == seq[:-1])]
            at = np.arange(len(seq))
            began = np.maximum.accumulate(np.where(same, 0, at))
            able = np.flatnonzero(inner & ~(same[1:] & ((at - began)[:-1] % 2 == 1)))
            group, n = _groups(seq[able] * symbols + seq[able + 1])
            spread = (np.arange(len(n)) * 0x9E3779B1) & 0xFFFFFFFF
            rank = np.empty(len(n), np.int64)
            rank[np.lexsort((spread, n))] = np.arange(1, len(n) + 1)
            rank[n < 2] = 0
            here = np.zeros(len(seq) + 1, np.int64)
            here[able + 1] = rank[group]  # shifted by one
            mine = here[able + 1]
            beaten = (mine == 0) | (here[able] > mine) | (np.r_[here[1:], 0][able + 1] > mine)
            lost = np.bincount(group, beaten, len(n)) > 0
            taken = able[~lost[group]]
            name = np.cumsum(~lost)[group[~lost[group]]] - 1 if len(taken) else taken
            if not len(taken):
                repeats = False
                continue
        else:
            at = np.arange(len(seq)) - np.searchsorted(unit, unit)
            taken = np.flatnonzero(inner & (at[:-1] % 2 == 0))
            name = np.arange(len(taken))
        known, first = np.unique(name, return_index=True)
        a, b = seq[taken[first]], seq[taken[first] + 1]
        sizes = np.concatenate(size)
        left.append(a)
        right.append(b)
        size = [sizes, sizes[a] + sizes[b]]
        seq[taken] = symbols + name
        keep = np.ones(len(seq), bool)
        keep[taken + 1] = False
        seq, unit = seq[keep], unit[keep]
        symbols += len(known)
    return np.concatenate(left), np.concatenate(right), np.concatenate(size), seq


def _derived(left: np.ndarray, right: np.ndarray, size: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and first place of every inner node of the derivation."""
    place = np.r_[0, np.cumsum(size[roots])[:-1]]
    found, symbol = [], roots
    while len(symbol):
        inner = left[symbol] >= 0
        symbol, place = symbol[inner], place[inner]
        found.append((symbol, place))
        symbol, place = np.r_[left[symbol], right[symbol]], np.r_[place, place + size[left[symbol]]]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _ranks(ids: np.ndarray, unit: np.ndarray) -> list[np.ndarray]:
    """For each power of two the rank of the words from a place on (of no other's rank where the unit ends before)."""
    end = np.searchsorted(unit, unit, "right")
    at, out, width = np.arange(len(ids)), [ids], 1
    longest = int((end - at).max())
    while 2 * width <= longest:
        whole = at + 2 * width <= end
        key = np.where(whole, out[-1] * (len(ids) + 1) + out[-1][np.minimum(at + width, len(ids) - 1)], -1 - at)
        out.append(np.unique(key, return_inverse=True)[1])
        width *= 2
    return out


def _each(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every integer from ``low`` up to ``high`` of each row."""
    n = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _crossing(symbol_at: tuple[np.ndarray, ...], ranks: list[np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """Runs within a symbol's text that cross the boundary of its two halves: number of the symbol, first place, length, period.

    Such a run has a whole period before or after the boundary and half of ``least`` equal words at least at that distance, so four of them that start or end
    beside the boundary stand again at that distance. Each of these distances is extended to both sides as far as the symbol's text goes."""
    s, b, e = symbol_at
    n = len(ranks[0])
    gram = ranks[_GRAM.bit_length() - 1]
    order = np.argsort(gram, kind="stable")
    key = gram[order] * (n + 1) + order
    half = (e - s) // 2
    found = []
    for anchor, shift, ahead in ((b - _GRAM, _GRAM - 1, True), (b - 1, 0, True), (b - _GRAM + 1, _GRAM - 1, False), (b, 0, False)):
        ok = np.flatnonzero((anchor >= s) & (anchor + _GRAM <= e))
        x = anchor[ok]
        low, high = (x + 1, np.minimum(x + half[ok], e[ok] - _GRAM)) if ahead else (np.maximum(x - half[ok], s[ok]), x - 1)
        g = gram[x] * (n + 1)
        row, k = _each(np.searchsorted(key, g + low), np.searchsorted(key, g + high, "right"))
        at, other = x[row], order[k]
        found.append((ok[row], np.minimum(at, other) + shift, np.abs(at - other)))
    who, i, q = (np.concatenate([f[c] for f in found]) for c in range(3))
    low, high = s[who], e[who]
    f, g = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        w, r = 1 << k, ranks[k]
        ok = i + q + f + w <= high
        f += w * (ok & (r[np.where(ok, i + f, 0)] == r[np.where(ok, i + q + f, 0)]))
        ok = i - g - w >= low
        g += w * (ok & (r[np.where(ok, i - g - w, 0)] == r[np.where(ok, i + q - g - w, 0)]))
    length = f + g + q
    good = (length >= np.maximum(least, 2 * q)) & (f > 0)
    return who[good], (i - g)[good], length[good], q[good]


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that overlap by a period are one run; of equal intervals the smallest period is the run's."""
    order = np.lexsort((end, start, period))
    start, end, period = start[order], end[order], period[order]
    far = int(end.max()) + 1
    group = np.unique(period, return_inverse=True)[1] * far
    reach = np.maximum.accumulate(group + end)
    new = np.r_[True, (group[1:] != group[:-1]) | (group[1:] + start[1:] + period[1:] > reach[:-1])]
    first = np.flatnonzero(new)
    start, end, period = start[first], np.maximum.reduceat(end, first), period[first]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    once = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
    return start[once], end[once], period[once]


def runs_of(ids: np.ndarray, unit: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, end (exclusive) and smallest period of every run of ``least`` words or more and two periods or more, by first place and
    period; ``ids`` name the words (no id in two units), ``unit`` rises and names their texts."""
    place, ids, unit = _pieces(ids, unit, least)
    if not len(place):
        return place, place, place
    left, right, size, roots = grammar(ids, unit)
    symbol, at = _derived(left, right, size, roots)
    big = size[symbol] >= least
    symbol, at = symbol[big], at[big]
    order = np.argsort(symbol, kind="stable")
    symbol, at = symbol[order], at[order]
    names, first, times = np.unique(symbol, return_index=True, return_counts=True)
    s = at[first]
    who, begin, length, period = _crossing((s, s + size[left[names]], s + size[names]), _ranks(ids, unit), least)
    if not len(who):
        return who, who, who
    row, k = _each(first[who], first[who] + times[who])  # from the symbol's first place to all of its places
    begin = begin[row] - s[who[row]] + at[k]
    start, end, period = _merged(begin, begin + length[row], period[row])
    return place[start], place[end - 1] + 1, period


def _found(least: int):
    def work(batch, texts):
        split = [t.split() for t in texts]  # of bytes: at ASCII white space
        sizes = np.array([len(w) for w in split], np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        ids = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(map({}.setdefault, w, count(at)), np.int64, len(w)) for w, at in zip(split, starts.tolist(), strict=False)]])
        start, end, period = runs_of(ids, np.repeat(np.arange(len(split)), sizes), least)
        owner = np.searchsorted(starts, start, "right") - 1
        runs, short = [[] for _ in split], [b" ".join(w) for w in split]
        if len(start):
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            kept = np.cumsum(change[:-1]) == 0
            for d, a, z, q in zip(owner.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
                runs[d].append({"start": a - int(starts[d]), "length": z - a, "period": q})
            for d in np.unique(owner).tolist():
                short[d] = b" ".join([w for w, k in zip(split[d], kept[starts[d] : starts[d + 1]].tolist(), strict=True) if k])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(sizes), pa.array(runs, kind), pa.array(short, pa.binary()).cast(pa.string())], ["_doc", "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            at = held = 0
            for i, t in enumerate(texts):
                held += len(t) // 4
                if held >= _AT_ONCE or i + 1 == len(texts):
                    yield work(batch.slice(at, i + 1 - at), texts[at : i + 1])
                    at, held = i + 1, 0

    return run


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """Adds to every row n_words, runs (an array of start, length, period in words, by start, then period) and collapsed (the words that no
    run repeats, joined by one space).

    A run is a stretch of words that are equal to those a period before, as far as that goes: of its smallest period, two periods and ``least`` words
    (12 at least) long or longer. Its words after the first period are repeats. Words are told apart exactly, by case too. Null texts are empty; texts
    without words have no runs and an empty collapsed text; repeated rows and null ids keep rows of their own; columns of the input stay, those of the
    added names are replaced; an empty table gives no rows. Each text is worked on as a whole; a task holds a few hundred thousand words (or one text) and, for what it repeats, about log2 ids a word."""
    if least < 12:
        raise ValueError("runs of fewer than 12 words are not looked for")
    own = docs.drop("n_words", "runs", "collapsed")
    rows = packed(own).select("_doc", F.coalesce(F.col("_doc.text"), F.lit("")).alias("text"))
    slim = F.struct(*[F.col(f"_doc.`{c}`").alias(c) for c in own.columns])
    kind = docs.sparkSession.createDataFrame([], own.schema).select(F.struct(*[f"`{c}`" for c in own.columns]).alias("_doc")).schema["_doc"].dataType.simpleString()
    made = rows.select(slim.alias("_doc"), "text").mapInArrow(_found(least), f"_doc {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return made.select("_doc.*", "n_words", "runs", "collapsed")


def rotated(text: Column, h: Column) -> Column:
    """The words of a text, from a place on replaced by repeats of the first few of these, as ``h`` tells; one space between words."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, F.greatest(p, F.lit(1))), times)), F.lit(1), F.greatest(n - a, F.lit(0)))
    return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise("")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """:func:`periodic_runs` of all ``documents``, a tenth of which (by the hash of their ids) get periodic ends first; as digests.
    A null id has no hash, so its text stays as it is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string"))
    found = periodic_runs(docs.select("doc_id", F.when(h % 10 == 0, rotated(F.col("text"), h)).otherwise(F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    out = found.select("doc_id", "runs", "collapsed", best.alias("b"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"),
        F.floor(1000 * F.col("b.length") / -F.col("b.p")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

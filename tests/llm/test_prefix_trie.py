"""The trie of conversations held against SQL on the tables, and against plain Python on other splits, blocks and odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from docmill.llm.prefix_trie import OP12_SQL, _packs, op12_prefix_trie, prefix_trie, sequences, trie, with_shared_heads

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def plain(convs):
    """Nodes of the trie of conv to list of (role, text), by a dictionary of all beginnings."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(SPACES.findall(k[-1][1])) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(convs[c]) == len(k)).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(k)) for k, m in members.items())


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def some():
    """Copies, beginnings of others, one long conversation, and ones that share a lot of it."""
    convs = {}
    for c in range(160):
        n = c % 7
        convs[c] = [("user" if i % 2 == 0 else "assistant", f"turn {i} of {(c % 5) if i else 0} {'x ' * (c % 3)}") for i in range(n + 1)]
    long = [("user", f"again {i % 4} {i}") for i in range(70)]
    for c, n in ((200, 70), (201, 70), (202, 40), (203, 41), (204, 8), (205, 16), (206, 16), (207, 24)):
        convs[c] = long[:n] + ([("user", f"own {c}")] * 3 if c % 2 else [])
    convs |= {300 + c: [("user", "same"), ("assistant", "same too")] for c in range(90)}
    return convs


def frame(spark, convs):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def test_sql(spark, sf_dir, same_as_sql):
    same_as_sql(op12_prefix_trie(spark, sf_dir), OP12_SQL)


@pytest.mark.parametrize(("block", "per"), [(4096, 1000), (4096, 9), (8, 9), (3, 40)])
def test_splits_and_blocks(spark, block, per):
    convs = some()
    turns = frame(spark, convs)
    assert rows_of(trie(sequences(turns, block, 30), block, per)) == plain(convs)


def test_shared_heads(spark):
    convs = {c: t for c, t in some().items() if c not in (40, 60)} | {61: [("a", "b")]}
    turns = frame(spark, convs)
    assert rows_of(trie(with_shared_heads(sequences(turns, 2, 30)), 8, 20)) == plain(rebuilt(convs))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "b c"), (1, None, None, None), (None, 1, "user", "x"), (2, 1, "", ""), (2, 0, None, ""), (2, 5, "user", "b c"), (-3, 1, "user", "Ü 😀 " * 3000)]
    turns = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, n int")
    convs = {1: [("", ""), ("", ""), ("user", "b c")], 2: [("", ""), ("", ""), ("user", "b c")], -3: [("user", "Ü 😀 " * 3000)]}
    assert rows_of(prefix_trie(turns)) == plain(convs)
    assert prefix_trie(turns.limit(0)).count() == 0


def test_packs_go_on_over_batches():
    import pyarrow as pa

    def batch(convs):
        n = len(convs)
        return pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(["d" * 32] * n), pa.array([1] * n, pa.int32()), pa.array([0] * n, pa.int32())], ["conv", "digest", "words", "part"])

    out = [(r["conv"], r["at"], r["n"]) for b in _packs(2)([batch([1, 1, 1]), batch([1, 2]), batch([2])]) for r in b.to_pylist()]
    assert out == [(1, 0, 2), (1, 2, 1), (1, 3, 1), (2, 0, 1), (2, 1, 1)]

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.word_bpe_path()


@pytest.fixture(scope="module")
def pair():
    return bpe.Encoder(bpe.vocabulary(PATH)), tokenizers.Tokenizer.from_file(PATH)


def agree(pair, text):
    own, theirs = pair
    n, ids, decoded = own.encode(text)
    want = theirs.encode(text, add_special_tokens=False).ids
    assert [int(x) for x in ids.split()] == want and n == len(want)
    assert decoded == theirs.decode(want, skip_special_tokens=False) == own.decode(want)


@pytest.mark.parametrize("text", ["", " ", "Hello  World's\nit'S 123 x_y", "ΑΣ ΟΔΟΣ Straße İstanbul", "a<|endoftext|>B <|startoftext|>", "é ﬁ ½ ²", "\x1c\x85​　 a\x00b", "日本語テキスト 😀😀", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "I'LL we'Ve '''s"])
def test_known(pair, text):
    agree(pair, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cn"]), max_size=60))
def test_any_text(pair, text):
    agree(pair, text)


def test_documents(spark, sf_dir, pair):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = bpe.op3_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = pair[1].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(pair[1].decode(ids, skip_special_tokens=False)))


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, "a a", "y"), (1, "", "z")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in bpe.encode_documents(rows, PATH).collect()), key=str)
    assert [(x[0], x[1], x[3]) for x in got] == [(1, 0, ""), (1, 0, ""), (None, 2, "a</w> a</w>")]
    assert bpe.encode_documents(rows.limit(0), PATH).count() == 0

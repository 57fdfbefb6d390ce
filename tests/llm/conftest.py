import duckdb
import pytest


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, further columns with names the operators use."""
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (1, "The same words here, five or more of them.", "en", "a"), (2, "the SAME words here, five or more of them.", "en", "a"), (2, "the SAME words here, five or more of them.", "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (5, "  \n ", "de", "b"), (6, "one", "de", None), (None, "no id but text", "en", "c"), (None, None, None, None), (7, long, "en", "c"), (8, long + "x", "en", "c"), (9, "Ünïcode ß 😀 text Éa", "fr", "a"),
    ]
    names = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame([(*r, 7, "k", 1, 2, "z") for r in rows], f"{names}, size int, key string, node int, rank int, text_sha256 string")


@pytest.fixture(scope="session")
def same_as_sql(duck):
    def check(df, sql):
        plain = lambda v: round(v, 6) if isinstance(v, float) else v
        columns = sorted(df.columns)
        got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)

    return check

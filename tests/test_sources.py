import json

from pyspark.sql import functions as F

from docmill.operators import golden
from docmill.sources import files
from docmill.sources.tables import upsert


def tree(root):
    for name, data in {"dataset/Tax/a_b-1.pdf": b"one", "dataset/Tax/.hidden.pdf": b"x", "dataset/Acts/sub/c.PDF": b"one", "dataset/Acts/d.txt": b"no", "dataset/Acts/e.pdf": b""}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root / "dataset")


def test_registry_round_trip(spark, tmp_path):
    root = tree(tmp_path)
    found = files.scan_files(spark, root)
    pages = spark.createDataFrame([("Tax/a_b-1.pdf", 1), ("Tax/a_b-1.pdf", 2), ("Acts/sub/c.PDF", 1)], "relative_path string, page_number int")
    reg = files.file_registry(found, "dataset", pages)
    got = {r.relative_path: r for r in reg.collect()}
    assert set(got) == {"Tax/a_b-1.pdf", "Acts/sub/c.PDF", "Acts/e.pdf"}
    assert got["Tax/a_b-1.pdf"].status == "valid" and got["Tax/a_b-1.pdf"].pages == 2 and got["Tax/a_b-1.pdf"].title == "A B 1" and got["Tax/a_b-1.pdf"].category == "Tax"
    assert got["Acts/e.pdf"].status == "invalid" and got["Acts/e.pdf"].error_message == "File is empty"
    files.write_registry(reg, str(tmp_path / "out"))
    back = files.read_registry_csv(spark, str(tmp_path / "out/csv"))
    assert {r.document_id for r in back.collect()} == {r.document_id for r in got.values()}
    assert spark.read.json(str(tmp_path / "out/summary")).first().total == 3


def test_pages_and_chunks(spark, tmp_path):
    pages = spark.createDataFrame([("d1", "a.pdf", "Tax", 2, "two"), ("d1", "a.pdf", "Tax", 1, "one")], "document_id string, document_name string, category string, page_number int, text string")
    files.write_pages_json(pages, str(tmp_path / "pages"))
    assert sorted((r.page_number, r.text) for r in files.read_pages_json(spark, str(tmp_path / "pages/*")).collect()) == [(1, "one"), (2, "two")]
    folder = tmp_path / "chunks"
    folder.mkdir()
    (folder / "a_chunks.json").write_text(json.dumps([{"chunk_id": "c1", "document_id": "d", "page": 1, "text": "t1", "chunk_index": 0}]))
    (folder / "b_chunks.json").write_text(json.dumps({"metadata": {}, "chunks": [{"chunk_id": "c2", "document_id": "d", "page_number": 2, "chunk_text": "t2", "chunk_index": 0}]}))
    (folder / "c_chunks.json").write_text("{no json")
    (folder / "d.json").write_text(json.dumps([{"chunk_id": "c9"}]))
    got = {r.chunk_id: (r.page_number, r.text) for r in files.corpus_load_all(spark, str(folder)).collect()}
    assert got == {"c1": (1, "t1"), "c2": (2, "t2")}
    chunks = files.corpus_load_all(spark, str(folder)).withColumns({"category": F.lit("Tax"), "document_name": F.lit("a.pdf")})
    files.write_chunks(chunks, str(tmp_path / "store"))
    files.write_chunks(chunks, str(tmp_path / "json"), "json")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2 and files.read_chunks_json(spark, str(tmp_path / "json")).count() == 2
    assert files.document_of(spark, str(tmp_path / "store"), "chunk_id", "c1").count() == 1


def test_golden_csv(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("﻿Question;Answer;Source;Page;Type\nWhat, is X?;a;f.pdf;3;Tax\n;;;;\n", encoding="utf-8")
    rows = files.read_golden_csv(spark, str(p))
    assert rows.columns == ["query", "expected_answer", "source_document", "page_number", "category", "row_number"]
    valid = golden.validate_rows(rows, ["Tax"])
    files.write_golden(valid, str(tmp_path / "golden"))
    assert spark.read.option("header", True).csv(str(tmp_path / "golden/csv")).count() == valid.where("status <> 'rejected'").count() == 1


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5)], "qid int, mrr double")
    for run in ("2024-01-01", "2024-02-01"):
        files.write_eval_report(rows, rows.select(F.avg("mrr").alias("mrr")), str(tmp_path), run)
    assert str(files.latest_run(spark, str(tmp_path)).first().run) == "2024-02-01"
    files.write_tables(str(tmp_path / "g"), nodes=rows, edges=rows)
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 1


def test_upsert_twice(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    once = upsert(old, new, ["k"])
    assert sorted(map(tuple, upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_golden_files_in_any_encoding(spark, tmp_path):
    """Each file by its own encoding and delimiter; files that can't be read are rows with an error."""
    text = "Question;Ground_Truth;Doc;odd\n\"Wo ist die Tür;\nhier?\";é;a.pdf;x\nb;;;\n"
    for name, encoding in (("a.csv", "utf-8"), ("b.csv", "utf-8-sig"), ("c.csv", "utf-16"), ("sub/d.CSV", "latin-1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode(encoding))
    (tmp_path / "long.csv").write_text("query,answer\n" + "q" * 300_000 + ",a\n")
    (tmp_path / "broken.csv").write_bytes("query,answer\n".encode("utf-16") + b"x")
    (tmp_path / "nothing.csv").write_bytes(b"")
    (tmp_path / "unknown.csv").write_text("foo,bar\n1,2\n")
    (tmp_path / "head.csv").write_text("query,answer\n")
    (tmp_path / "no.txt").write_text("query\nx\n")
    rows = files.read_golden_files(spark, str(tmp_path)).collect()
    of = lambda name: sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.row_number or 0)
    for name, encoding in (("a.csv", "utf-8-sig"), ("b.csv", "utf-8-sig"), ("c.csv", "utf-16"), ("d.CSV", "latin-1")):
        got = [(r.encoding, r.error, r.row_number, r.query, r.expected_answer, r.source_document) for r in of(f"/{name}")]
        assert got == [(encoding, None, 2, "Wo ist die Tür;\nhier?", "é", "a.pdf"), (encoding, None, 3, "b", None, None)]
    assert [len(r.query) for r in of("long.csv")] == [300_000] and of("head.csv") == [] and of("no.txt") == []
    assert [len(of(n)) for n in ("broken.csv", "nothing.csv", "unknown.csv")] == [1, 1, 1]
    assert "Unicode" in of("broken.csv")[0].error and all("no header" in of(n)[0].error for n in ("nothing.csv", "unknown.csv"))

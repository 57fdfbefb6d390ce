"""Files in and out: folders of files, registry CSV, parsed pages, chunk JSON, question CSV, reports."""

from __future__ import annotations

import codecs
import csv
import io
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import schemas
from docmill.functions import text as fx
from docmill.operators.checks import file_status
from docmill.sources.stored import shipped

shipped(__name__)


def scan_files(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """One row per file below ``root`` with that suffix (any case), hidden files left out; content stays on executors.

    Spark lists empty files but gives no rows for them, so listed paths without a row get one of length 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = [(unquote(p),) for p in files.inputFiles() if p.lower().endswith(f".{suffix}")]
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    read = files.withColumn("path", plain(F.col("path")))
    empty = spark.createDataFrame(listed, "path string").select(plain(F.col("path")).alias("path")).join(read.select("path"), "path", "left_anti")
    rows = read.unionByName(empty.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("file_name", name).where(F.lower("file_name").endswith(f".{suffix}") & ~F.col("file_name").startswith("."))


def file_registry(files: DataFrame, root_name: str, pages: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """File records: ids, title, paths, size, checksum, status. A bad file is a row with a status.

    ``pages`` (relative_path, page_number) gives page counts, ``errors`` (relative_path, error_message) what failed."""
    own = files.select("file_name", F.col("path").alias("file_path"), fx.relative_path(F.col("path"), root_name).alias("relative_path"), fx.detect_category(F.col("path"), root_name).alias("category"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("checksum_sha256"), F.col("modificationTime").alias("modified_at"))
    count = (pages if pages is not None else own.limit(0).select("relative_path", F.lit(0).alias("page_number"))).groupBy("relative_path").agg(F.max("page_number").alias("pages"))
    own = own.join(count, "relative_path", "left")
    own = own.join(errors, "relative_path", "left") if errors is not None else own.withColumn("error_message", F.lit(None).cast("string"))
    error = F.when(F.col("file_size_bytes") == 0, F.coalesce("error_message", F.lit("File is empty"))).otherwise(F.col("error_message"))
    made = {"document_id": fx.document_id(F.col("checksum_sha256"), F.col("relative_path")), "title": fx.derive_title(F.col("file_name")), "file_size_mb": fx.size_mb(F.col("file_size_bytes")), "status": file_status(F.col("pages"), error), "error_message": error, "created_at": F.col("modified_at"), "is_duplicate_of": F.lit(None).cast("string")}
    names = [c.split(" ")[0] for c in schemas.REGISTRY.split(", ")]
    return own.withColumns(made).select(*names)


def write_registry(registry: DataFrame, path: str) -> None:
    """CSV with the fixed columns, Parquet, and a one-row JSON summary, in three folders below ``path``."""
    from docmill.operators.aggregate import dataset_statistics

    names = [c.split(" ")[0] for c in schemas.REGISTRY.split(", ")]
    registry.select(*names).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    registry.select(*names).write.mode("overwrite").parquet(f"{path}/parquet")
    numbered = registry.withColumn("document_id", F.xxhash64("document_id"))
    dataset_statistics(numbered).write.mode("overwrite").json(f"{path}/summary")


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows; a byte order mark before the first header is harmless, columns go by position."""
    return spark.read.csv(path, header=True, schema=schemas.REGISTRY, enforceSchema=True)


def read_pages_json(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents (one object a file) to one row per page; ``page`` and ``page_number`` are both read."""
    docs = spark.read.schema(schemas.PARSED).option("multiLine", True).json(path)
    p = docs.select("document_id", "document_name", "category", F.explode("pages").alias("p"))
    return p.select("document_id", "document_name", "category", F.coalesce("p.page_number", "p.page").alias("page_number"), "p.text")


def write_pages_json(pages: DataFrame, path: str) -> None:
    """One object per document with its pages in order, in folders by category."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("page_number", "text"))), lambda x: F.struct(x["page_number"].alias("page"), x["text"].alias("text")))
    docs = pages.groupBy("document_id", "document_name", "category").agg(listed.alias("pages"))
    docs.withColumn("folder", F.col("category")).write.mode("overwrite").partitionBy("folder").json(path)


def _chunk_rows(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", "document_id", "document_name", "category", F.coalesce("page_number", "page").alias("page_number"), "chunk_index", F.coalesce("text", "chunk_text").alias("text"), "metadata")


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files of both shapes: a list of chunks, or an object with ``chunks``; files that are no JSON are skipped."""
    wide = f"{schemas.CHUNK}, chunks array<struct<{', '.join(c.replace(' ', ':', 1) for c in schemas.CHUNK.split(', '))}>>"
    rows = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("_file", F.input_file_name())
    inner = rows.where("chunks IS NOT NULL").select(F.inline("chunks"))
    return _chunk_rows(inner).unionByName(_chunk_rows(rows.where("chunks IS NULL AND chunk_id IS NOT NULL")))


def write_chunks(chunks: DataFrame, path: str, kind: str = "parquet") -> None:
    """The native store is Parquet by category; JSON holds one object a document with its chunks."""
    if kind == "parquet":
        chunks.write.mode("overwrite").partitionBy("category").parquet(path)
        return
    listed = F.sort_array(F.collect_list(F.struct("page_number", "chunk_index", "chunk_id", "document_id", "document_name", "category", "text")))
    chunks.groupBy("document_id").agg(listed.alias("chunks")).select("chunks").write.mode("overwrite").json(path)


def corpus_load_all(spark: SparkSession, folder: str) -> DataFrame:
    """All chunk files of a folder: ``*_chunks.json``, or every ``*.json`` where there is none of that name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_chunks.json").option("recursiveFileLookup", True).load(folder)
    some = bool(files.select("path").take(1))
    return read_chunks_json(spark, f"{folder}/*_chunks.json" if some else f"{folder}/*.json")


def read_golden_csv(spark: SparkSession, path: str, encoding: str = "utf-8", delimiters: str = ",;\t|") -> DataFrame:
    """Question rows as strings under canonical names, numbered from 2; the delimiter is the most frequent in the header."""
    from docmill.operators.golden import canonical_columns

    head = spark.read.option("encoding", encoding).csv(path, sep="\x00").first()  # the header line
    line = head[0] if head else ""
    best = max(delimiters, key=lambda d: (line.count(d), -delimiters.index(d)))
    rows = spark.read.option("encoding", encoding).option("multiLine", True).csv(path, header=True, sep=best)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return canonical_columns(rows).withColumn("row_number", F.monotonically_increasing_id() + 2)


def _decoded(content: bytes) -> tuple[str, str]:
    """Text and encoding: by its mark, as UTF-8 where it is that, else Latin-1 (which any bytes are, so nothing comes after it)."""
    if content[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        return content.decode("utf-16"), "utf-16"
    try:
        return content.decode("utf-8-sig"), "utf-8-sig"
    except UnicodeDecodeError:
        return content.decode("latin-1"), "latin-1"


def _question_rows(content: bytes, names: dict[str, str], delimiters: str) -> tuple[str, list[dict]]:
    text, encoding = _decoded(content)
    head = text.partition("\n")[0]
    best = max(delimiters, key=lambda d: (head.count(d), -delimiters.index(d)))
    csv.field_size_limit(2**31 - 1)  # whole fields
    lines = csv.reader(io.StringIO(text, newline=""), delimiter=best)
    header = [names.get(h.strip().lower()) for h in next(lines, [])]
    if not any(header):
        raise ValueError("no header row")
    rows = []
    for cells in lines:
        row = {}
        for name, cell in zip(header, cells, strict=False):
            if name is not None:
                row.setdefault(name, cell or None)
        rows.append(row)
    return encoding, rows


def read_golden_files(spark: SparkSession, root: str, delimiters: str = ",;\t|") -> DataFrame:
    """Question rows of all CSV files below ``root``: path, encoding, error, row_number (from 2) and the canonical columns as strings.

    Encoding, delimiter and header are each file's own, and files are read by executors, each in a task's batch. A file that can't be read
    (a broken encoding, no header, no bytes) is one row with an error; a file with only a header has none."""
    import pyarrow as pa

    from docmill.functions.patterns import COLUMN_ALIASES

    names = {alias: name for name, aliases in COLUMN_ALIASES.items() for alias in aliases}
    columns = list(COLUMN_ALIASES)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    encoding, rows = _question_rows(content, names, delimiters)
                    out = [{"path": path, "encoding": encoding, "row_number": i, **row} for i, row in enumerate(rows, 2)]
                except (ValueError, csv.Error) as e:  # the file fails, not the job
                    out = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("path", pa.string()), ("encoding", pa.string()), ("error", pa.string()), ("row_number", pa.int64()), *[(c, pa.string()) for c in columns]])
    told = "path string, encoding string, error string, row_number long, " + ", ".join(f"{c} string" for c in columns)
    return scan_files(spark, root, "csv").select("path", "content").mapInArrow(run, told)


def write_golden(rows: DataFrame, path: str) -> None:
    """Rows that are not rejected, 13 fixed columns, as CSV; the validation report and statistics as JSON."""
    from docmill.operators.aggregate import golden_statistics, validation_report

    own = rows.withColumns({c: F.lit(None).cast("string") for c in schemas.GOLDEN_OUT if c not in rows.columns and not c.endswith("_length")})
    own = own.withColumns({"query_length": F.length("query"), "answer_length": F.length("expected_answer")})
    own.where("status <> 'rejected'").select(*schemas.GOLDEN_OUT).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    validation_report(rows).write.mode("overwrite").json(f"{path}/report")
    golden_statistics(rows).write.mode("overwrite").json(f"{path}/statistics")


def write_eval_report(rows: DataFrame, summary: DataFrame, path: str, run: str) -> None:
    """Evaluation rows (CSV) and summary (JSON) of one run, in folders by run."""
    rows.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").option("header", True).csv(f"{path}/rows")
    summary.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").json(f"{path}/summary")


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last run."""
    rows = spark.read.json(f"{path}/summary")
    last = rows.agg(F.max("run").alias("run"))
    return rows.join(F.broadcast(last), "run")


def write_tables(path: str, **tables: DataFrame) -> None:
    """Knowledge or graph tables as Parquet, each replaced as a whole by Spark's committer."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def document_of(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """Rows of one id; the filter reaches the Parquet scan."""
    condition: Column = F.col(key) == value
    return spark.read.parquet(path).where(condition)

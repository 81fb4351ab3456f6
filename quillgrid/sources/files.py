"""Files as rows: listing, classification, pages of text, incremental selection."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that hold no documents, and suffixes by kind.
EXCLUDED_DIRS = ".git node_modules site-packages __pycache__ __MACOSX .envs .venv venv .model_cache .mypy_cache .pytest_cache dist-info .next .cache Lib".split()
TEXT_SUFFIXES = ".md .txt .csv .json .jsonl .yaml .yml .html .htm .py .js .ts .tsx .r .do .sql .sh .ps1 .log .tex .bib .ini .cfg .toml .xml .rst .tsv".split()
OFFICE_SUFFIXES = ".docx .xlsx .pptx".split()
MAX_BYTES = 300 * 1024 * 1024
RETRIED = ["failed_timeout", "failed_parser", "failed_corrupt", "failed_permission", "zero_byte", "skipped_too_large"]
FIRST_PAGE = 1


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(rel, size, mtime, content) of every file below root; content is read only where it is used.

    Spark's reader has no rows for empty files; they are found by name in its own file index. It skips names that start with a dot or
    an underscore altogether, so those are not counted as excluded either.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    start = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    path = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^[a-z]+:/*", "/")
    rel = F.substring(path, F.length(start) + 2, F.length(path)).alias("rel")
    names = spark.createDataFrame([(p,) for p in base.inputFiles()], "path string").select(rel)
    found = base.select(rel, F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    empty = names.join(found.select("rel"), "rel", "left_anti").select("rel", F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(b"").alias("content"))
    return found.unionByName(empty)


def is_excluded(rel: Column, top: list[str] | None = None) -> Column:
    """Dependency directories anywhere, the tool's own files, and named top-level directories."""
    parts = F.split(rel, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    out = F.arrays_overlap(dirs, F.array(*map(F.lit, EXCLUDED_DIRS))) | F.startswith(rel, F.lit(".claude/")) | (rel == "CLAUDE.md")
    return out | F.get(parts, F.lit(0)).isin(top) & (F.size(parts) > 1) if top else out


def walk(files: DataFrame, top: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept and excluded files."""
    return files.where(~is_excluded(F.col("rel"), top)), files.where(is_excluded(F.col("rel"), top))


def suffix(rel: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(rel, "/"), -1), r"(?<=.)(\.[^.]*)$", 1))


def kind(rel: Column) -> Column:
    """text, pdf, office or unsupported_type; a file without a suffix is text."""
    own = suffix(rel)
    return F.when(own.isin(*TEXT_SUFFIXES) | (own == ""), "text").when(own == ".pdf", "pdf").when(own.isin(*OFFICE_SUFFIXES), "office").otherwise("unsupported_type")


def size_gate(size: Column) -> Column:
    return F.when(size == 0, "zero_byte").when(size > MAX_BYTES, "skipped_too_large")


def content_hash(content: Column, size: Column) -> Column:
    """sha256; of large files the first and last 32 MiB and the size."""
    half = 32 << 20
    cut = F.concat(F.substring(content, 1, half), F.substring(content, -half, half), size.cast("string").cast("binary"))
    return F.sha2(F.when(size <= 2 * half, content).otherwise(cut), 256)


def text_pages(docs: DataFrame, key: list[str], text: str = "text", chunk: int = 400, first: int = FIRST_PAGE) -> DataFrame:
    """(key, page_index, body): pages of `chunk` lines, numbered from `first`; blank texts have none."""
    own = F.split(F.regexp_replace(F.col(text), r"\n$", ""), "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / chunk).cast("int"))
    pages = F.transform(starts, lambda i: F.array_join(F.slice(own, i * chunk + 1, F.lit(chunk)), "\n"))
    return docs.where(F.regexp_replace(text, r"\s+", "") != "").select(*key, F.posexplode(pages).alias("page_index", "body")).withColumn("page_index", F.col("page_index") + first)


def feed_pages(docs: DataFrame, key: list[str], text: str = "text", first: int = FIRST_PAGE) -> DataFrame:
    """(key, page_index, body) of extracted text with form feeds: blank pages go, numbers stay."""
    pages = docs.select(*key, F.posexplode(F.split(F.col(text), "\f")).alias("page_index", "body"))
    return pages.where(F.regexp_replace("body", r"\s+", "") != "").withColumn("page_index", F.col("page_index") + first)


def untagged(xml: Column) -> Column:
    """Office XML as text: tags are spaces, white space is squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(xml, "<[^>]+>", " "), r"\s+", " "))


def office_pages(files: DataFrame) -> DataFrame:
    """(rel, status, body) of zipped office files: one page, parts joined by a line feed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_office(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rel"), pa.array([s for s, _ in rows]), pa.array([b for _, b in rows], pa.string())], ["rel", "status", "body"])

    return files.select("rel", "content").mapInArrow(run, "rel string, status string, body string")


def _office(content: bytes) -> tuple[str, str | None]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if n.endswith(".xml") and re.search("document|sheet|slide|sharedStrings", n)]
            parts = [" ".join(re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "replace")).split()) for n in names]
    except zipfile.BadZipFile:
        return "failed_corrupt", None
    body = "\n".join(p for p in parts if p)
    return ("indexed", body) if body else ("zero_byte", None)


def extracted(files: DataFrame, extractor: Callable[[bytes], str | None]) -> DataFrame:
    """(rel, text) by a pluggable extractor of whole files, as for PDF or optical recognition; null where it fails."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content in batch.column("content").to_pylist():
                try:
                    texts.append(extractor(content))
                except Exception:  # the extractor's failure is this file's status
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("rel"), pa.array(texts, pa.string())], ["rel", "text"])

    return files.select("rel", "content").mapInArrow(run, "rel string, text string")


def needs_recognition(n_readable: Column, mean_chars: Column) -> Column:
    """Whether a PDF's text is too thin to trust: none, or under 200 characters a readable page."""
    return (n_readable == 0) | (mean_chars < 200)


def to_do(listed: DataFrame, indexed: DataFrame, recognition: bool = False) -> DataFrame:
    """Files not seen before, and those whose status is worth another try."""
    retried = indexed.where(F.col("status").isin(*RETRIED, *(["image_only_no_text"] if recognition else [])))
    return listed.join(indexed, "rel", "left_anti").unionByName(listed.join(retried, "rel", "left_semi"))


def changed(listed: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose content hash is not the indexed one; an index by path alone would miss them."""
    return listed.join(indexed.select("rel", F.col("sha256").alias("old")), "rel").where("sha256 <> old").drop("old")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Conversation records from JSON lines; malformed lines are dropped."""
    schema = "type string, uuid string, message struct<role: string, content: array<struct<type: string, text: string, input: struct<command: string>>>>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def opened_in(records: DataFrame) -> DataFrame:
    """(rel, page) opened by commands of a transcript."""
    command = records.select(F.explode("message.content").alias("c")).select(F.col("c.input.command").alias("command")).where("command is not null")
    quoted = r"open\s+([\"'])(.+?)\1\s+(\d+)"
    return command.select(F.regexp_extract("command", quoted, 2).alias("rel"), F.regexp_extract("command", quoted, 3).try_cast("int").alias("page")).where("rel <> ''")

"""Queries over files and pages: classification, paging, status accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coverage
from ..sources import derived, files, grids
from . import sql
from .registry import query

_SUFFIX = "CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.png' WHEN 3 THEN '' WHEN 4 THEN '.md' WHEN 5 THEN '.xyz' ELSE '.tar.gz' END"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN s = '' OR s IN {_in(files.TEXT_SUFFIXES)} THEN 'text' WHEN s = '.pdf' THEN 'pdf' WHEN s IN {_in(files.OFFICE_SUFFIXES)} THEN 'office' ELSE 'unsupported_type' END AS kind
FROM (SELECT lower(regexp_extract(concat('doc_', CAST(doc_id AS VARCHAR), {_SUFFIX}), '.(\\.[^.]*)$', 1)) AS s FROM documents) a) b GROUP BY kind""")
def ext_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.expr(f"concat('dir/doc_', doc_id, {_SUFFIX})")
    return derived.documents(spark, sf_dir).select(files.kind(rel).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT rel, size, least(1800, greatest(180, CAST(floor(60 + 12 * (size * 100000.0) / 1048576) AS INTEGER))) AS seconds, CASE WHEN size = 0 THEN 'zero_byte' WHEN size * 100000 > 314572800 THEN 'skipped_too_large' END AS gate FROM (SELECT doc_id AS rel, strlen(text) AS size FROM documents) a")
def timeout_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return derived.documents(spark, sf_dir).select(F.col("doc_id").alias("rel"), size.alias("size"), T.timeout_budget(size * 100000.0).alias("seconds"), files.size_gate(size * 100000).alias("gate"))


@query("WITH " + sql.CORPUS + " SELECT status, count(*) AS n FROM files GROUP BY status")
def coverage_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.by_status(derived.files(spark, sf_dir))


_ON_DISK = "disk AS (SELECT rel FROM files UNION ALL SELECT concat('node_modules/', rel) FROM files WHERE length(rel) % 3 = 0 UNION ALL SELECT 'CLAUDE.md')"


@query("WITH " + sql.CORPUS + f""", {_ON_DISK}, n AS (SELECT (SELECT count(*) FROM disk) AS discovered, count(*) AS seen, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (starts_with(status, 'failed_')) AS failed,
count(*) FILTER (status <> 'indexed' AND NOT starts_with(status, 'failed_')) AS other FROM files), x AS (SELECT count(*) AS excluded FROM disk WHERE rel = 'CLAUDE.md' OR starts_with(rel, 'node_modules/'))
SELECT discovered, excluded, indexed, failed, other, discovered = excluded + indexed + failed + other AS holds, (SELECT count(*) FROM page_rows) AS pages, (SELECT count(*) FILTER (length(body) < 50) FROM page_rows) AS thin FROM n, x""")
def coverage_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on disk, dependency files too, against what became of it, with pages and thin ones."""
    listed = derived.files(spark, sf_dir)
    disk = listed.select("rel").unionAll(listed.where(F.length("rel") % 3 == 0).select(F.concat(F.lit("node_modules/"), "rel"))).unionAll(spark.range(1).select(F.lit("CLAUDE.md")))
    kept, _ = files.walk(disk)
    return coverage.full(kept.join(listed, "rel"), derived.pages(spark, sf_dir), disk.count())


@query("SELECT source, count(*) FILTER (length(text) < 50) AS n_thin, count(*) AS n_pages FROM documents GROUP BY source HAVING count(*) FILTER (length(text) < 50) > 0")
def thin_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.thin_pages(derived.documents(spark, sf_dir), "source", F.col("text"))


@query("""SELECT doc_id, CAST(1 + (i - 1) // 5 AS INTEGER) AS page_index, sha256(string_agg(line, chr(10) ORDER BY i)) AS body_sha FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> '') a) b GROUP BY ALL""")
def text_chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = files.text_pages(derived.documents(spark, sf_dir), ["doc_id"], chunk=5)
    return pages.select("doc_id", "page_index", F.sha2("body", 256).alias("body_sha"))


@query("""SELECT page_id, CAST(1 + (i - 1) // 400 AS INTEGER) AS page_index, sha256(string_agg(line, chr(10) ORDER BY i)) AS body_sha FROM (SELECT page_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
FROM (SELECT page_id, string_split(regexp_replace(html, '\\n$', ''), chr(10)) AS ls FROM pages WHERE regexp_replace(html, '\\s+', '', 'g') <> '') a) b GROUP BY ALL""")
def html_raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = files.text_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"], "html")
    return pages.select("page_id", "page_index", F.sha2("body", 256).alias("body_sha"))


@query("SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, sha256(body) AS body_sha FROM (SELECT doc_id, unnest(ls) AS body, unnest(range(1, len(ls) + 1)) AS page_index FROM (SELECT doc_id, string_split(replace(text, concat('.', chr(10)), chr(12)), chr(12)) AS ls FROM documents) a) b WHERE regexp_replace(body, '\\s+', '', 'g') <> ''")
def form_feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit(".\n"), F.lit("\f")))
    return files.feed_pages(docs, ["doc_id"]).select("doc_id", "page_index", F.sha2("body", 256).alias("body_sha"))


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_sha FROM pages")
def office_tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2(files.untagged(F.col("html")), 256).alias("text_sha"))


@query("""SELECT doc_id, junk, junk > greatest(4.0, n * 0.02) AS is_junk FROM (SELECT doc_id, length(t) AS n, length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{E000}-\\x{F8FF}]', '', 'g')) AS junk
FROM (SELECT doc_id, CASE WHEN doc_id % 33 = 0 THEN concat(text, repeat(chr(3), CAST(doc_id % 64 AS INTEGER))) ELSE text END AS t FROM documents) a) b""")
def junk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 33 == 0, F.concat("text", F.repeat(F.lit("\x03"), (F.col("doc_id") % 64).cast("int")))).otherwise(F.col("text"))
    return derived.documents(spark, sf_dir).select("doc_id", body.alias("t")).select("doc_id", T.junk_count(F.col("t")).cast("long").alias("junk"), T.is_junk(F.col("t")).alias("is_junk"))


@query("WITH " + sql.CORPUS + """ SELECT rel FROM files WHERE status IN ('failed_timeout', 'failed_parser', 'failed_corrupt', 'failed_permission', 'zero_byte', 'skipped_too_large') OR rel LIKE 'copies again/%'""")
def todo_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = derived.files(spark, sf_dir)
    return files.to_do(listed.select("rel"), listed.where("not startswith(rel, 'copies again/')").select("rel", "status")).select("rel")


@query("WITH " + sql.CORPUS + """ SELECT rel, 'disk' AS side FROM files WHERE rel LIKE 'copies again/%' UNION ALL SELECT concat('gone/', rel), 'index' FROM files WHERE status = 'zero_byte' OR status = 'failed_parser'""")
def recount_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = derived.files(spark, sf_dir)
    gone = disk.where("status in ('zero_byte', 'failed_parser')").select(F.concat(F.lit("gone/"), "rel").alias("rel"))
    return coverage.deltas(disk, disk.where("not startswith(rel, 'copies again/')").select("rel").unionAll(gone))


@query("WITH " + sql.CORPUS + """ SELECT rel, status FROM files WHERE (status = 'image_only_no_text' OR starts_with(status, 'failed_')) AND contains(lower(string_split(rel, '/')[-1]), 'doc') AND contains(lower(string_split(rel, '/')[-1]), 'final')""")
def unreadable_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.unreadable(derived.files(spark, sf_dir), ["doc", "final"]).select("rel", "status")


@query("WITH " + sql.CORPUS + " SELECT rel, min(page_index) AS first_page, max(page_index) AS last_page, count(*) AS n FROM page_rows GROUP BY rel")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.pages(spark, sf_dir).groupBy("rel").agg(F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), F.count("*").alias("n"))


@query("WITH " + sql.CORPUS + """, latest AS (SELECT rel, size, 'old' AS origin FROM files WHERE rel NOT IN (SELECT rel FROM files WHERE status = 'failed_parser') UNION ALL SELECT rel, size, 'new' FROM files WHERE status = 'failed_parser') SELECT * FROM latest""")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.files(spark, sf_dir)
    return files.upserted(own.select("rel", "size", F.lit("old").alias("origin")), own.where("status = 'failed_parser'").select("rel", "size", F.lit("new").alias("origin")), ["rel"])


@query("WITH " + sql.CORPUS + " SELECT rel, page_index, left(body, 12000) AS body, CASE WHEN length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) < 50 THEN 'PAGE_HAS_NO_READABLE_TEXT' END AS error FROM page_rows WHERE page_index = 2")
def open_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import evidence

    pages = derived.pages(spark, sf_dir)
    return evidence.open_pages(pages, pages.where("page_index = 2").select("rel", "page_index"))


@query("""WITH l AS (SELECT doc_id, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) a), m AS (SELECT * FROM l WHERE length(text) - length(replace(text, '|', '')) >= 2),
r AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM m), g AS (SELECT doc_id, line, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) AS grid, list_transform(string_split(text, '|'), lambda c: left(trim(regexp_replace(c, '\\s+', ' ', 'g')), 120)) AS cells FROM r)
SELECT doc_id, CAST(grid AS INTEGER) AS grid, CAST(row_number() OVER (PARTITION BY doc_id, grid ORDER BY line) AS INTEGER) AS row, array_to_string(cells, '~') AS cells FROM g WHERE len(list_filter(cells, lambda c: c <> '')) > 0 QUALIFY row <= 60""")
def table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of bar-delimited lines in documents."""
    return grids.delimited(derived.documents(spark, sf_dir), ["doc_id"], "text").withColumn("cells", F.array_join("cells", "~"))

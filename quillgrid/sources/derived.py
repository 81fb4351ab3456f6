"""A publication corpus derived from the documents table, the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CORPUS = """
SELECT doc_id, copy_no, fy, marker, text, source, lang, sha256_hex,
  concat(CASE WHEN copy_no = 1 THEN 'copies again/' ELSE '' END, 'src/', source, '/', CASE WHEN fy IS NULL THEN 'misc' ELSE fy END, '/doc_', CAST(doc_id AS {S}), marker, '.txt') AS rel,
  concat(CASE source WHEN 'src0' THEN 'Annual Budget Statement' WHEN 'src1' THEN 'White Paper on Revenue' WHEN 'src2' THEN 'Fiscal Risks Statement' WHEN 'src3' THEN 'Economic Survey of Industry'
         ELSE concat('Statistical Yearbook of ', source) END, CASE WHEN fy IS NULL THEN '' ELSE concat(' ', fy) END, marker) AS title_line,
  concat('Table ', CAST(1 + doc_id % 9 AS {S}), '.', CAST(1 + doc_id % 4 AS {S}), ': Revenue and expenditure of ', source, ' by ', lang) AS caption_line
FROM (SELECT *, {SHA} AS sha256_hex,
        CASE WHEN doc_id % 10 = 9 THEN NULL ELSE concat(CAST(2010 + (doc_id {DIV} 20) % 6 AS {S}), '-', lpad(CAST(11 + (doc_id {DIV} 20) % 6 AS {S}), 2, '0')) END AS fy,
        CASE doc_id % 7 WHEN 0 THEN ' draft' WHEN 3 THEN ' (1)' WHEN 5 THEN ' final' ELSE '' END AS marker
      FROM (SELECT *, 0 AS copy_no FROM {DOCS} UNION ALL SELECT *, 1 AS copy_no FROM {DOCS} WHERE doc_id % 25 = 0) w) z
"""
CHUNK = 5
#: CTEs for DuckDB.
SQL = "corpus AS (" + _CORPUS.format(S="VARCHAR", SHA="sha256(text)", DIV="//", DOCS="documents") + f"""),
files AS (SELECT rel, sha256_hex AS sha256, length(text) AS size, CAST(ceil((length(text) - length(replace(text, chr(10), '')) + 4) / {CHUNK}.0) AS INTEGER) AS n_pages,
  CASE WHEN length(text) = 0 THEN 'zero_byte' WHEN doc_id % 50 = 7 THEN 'failed_parser' WHEN doc_id % 50 = 13 THEN 'image_only_no_text' ELSE 'indexed' END AS status FROM corpus),
bodies AS (SELECT rel, concat(title_line, chr(10), 'Contents', chr(10), caption_line, chr(10), text) AS body FROM corpus),
page_rows AS (SELECT rel, CAST(1 + (i - 1) // {CHUNK} AS INTEGER) AS page_index, string_agg(line, chr(10) ORDER BY i) AS body
  FROM (SELECT rel, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT rel, string_split(body, chr(10)) AS ls FROM bodies) a) b GROUP BY ALL)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return spark.sql(_CORPUS.format(S="STRING", SHA="sha2(text, 256)", DIV="div", DOCS="{docs}"), docs=docs)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    n_lines = size - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 4
    status = F.when(size == 0, "zero_byte").when(F.col("doc_id") % 50 == 7, "failed_parser").when(F.col("doc_id") % 50 == 13, "image_only_no_text").otherwise("indexed")
    return corpus(spark, sf_dir).select("rel", F.col("sha256_hex").alias("sha256"), size.cast("long").alias("size"), F.ceil(n_lines / CHUNK).cast("int").alias("n_pages"), status.alias("status"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = corpus(spark, sf_dir).select("rel", F.concat_ws("\n", "title_line", F.lit("Contents"), "caption_line", "text").alias("body"))
    own = F.split("body", "\n")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int")), lambda i: F.array_join(F.slice(own, i * CHUNK + 1, F.lit(CHUNK)), "\n"))
    return body.select("rel", F.posexplode(chunks).alias("page_index", "body")).withColumn("page_index", F.col("page_index") + 1)

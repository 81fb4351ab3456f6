"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lm, pages, pieces, quality, sharding, simhash, substrings, suffixes, topk
from .exchange import read


def _digest(kept: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(kept).cast("binary"), F.lit(b"")), 256).alias("kept_sha256")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(read(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(read(spark, sf_dir, "documents"), length=400).select("doc_id", "n_bytes", "n_removed", "n_spans", _digest("kept"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predicted(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(read(spark, sf_dir, "documents"), length=13).select("doc_id", "n_words", "n_removed", _digest("kept"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5, scale=256.0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"), 16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_html_extraction": op2_html_extraction,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_language_model": op5_language_model,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_top_k": op9_top_k,
    "op10_sharding": op10_sharding,
}
_INTEGERS = "SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: The others have no SQL; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op9_top_k": f"""WITH i AS ({_INTEGERS}), s AS (SELECT q.vec_id AS query_id, i.vec_id, CAST(list_inner_product(q.v, i.v) AS BIGINT) AS score FROM i q JOIN i ON q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
}

"""Counts that account for every file and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_status(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("n"))


def rollup(files: DataFrame, discovered: int | None = None) -> DataFrame:
    """discovered = excluded + indexed + failed + other, in one row."""
    seen = F.count("*")
    found = F.lit(discovered).cast("long") if discovered is not None else seen
    indexed, failed = F.count_if(F.col("status") == "indexed"), F.count_if(F.startswith("status", F.lit("failed_")))
    excluded = F.greatest(found - seen, F.lit(0))
    out = files.agg(found.alias("discovered"), excluded.alias("excluded"), indexed.alias("indexed"), failed.alias("failed"), (seen - indexed - failed).alias("other"))
    return out.withColumn("holds", F.col("discovered") == F.col("excluded") + F.col("indexed") + F.col("failed") + F.col("other"))


def full(files: DataFrame, pages: DataFrame, discovered: int | None = None, chars: int = 50) -> DataFrame:
    """rollup() with the stored pages and how many of them have hardly any text."""
    return rollup(files, discovered).crossJoin(pages.agg(F.count("*").alias("pages"), F.count_if(F.length("body") < chars).alias("thin")))  # one row each


def thin_pages(pages: DataFrame, by: str = "rel", body: Column | None = None, chars: int = 50) -> DataFrame:
    """(by, n_thin, n_pages) where a page has fewer characters than `chars`."""
    thin = F.count_if(F.length(F.col("body") if body is None else body) < chars)
    return pages.groupBy(by).agg(thin.alias("n_thin"), F.count("*").alias("n_pages")).where("n_thin > 0")


def unreadable(files: DataFrame, words: list[str]) -> DataFrame:
    """Files that could not be read and whose name has all the words."""
    name = F.lower(F.element_at(F.split("rel", "/"), -1))
    bad = files.where((F.col("status") == "image_only_no_text") | F.startswith("status", F.lit("failed_")))
    for w in words:
        bad = bad.where(F.contains(name, F.lit(w.lower())))
    return bad


def deltas(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(rel, side): files on disk only and in the index only."""
    new = disk.select("rel").join(index.select("rel"), "rel", "left_anti").withColumn("side", F.lit("disk"))
    return new.unionAll(index.select("rel").join(disk.select("rel"), "rel", "left_anti").withColumn("side", F.lit("index")))

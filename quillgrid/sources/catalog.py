"""Where a corpus and its tables are; append-only logs of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger

TABLES = ("files", "pages", "docs", "captions", "families", "cards")


def root_key(root: str) -> str:
    return root.replace("\\", "/").rstrip("/").lower()


def register(spark: SparkSession, registry: str, root: str, store: str) -> dict:
    """Adds or replaces a corpus root in the registry (a JSON file)."""
    known = ledger.load(spark, registry) if ledger.exists(spark, registry) else {}
    known[root_key(root)] = {"root": root, "store": store}
    ledger.save(spark, registry, known)
    return known


def resolve(spark: SparkSession, registry: str, path: str) -> dict:
    """The registered corpus that holds a path: the longest root that is its parent."""
    known = ledger.load(spark, registry) if ledger.exists(spark, registry) else {}
    own = root_key(path)
    found = [k for k in known if own == k or own.startswith(k + "/")]
    if not found:
        raise LookupError(f"no registered corpus holds {path}")
    return known[max(found, key=len)]


class MissingIndex(LookupError):
    """A corpus is registered but a table of it has not been built."""

    exit_code = 2


def table(spark: SparkSession, corpus: dict, name: str) -> DataFrame:
    if name not in TABLES:
        raise LookupError(f"no such table: {name}")
    if not ledger.exists(spark, f"{corpus['store']}/{name}"):
        raise MissingIndex(f"{corpus['store']}/{name} is not there: build the index first")
    return spark.read.parquet(f"{corpus['store']}/{name}")


def log_opened(opened: DataFrame, path: str) -> None:
    """Appends (slug, rel, page_index) with the time."""
    opened.select("slug", "rel", "page_index").withColumn("ts", F.current_timestamp()).write.mode("append").partitionBy("slug").parquet(path)


def log_notes(notes: DataFrame, path: str) -> None:
    """Appends accepted notes (slug, text, quote, page_sha) with the time."""
    notes.select("slug", "text", "quote", "page_sha").withColumn("ts", F.current_timestamp()).write.mode("append").partitionBy("slug").parquet(path)


def session(opened: DataFrame, notes: DataFrame, slug: str) -> DataFrame:
    """(kind, what, ts): what a session opened and noted, in order of time."""
    a = opened.where(F.col("slug") == slug).select(F.lit("opened").alias("kind"), F.concat_ws(" p", "rel", "page_index").alias("what"), "ts")
    b = notes.where(F.col("slug") == slug).select(F.lit("note").alias("kind"), F.col("text").alias("what"), "ts")
    return a.unionAll(b).orderBy("ts")

"""Refresh of a shelf from a directory of arriving card files, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ledger, shelf


def latest(spark: SparkSession, store: str) -> int | None:
    """The newest version whose shelf is complete; None before the first."""
    own, fs = ledger._path(spark, f"{store}/shelf")
    if not fs.exists(own):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(own)]
    found = [int(n.partition("=")[2]) for n in names if n.startswith("version=") and ledger.exists(spark, f"{store}/shelf/{n}/_SUCCESS")]
    return max(found, default=None)


def refresh(spark: SparkSession, arriving: str, schema: str, store: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of cards is merged into the store (Parquet directories `cards` and `shelf`, a `version=N` each).

    A card that arrives again under its path replaces the former one, and the editions of both are decided again; of several in one batch the
    greatest row counts. A batch writes a new version beside the old ones; readers take latest(), so they never see a half-written
    shelf, and a batch that runs again after a failure writes the same version. Every version is whole, so a batch costs a copy of the store.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = F.max(F.struct(*batch.columns)).alias("row")
        new = batch.groupBy("rel").agg(rows).select(*(F.col(f"row.{c}").alias(c) for c in batch.columns))
        first = not ledger.exists(spark, f"{store}/cards/version={number - 1}")
        old = new.limit(0) if first else spark.read.parquet(f"{store}/cards/version={number - 1}")
        old.join(new, "rel", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{store}/cards/version={number}")
        cards = spark.read.parquet(f"{store}/cards/version={number}")
        if first:
            kept = shelf.with_primary(shelf.survivors(cards))
        else:
            kept = shelf.updated(spark.read.parquet(f"{store}/shelf/version={number - 1}"), cards, new, old.join(new, "rel", "left_semi"))
        kept.write.mode("overwrite").parquet(f"{store}/shelf/version={number}")

    return spark.readStream.schema(schema).parquet(arriving).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(merge).start()

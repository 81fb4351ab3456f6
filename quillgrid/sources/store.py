"""Tables that are derived once and read often: written whole beside the warehouse, named by what they were made of."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import ledger

DONE = "_COMPLETE.json"


class CountMismatch(RuntimeError):
    """A written table has other rows than the one it was made of."""


def signature(spark: SparkSession, paths: list[str], version: str) -> str:
    """A name for inputs as they are now: paths, sizes and times of their files."""
    seen = []
    for path in sorted(paths):
        own, fs = ledger._path(spark, path)
        todo = [own]
        while todo:
            for s in fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    seen.append((str(s.getPath()), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps([version, sorted(seen)]).encode()).hexdigest()[:16]


def checked_write(table: DataFrame, path: str, partition: list[str] | None = None, expected: int | None = None) -> int:
    """Writes a table where its rows lie and counts what was written; with `expected` rows a difference is an error."""
    spark = table.sparkSession
    writer = table.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    found = spark.read.parquet(path).count()
    if expected is not None and found != expected:
        raise CountMismatch(f"{path} has {found} rows, not {expected}")
    return found


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are fewer than those, as small inputs are; larger ones stay as they lie."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], dict[str, tuple[DataFrame, list[str] | None]]], version: str = "1") -> dict[str, DataFrame]:
    """The tables that build() makes of the inputs, each with the columns that part it into directories, or none.

    They are written once for inputs as they are, to a folder of their own that gets its name when it is complete: no reader sees half of it, and
    a run that is cut off leaves nothing under that name.
    """
    base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quillgrid"
    home = f"{base}/{name}-{signature(spark, inputs, version)}"
    if not ledger.exists(spark, f"{home}/{DONE}"):
        beside = f"{base}/_{name}-{uuid.uuid4().hex}"
        rows = {}
        for t, (table, partition) in build().items():
            rows[t] = checked_write(table, f"{beside}/{t}", partition)
        ledger.save(spark, f"{beside}/{DONE}", {"rows": rows})
        own, fs = ledger._path(spark, home)
        if not fs.rename(ledger._path(spark, beside)[0], own) or not fs.exists(ledger._path(spark, f"{home}/{DONE}")[0]):
            raise OSError(f"could not write {home}")
    return {t: spark.read.parquet(f"{home}/{t}") for t in ledger.load(spark, f"{home}/{DONE}")["rows"]}

"""Build manifests and a ledger of runs: small JSON records, written whole or not at all."""

from __future__ import annotations

import json
import platform
import time
import uuid
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shelf import canonical_hash


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    own, fs = _path(spark, path)
    return bool(fs.exists(own))


def load(spark: SparkSession, path: str) -> dict:
    own, fs = _path(spark, path)
    stream = fs.open(own)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def save(spark: SparkSession, path: str, record: dict) -> None:
    """Writes beside the path and renames over it in one step, so a reader sees the old record or the new one."""
    own, fs = _path(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(record, indent=1, sort_keys=True, ensure_ascii=False).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(own), how)


def manifest(tables: dict[str, DataFrame], wallclock: tuple[str, ...] = ("indexed_at", "mtime", "built_at")) -> dict:
    """Rows and canonical hash of each table, without columns that tell the time, and of all together."""
    found = {}
    for name, table in sorted(tables.items()):
        row = canonical_hash(table.drop(*wallclock)).first()
        found[name] = {"rows": row.n_rows, "digest": row.digest, "columns": sorted(c for c in table.columns if c not in wallclock)}
    return {"tables": found, "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__}}


def differences(a: dict, b: dict) -> list[str]:
    """Tables that differ between two manifests."""
    names = sorted({*a["tables"], *b["tables"]})
    return [n for n in names if a["tables"].get(n) != b["tables"].get(n)]


def report(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(measure, n): counters of a build."""
    a = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("fy").isNotNull()).alias("with_year"), F.count_if("is_primary").alias("primaries"), F.count_if(F.col("n_dupes") > 0).alias("with_copies"), F.count_distinct("family").alias("families"))
    counts = a.unpivot([], a.columns, "measure", "n")
    return counts.unionAll(files.groupBy(F.concat(F.lit("files_"), "status").alias("measure")).agg(F.count("*").alias("n")))


def start(spark: SparkSession, path: str, run: str, inputs: dict[str, str], outputs: list[str], supersedes: str | None = None) -> dict:
    """A new run's record; refuses to replace a finished run, or to write over outputs, unless it says what it supersedes."""
    if not supersedes:
        if exists(spark, path) and load(spark, path).get("finished"):
            raise FileExistsError(f"{path} is of a finished run")
        if there := [o for o in outputs if exists(spark, o)]:
            raise FileExistsError(f"outputs exist: {', '.join(there)}")
    record = {"run": run, "started": time.time(), "finished": None, "inputs": inputs, "outputs": {o: None for o in outputs}, "notes": [], "supersedes": supersedes}
    save(spark, path, record)
    return record


def note(spark: SparkSession, path: str, text: str) -> dict:
    record = load(spark, path)
    record["notes"].append({"at": time.time(), "text": text})
    save(spark, path, record)
    return record


def finish(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict:
    """Closes a run with the hashes of its output tables; an output without a table is an error."""
    record = load(spark, path)
    if record["finished"]:
        raise FileExistsError(f"{path} is of a finished run")
    if missing := [o for o in record["outputs"] if o not in tables]:
        raise ValueError(f"no table for {', '.join(missing)}")
    record["outputs"] = {o: canonical_hash(t).first().digest for o, t in tables.items()}
    record["finished"] = time.time()
    save(spark, path, record)
    return record

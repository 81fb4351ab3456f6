"""Shared plumbing: packs of rows, tasks that see one key at a time, checkpoints, connected components.

A *pack* is a few megabytes of consecutive input rows as one compressed Arrow stream. Packs are written once to the
shared checkpoint folder. What a pack wants to know of the whole corpus it asks by key: sorted distinct keys go to
shards by range, each shard combines what all packs sent, and answers go back in key order. A hot key costs one entry
a pack, whatever its number of rows, and no task ever holds more than one shard or one pack.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits

PACKS = "pack long, kind int, part int, blob binary"
PACK_BYTES = 6 << 20
MANY_BYTES = 200e9
#: A node with more edges, or more than this share of all, is a hub.
HUB, HUB_SHARE, HUB_PARTS = 1000, 1 / 500, 64


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows from the shared checkpoint folder; the lineage ends there, so a lost executor costs no earlier stage.

    The folder is spark.checkpoint.dir. Without it a folder of this machine is used by local masters alone, whose executors are here.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillgrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing will read again."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pack_bytes(df: DataFrame) -> int:
    """Bytes of a pack of df: PACK_BYTES up to about MANY_BYTES of input, by Spark's own estimate, and growing with its square root beyond.

    Every pack sends a message to every shard, and shards are a fixed part of the packs, so the messages grow with the square of the number
    of packs; as that grows with the square root of the input, they grow with the input. At 100 TB a pack has some 130 MB, and
    a message of a 6 MB pack's worth of keys for each of 180,000 shards some 500 bytes.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return PACK_BYTES if estimate >= 1 << 60 else int(PACK_BYTES * max(1.0, (estimate / MANY_BYTES) ** 0.5))


def packed(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def packs(docs: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """One row for each pack, checkpointed: pack id, kind 0, part 0, blob. All columns of docs are kept."""
    limit = limit or pack_bytes(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = TaskContext.get().partitionId() << 24, 0

        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            return rows([(own + n, 0, 0, packed(table))])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in bits.slices(batch, text, limit):
                held.append(part)
                size += part.nbytes
                if size >= limit:
                    yield out(held)
                    held, size, n = [], 0, n + 1
        if held:
            yield out(held)

    return checkpointed(docs.mapInArrow(run, PACKS))


def rows(values: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*values)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["pack", "kind", "part", "blob"])


def by_key(df: DataFrame, key: str, n: int, fn: Callable, schema: str) -> DataFrame:
    """fn(key, rows) for the rows (pack, kind, part, blob) of each key, ordered; it yields record batches of schema."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("pack", "kind", "part", "blob"))):
                own = row[0] if key == "pack" else row[2]
                if held and own != (held[0][0] if key == "pack" else held[0][2]):
                    yield from fn(held[0][0] if key == "pack" else held[0][2], held)
                    held = []
                held.append(row)
        if held:
            yield from fn(held[0][0] if key == "pack" else held[0][2], held)

    return df.repartition(n, key).sortWithinPartitions(key, "kind", *({"pack", "part"} - {key})).mapInArrow(run, schema)


def each_pack(df: DataFrame, fn: Callable, schema: str = PACKS) -> DataFrame:
    """fn(pack, table) for each pack where it lies, without an exchange."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob in zip(batch.column("pack").to_pylist(), batch.column("blob")):
                yield from fn(pack, unpacked(blob.as_py()))

    return df.mapInArrow(run, schema)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the 64-bit keys; sorted keys give sorted shards."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) for sorted keys."""
    if len(keys):
        cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield k, int(cuts[k]), int(cuts[k + 1])


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for the nodes that have edges.

    Alternating large-star and small-star steps (Kiveris et al., 2014) with a checkpoint after each round, of which only the last is
    kept. The least neighbour is an aggregate with map-side combine. Where it is joined back, a hub's is broadcast (there
    are at most 1 / HUB_SHARE hubs) and its edges are dealt over HUB_PARTS parts, so they are never in one task.
    """

    def least(pairs: DataFrame, edges: int) -> DataFrame:
        found = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        many = max(HUB, int(edges * HUB_SHARE))
        hubs = F.broadcast(found.where(F.col("n") > many).select("u", F.col("m").alias("hub")))
        rest = found.where(F.col("n") <= many).select("u", (F.col("n") > many).cast("int").alias("part"), "m")  # a literal 0 would leave u as the only key
        own = pairs.join(hubs, "u", "left").withColumn("part", F.when(F.col("hub").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS)).cast("int")))
        return own.join(rest, ["u", "part"], "left").select("u", "v", F.coalesce("hub", "m").alias("m"))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = state(pairs)
    for _ in range(most):
        size = 2 * before[0]
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both, size).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = least(large, size)
        last, pairs = pairs, checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        forget(last)
        now = state(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

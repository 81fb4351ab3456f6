"""Shards of documents by vector bin packing.

Each group of equal texts is an item with three sizes: bytes, tokens (pieces between spaces) and rows, each as a share of its
total. Items are placed by decreasing size, each in the shard where the dot product of its sizes with the shard's residual capacity
is highest; there bytes weigh most. The law is `bytes`: the shards' sizes are near equal.

Packing is hierarchical, so every group is placed by that rule and no task holds them all. Groups are dealt by hash to batches of about `batch`;
each batch packs its groups into bins, FINE for each shard; the bins of all batches are the items of the next level, until they are
at most `batch`. Those are packed on the driver, together with the large groups (over LARGE of any total, so at most 3 / LARGE of them). Only a group of over one shard's share of some total is cut, as no packing could balance it whole; its pieces,
as many as there are shards, are items like others.

Edge cases: a null text has no bytes and is equal to an empty one; a null doc_id is a row like any other; rows that repeat take a slot
each; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import checkpointed

BATCH, FINE = 50_000, 64
LARGE = 1 / 1024
SLOTS = 50_000
SIZES = ("size", "tokens", "rows")
#: What each size counts in the dot product: the law's own most, so that bytes come out near equal where all three cannot.
WEIGHT = np.array([1.0, 0.125, 0.125])


def placed(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of sizes, each column a share of its total)."""
    order = np.lexsort((np.arange(len(sizes)), -sizes.max(1))) if len(sizes) else np.zeros(0, np.int64)
    residual = np.full((shards, sizes.shape[1]), 1 / shards)
    out, worth = np.zeros(len(sizes), np.int64), sizes * WEIGHT
    for i in order.tolist():
        k = int(np.argmax(residual @ worth[i]))
        out[i] = k
        residual[k] -= sizes[i]
    return out


def shares(sizes: np.ndarray) -> np.ndarray:
    """Sizes as shares of their totals; a size that all lack has none."""
    return sizes / np.maximum(sizes.sum(0), 1)


def packed_batches(items: DataFrame, n: int, bins: int) -> DataFrame:
    """(key, batch, bin, size, tokens, rows) for items (key, size, tokens, rows), dealt by hash to n batches."""

    def pack(key: np.ndarray, batch: int, own: np.ndarray) -> pa.RecordBatch:
        at = placed(shares(own), bins)
        columns = [pa.array(key), pa.array(np.full(len(key), batch, np.int32)), pa.array(at.astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in own.T)]
        return pa.RecordBatch.from_arrays(columns, ["key", "batch", "bin", *SIZES])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for part in batches:
            number, key, *own = (part.column(c).to_numpy(zero_copy_only=False) for c in ("batch", "key", *SIZES))
            own = np.stack(own, axis=1).astype(float)
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and number[a] != last:
                    yield pack(np.concatenate([k for k, _ in held]), last, np.concatenate([s for _, s in held]))
                    held = []
                last = number[a]
                held.append((key[a:b].copy(), own[a:b]))
        if held:
            yield pack(np.concatenate([k for k, _ in held]), last, np.concatenate([s for _, s in held]))

    dealt = items.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).repartition(n, "batch").sortWithinPartitions("batch", "key")
    return dealt.select("batch", "key", *SIZES).mapInArrow(run, "key long, batch int, bin int, size long, tokens long, rows long")


def sharded(docs: DataFrame, shards: int = 16, batch: int = BATCH) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")
    base = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), tokens.alias("tokens"), F.xxhash64(text).alias("key")))
    groups = checkpointed(base.groupBy("key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    *whole, n_groups = groups.agg(*(F.sum(c) for c in SIZES), F.count("*")).first()
    whole = [max(1, t or 0) for t in whole]
    share = F.greatest(*(F.col(c) / F.lit(float(t)) for c, t in zip(SIZES, whole)))
    large = groups.where(share >= LARGE).orderBy("key").collect()  # at most 3 / LARGE rows

    items, levels, bins = groups.where(share < LARGE), [], max(shards, min(FINE * shards, batch // 2))
    while n_groups > batch:
        levels.append(checkpointed(packed_batches(items, -(-n_groups // batch), bins)))
        items = levels[-1].groupBy("batch", "bin").agg(*(F.sum(c).alias(c) for c in SIZES)).select(F.xxhash64("batch", "bin").alias("key"), *SIZES)
        n_groups = items.count()
    few = items.select("key", *SIZES).orderBy("key").collect()  # at most `batch` rows

    keys, sizes = [], []
    for key, *size in large:
        part = np.array([x / t for x, t in zip(size, whole)])
        n = shards if part.max() * shards > 1 + 1e-9 else 1
        keys += [(key, n, piece) for piece in range(n)]
        sizes += [part / n] * n
    sizes += [np.array([x / t for x, t in zip(size, whole)]) for _, *size in few]
    shard = placed(np.array(sizes).reshape(-1, 3), shards).tolist()

    of_group = spark.createDataFrame([(r[0], s) for r, s in zip(few, shard[len(keys) :])], "key long, key_shard int")
    for level in reversed(levels):  # from the bins of the last level down to the groups
        of_group = level.select("key", F.xxhash64("batch", "bin").alias("of")).join(of_group.withColumnRenamed("key", "of"), "of").select("key", "key_shard")
    of_piece = spark.createDataFrame([(key, n, p, s) for (key, n, p), s in zip(keys, shard)], "key long, pieces int, piece int, piece_shard int")

    pieces = F.broadcast(of_piece.select("key", "pieces").distinct())
    rows = base.join(pieces, "key", "left").withColumn("piece", F.pmod(F.xxhash64("doc_id", "key"), F.coalesce("pieces", F.lit(1))).cast("int"))
    rows = rows.join(F.broadcast(of_piece.drop("pieces")), ["key", "piece"], "left")
    # large groups have their shard by now and take no part in the join by key, which is small groups only
    rows = rows.where("piece_shard is not null").select("doc_id", "size", "text_crc32", "key", F.col("piece_shard").alias("shard")).unionAll(rows.where("piece_shard is null").join(of_group, "key").select("doc_id", "size", "text_crc32", "key", F.col("key_shard").alias("shard")))
    rows = checkpointed(rows.withColumn("sub", F.pmod(F.xxhash64("doc_id", "key"), F.lit(max(1, -(-whole[2] // (shards * SLOTS))))).cast("int")))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("shard", "sub").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).select("shard", "sub", "offset")
    within = Window.partitionBy("shard", "sub").orderBy("doc_id", "key")
    out = rows.join(offset, ["shard", "sub"]).withColumn("slot", F.col("offset") + F.row_number().over(within) - 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Near copies by five-word shingles: SimHash groups and MinHash bands find candidates, exact Jaccard decides.

A document is the set of hashes of its five-word shingles (words lower-cased, A-Z). Documents of equal sets are one node, of which the
least row is held, so copies cost nothing. Candidates meet in buckets. One is a node's SimHash group, by the operator of `simhash`: fingerprints, anchors
of a covering code, links at 4 or fewer differing bits, components. At that distance SimHash does not see most pairs of Jaccard 0.8 (four in 47 at
sf0.1), so a node also goes to BANDS buckets, each named by ROWS minima of its set under multiplicative hashes; two sets
of Jaccard J share none of these with probability (1 - J ** ROWS) ** BANDS, which is 3e-6 at 0.8. Within
a bucket each node is compared with all that no link has reached yet, by exact Jaccard, so what a bucket gives is a
spanning forest of all its links; components of these forests are the groups.

A bucket is in one task with the texts of its distinct sets; many sets that are alike but do not link cost the square of their number in time there.

Edge cases: fewer words than a shingle give one shingle of them all; null, empty and blank texts are one group; rows without doc_id stay
only if nothing in their group has one; a doc_id that repeats may stand in several groups; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits, simhash
from .exchange import checkpointed, components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
SLICE = 1 << 20
_MIX = bits.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, and their number."""
    data, offsets = bits.buffer(column)
    data = bits.LOWER[data]
    start, end, count = bits.words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(count), np.int64)
    word = bits.hashes(data, start, end)
    number = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    at, row = bits.ranges(np.cumsum(count) - count, number), np.repeat(np.arange(len(count)), number)
    length = np.minimum(count, SHINGLE)[row]
    h = length.astype(np.uint64)
    for k in range(SHINGLE):
        h = np.where(k < length, h * np.uint64(0xD1342543DE82EF95) + word[np.minimum(at + k, len(word) - 1)], h)
    h = bits.mix(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(count))


def set_hashes(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each set, zero for the empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(bits.mix(h ^ _MIX[0]), dtype=np.uint64)))
    end = np.cumsum(count)
    return total[end] - total[end - count]


def bands(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bucket of each non-empty set in each band, one row a set."""
    full = count[count > 0]
    cuts = np.cumsum(full) - full
    out = np.zeros((len(full), BANDS), np.uint64)
    for k in range(BANDS * ROWS if len(full) else 0):
        least = np.minimum.reduceat((h ^ _MIX[2 * k]) * (_MIX[2 * k + 1] | np.uint64(1)), cuts)
        out[:, k // ROWS] = bits.mix(out[:, k // ROWS] * np.uint64(0xD1342543DE82EF95) + least + np.uint64(k + 1))
    return out


def linked(h: np.ndarray, count: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first member of each non-empty set's component, under links of at least this Jaccard."""
    names, code = np.unique(h, return_inverse=True)
    end = np.cumsum(count)
    start = end - count
    root = np.full(len(count), -1)
    held = np.zeros(len(names), bool)
    for s in range(len(count)):
        if root[s] >= 0:
            continue
        root[s], queue = s, [s]
        while queue:
            rest = np.flatnonzero(root < 0)
            if not len(rest):
                return root
            x = queue.pop()
            own = code[start[x] : end[x]]
            held[own] = True
            common = np.add.reduceat(held[code[bits.ranges(start[rest], count[rest])]], np.cumsum(count[rest]) - count[rest], dtype=np.int64)
            held[own] = False
            new = rest[common >= similarity * (count[x] + count[rest] - common) - 1e-9]
            root[new] = s
            queue += new.tolist()
    return root


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id; of rows of one id and set the least."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits.release()
        for batch in batches:
            for part in bits.slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(set_hashes(*shingles(part.column("text"))).view(np.int64))], ["row", "node"])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits.release()
        for batch in batches:
            for part in bits.slices(batch, "text", SLICE):
                h, count = shingles(part.column("text"))
                own = pa.array(bands(h, count).view(np.int64).ravel())
                buckets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(BANDS * (count > 0)))), pa.int32()), own)
                fp = pa.array(simhash.fingerprint_array(part.column("text")).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(set_hashes(h, count).view(np.int64)), fp, buckets], ["row", "node", "fp", "buckets"])

    def signed(row: F.Column, run, extra: list[T.StructField]) -> DataFrame:
        own = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
        return own.mapInArrow(run, T.StructType([own.schema["row"], T.StructField("node", T.LongType()), *extra]))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(node: np.ndarray, texts: list[pa.Array]) -> pa.RecordBatch:
            root = linked(*shingles(pa.concat_arrays(texts)), similarity)
            far = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], ["a", "b"])

        bits.release()
        held: list[tuple[np.ndarray, pa.Array]] = []
        last = None
        for batch in batches:
            bucket, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "node"))
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if held and bucket[a] != last:
                    yield out(np.concatenate([x[0] for x in held]), [x[1] for x in held])
                    held = []
                last = bucket[a]
                held.append((node[a:b].copy(), batch.column("text").slice(a, b - a)))
        if held:
            yield out(np.concatenate([x[0] for x in held]), [x[1] for x in held])

    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"))
    prints = checkpointed(signed(who, spread, [T.StructField("fp", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType()))]).groupBy("node", "fp").agg(F.min("row").alias("who"), F.min("buckets").alias("buckets")))
    nodes = prints.groupBy("node").agg(F.min("who").alias("who"), F.min("buckets").alias("buckets"))
    groups = components(simhash.forest(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    group = F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("bucket")  # beside the bands' names; the empty set has no bucket
    buckets = nodes.select("node", F.explode("buckets").alias("bucket")).unionAll(prints.where("size(buckets) > 0").join(groups, "fp", "left").select("node", group).distinct())
    # buckets of the same members are one
    shared = buckets.groupBy("bucket").agg(F.array_sort(F.collect_list("node")).alias("members")).where("size(members) > 1").select("members").distinct()
    met = checkpointed(shared.select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("node")))
    texts = signed(F.col("text").cast("string"), sign, []).groupBy("node").agg(F.min("row").alias("text"))
    texts = texts.join(met.select("node").distinct(), "node", "left_semi").join(met, "node").select("bucket", "node", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = components(texts.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, "a long, b long"))
    named = roots.join(nodes.select("node", "who"), "node")
    best = named.groupBy("root").agg(F.min(F.struct("who", "node")).alias("best"))
    gone = named.join(best, "root").where("node <> best.node").select("node")
    kept = signed(row, sign, []).groupBy("node").agg(F.min("row").alias("row")).join(gone, "node", "left_anti")
    return kept.select(*(F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))

"""Near-duplicate documents by SimHash and anchor points of a covering code.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles. Two fingerprints link when
at most `distance` bits differ. The 64 bits are cut into three bands; by the pigeonhole principle one band of a linked
pair differs in at most distance // 3 bits. The anchors of a band are the codewords of a covering code: the perfect
Hamming code [15, 11] (covering radius 1) on its first 15 bits, every word on the rest. Each fingerprint is replicated
to every anchor that is nearest to some word within distance // 3 of its own band, that is, within the covering radius plus the
threshold, so both of a linked pair meet at the anchor of either. Fingerprints are compared per anchor only.

Equal fingerprints are one node, so groups of copies cost nothing. An anchor emits a spanning forest of its links, not
its pairs; components of these forests are the components of all links.

Edge cases: null and empty texts and texts of white space have fingerprint zero and link like any other; fewer words than a shingle
give one shingle of them all; a null doc_id gets a fingerprint but never names a component (component_id is null if all ids are null);
rows that repeat a doc_id are separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits
from .exchange import checkpointed, components

BANDS = ((0, 21), (21, 21), (42, 22))
HAMMING = 15
SLICE = 1 << 20
#: Fingerprints at one anchor up to which all pairs are compared.
DENSE = 512


def fingerprint_array(column: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The SimHash of each text, unsigned."""
    data, offsets = bits.buffer(column)
    data, offsets = bits.squeezed(bits.LOWER[data], offsets)
    start, end, count = bits.words(data, offsets)
    out = np.zeros(len(count), np.uint64)
    shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    if not shingles.sum():
        return out
    at = bits.ranges(np.cumsum(count) - count, shingles)
    row = np.repeat(np.arange(len(count)), shingles)
    last = np.minimum(at + shingle - 1, (np.cumsum(count) - 1)[row])
    raw, h = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((h(raw[a:b], seed) for a, b in zip(start[at].tolist(), end[last].tolist())), np.uint64, len(at))
    full = np.flatnonzero(shingles)
    cuts = np.cumsum(shingles[full]) - shingles[full]
    sums = np.zeros((len(full), 64), np.int64)
    block = 1 << 17
    for a in range(0, len(hashes), block):
        unpacked = np.unpackbits(hashes[a : a + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last_doc = np.searchsorted(cuts, a, "right") - 1, np.searchsorted(cuts, min(a + block, len(hashes)), "left")
        sums[first:last_doc] += np.add.reduceat(unpacked, np.maximum(cuts[first:last_doc] - a, 0), axis=0, dtype=np.int64)
    major = np.packbits((2 * sums > shingles[full][:, None]).astype(np.uint8), axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(major).view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bits.slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprint_array(part.column("text"), shingle, seed).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Position 1..15 of the bit by which a 15-bit word differs from its codeword, 0 if it is one."""
    s = np.zeros(x.shape, np.int64)
    for i in range(HAMMING):
        s ^= np.where((x >> i) & 1, i + 1, 0)
    return s


def nearest(band: np.ndarray) -> np.ndarray:
    """The anchor nearest to each band value."""
    low = band & ((1 << HAMMING) - 1)
    s = _syndrome(low)
    return (band ^ low) | (low ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0))


def anchors(fp: np.ndarray, distance: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, anchor id) for every anchor within covering radius plus the band's threshold."""
    out = []
    for k, (shift, width) in enumerate(BANDS):
        band = ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        flips = [0] + [sum(1 << i for i in c) for n in range(1, distance // len(BANDS) + 1) for c in combinations(range(width), n)]
        near = np.sort(np.stack([nearest(band ^ f) for f in flips], axis=1), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        at, col = np.nonzero(new)
        out.append((at, near[at, col] | (k << 24)))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def links(anchor: np.ndarray, fp: np.ndarray, distance: int = 4, buffer: int = 1 << 20, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links at each anchor; rows are sorted by anchor.

    A group of at most `dense` rows is compared pair by pair. In a larger one two linked fingerprints, cut into distance + 2 blocks, have two
    blocks alike: for each two blocks only rows with equal ones are compared, so the work does not follow the square of the group.
    Pairs in hand are reduced to their forest whenever there are `buffer` of them.
    """
    n = len(fp)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        root = _forest(*(np.concatenate([np.zeros(0, np.int64), *(x[c] for x in held)]) for c in (0, 1)), n)
        kept = np.flatnonzero(root != np.arange(n))
        return kept, root[kept]

    def compare(rows: np.ndarray, key: np.ndarray) -> None:
        """Links between rows of equal keys, which are side by side: at shift s, row i meets row i + s."""
        nonlocal held, size
        own, alive, shift = fp[rows], np.arange(len(rows)), 1
        while True:
            alive = alive[alive + shift < len(rows)]
            alive = alive[key[alive] == key[alive + shift]]
            if not len(alive):
                return
            close = alive[np.bitwise_count(own[alive] ^ own[alive + shift]) <= distance]
            if len(close):
                held.append((rows[close], rows[close + shift]))
                size += len(close)
            if size > buffer:
                held, size = [reduced()], 0
            shift += 1

    if n:
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        large = np.repeat(np.diff(np.append(first, n)) > dense, np.diff(np.append(first, n)))
        few, rows = np.flatnonzero(~large), np.flatnonzero(large)
        compare(few, anchor[few])
        cuts = np.linspace(0, 64, distance + 3).astype(int).tolist()
        blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
        for x, y in combinations(blocks, 2) if len(rows) else ():
            value = fp[rows] & np.uint64(x | y)
            order = np.lexsort((value, anchor[rows]))
            group, value = anchor[rows][order], value[order]
            compare(rows[order], np.cumsum(np.concatenate(([True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])))))
    return reduced()


def forest(fps: DataFrame, distance: int = 4, parts: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that links connect."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for a in range(0, len(all_fp), 4096):
                fp = all_fp[a : a + 4096]
                at, anchor = anchors(fp.view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fp[at])], ["anchor", "fp"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            i, j = links(a, f.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(f[i]), pa.array(f[j])], ["a", "b"])

        left_a, left_f = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate((left_a, batch.column("anchor").to_numpy(zero_copy_only=False)))
            f = np.concatenate((left_f, batch.column("fp").to_numpy(zero_copy_only=False)))
            cut = int(np.searchsorted(a, a[-1])) if len(a) else 0
            if cut:
                yield out(a[:cut], f[:cut])
            left_a, left_f = a[cut:], f[cut:]
        if len(left_a):
            yield out(left_a, left_f)

    parts = parts or int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fps.select("fp").mapInArrow(spread, "anchor int, fp long").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def components_of(fps: DataFrame, distance: int = 4, parts: int | None = None) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of (doc_id, fp)."""
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(forest(nodes, distance, parts))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("node").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    fps = checkpointed(fingerprints(docs, shingle, seed))
    return fps.join(components_of(fps, distance), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id.

    Rows that share a doc_id are one document, of which the least row stays. A group without any doc_id keeps its least row.
    """
    fps = checkpointed(fingerprints(docs, shingle, seed))
    groups = checkpointed(components_of(fps, distance))
    row = F.struct(*(F.col(f"`{c}`") for c in ["text", *(c for c in docs.columns if c != "text")]))
    kept = groups.where("component_id is not null").select(F.col("component_id").alias("doc_id")).distinct()
    named = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row"))
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), row.alias("row"), F.col("text"))
    lone = unnamed.mapInArrow(_with_fingerprint(shingle, seed), unnamed.drop("text").schema.add("fp", "long"))
    lone = lone.join(groups.where("component_id is null"), "fp", "left_semi").groupBy("fp").agg(F.min("row").alias("row"))
    return named.select("row").unionAll(lone.select("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _with_fingerprint(shingle: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bits.slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(fingerprint_array(part.column("text"), shingle, seed).view(np.int64))], ["doc_id", "row", "fp"])

    return run

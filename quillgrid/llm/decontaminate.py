"""Benchmark decontamination by spaced seeds.

Tokens are maximal runs of letters, digits and non-ASCII bytes, lower-cased (A-Z); punctuation and white space separate them. A
mask selects some of the tokens in a span and ignores the rest; its hash over the selected ones is a seed. Seeds of documents meet equal
seeds of benchmark items, and around each hit the two are compared token by token on that alignment. They overlap if a
stretch of at least `least` tokens agrees in `similarity` of them. Items with fewer tokens must occur whole and unchanged; items with
fewer than four tokens are too common to look for and never match.

The two masks lose nothing: a stretch of n >= 13 tokens with at most n // 5 differing ones holds four equal tokens in a row, except when
n = 15 and runs of three alternate with single differences, and there the mask 1110111 hits. A hit goes on to the comparison if any
stretch of `least` to 2 * `least` - 1 tokens near it has the share; a longer one always holds such a stretch.

The benchmark is read in blocks of about four bytes times `block`. One block, the usual case, is sent to the tasks, which the documents pass
without an exchange. With more, each block is a job of its own over packs of documents that keeps the hits alone, and the hits are then
put beside their rows: neither the driver nor a task ever holds more than one block, and at most `PAIRS` seeds that meet.

Edge cases: null and empty texts and items never overlap; rows that repeat are judged each; item ids that repeat are one item per row;
a null item_id is reported as null; an empty benchmark leaves every document clean; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits
from .exchange import by_key, checkpointed, each_pack, packed, packs, rows, unpacked

MASKS = ("1111", "1110111")
SLICE = 1 << 20
#: Pairs of seeds in hand at a time, and cells of the comparison around them.
PAIRS, CELLS = 1 << 18, 1 << 20
TOKEN = np.full(256, 0x20, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    TOKEN[_c] = _c
TOKEN[65:91] = np.arange(97, 123)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token, and each row's number of tokens."""
    data, offsets = bits.buffer(column)
    data = TOKEN[data]
    start, end, count = bits.words(data, offsets)
    return (bits.hashes(data, start, end) if len(data) else np.zeros(0, np.uint64)), count


def seeds(token: np.ndarray, count: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of each placement of the mask within a row."""
    span = len(mask)
    if len(token) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(token) - span + 1
    h = np.full(n, len(mask) * 0x9E3779B1 + int(mask, 2), np.uint64)
    for k, used in enumerate(mask):
        if used == "1":
            h = h * np.uint64(0xD1342543DE82EF95) + token[k : k + n]
    ok = np.ones(n, bool)
    ends = np.cumsum(count)
    at = bits.ranges(np.maximum(ends - span + 1, ends - count), np.minimum(count, span - 1))
    ok[at[at < n]] = False
    at = np.flatnonzero(ok)
    return at, bits.mix(h[at])


def stretch(same: np.ndarray, least: int, similarity: float) -> tuple[int, int] | None:
    """First and end of the longest run with this share of True; None if it is shorter than least."""
    n = len(same)
    if n < least:
        return None
    worth = np.concatenate(([0.0], np.cumsum(same - similarity)))
    low = np.minimum.accumulate(worth)
    best = None
    for end in range(n, 0, -1):
        first = int(np.searchsorted(-low, -worth[end] - 1e-9))
        if end - first >= max(least, best[1] - best[0] + 1 if best else 0):
            best = (first, end)
        if best and end <= best[1] - best[0]:
            break
    return best


class Block:
    """The seeds and tokens of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        self.ids = ids
        self.token, self.count = tokens(pa.array(texts, pa.string()))
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count
        self.item = np.repeat(np.arange(len(ids)), self.count)
        self.tables = []
        for mask in MASKS:
            at, h = seeds(self.token, self.count, mask)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[h >> np.uint64(44)] = True
            self.tables.append((h[order], at[order], seen))

    def hits(self, token: np.ndarray, count: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(token of the documents, token of the benchmark) of all equal seeds, about `most` pairs at a time.

        Of a run of equal tokens only the first hit on its diagonal is given; the comparison reaches `least` tokens further for it.
        """
        for mask, (keys, at, seen) in zip(MASKS, self.tables):
            if not len(keys):
                continue
            i, h = seeds(token, count, mask)
            some = seen[h >> np.uint64(44)]
            i, h = i[some], h[some]
            a, b = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            some = b > a
            i, a, size = i[some], a[some], (b - a)[some]
            done = np.concatenate(([0], np.cumsum(size)))
            first = 0
            while first < len(i):  # a seed with more partners than `most` is cut as well
                last = max(first + 1, int(np.searchsorted(done, done[first] + most, "right")) - 1)
                for k in range(0, int(size[first]) if last == first + 1 else 1, most):
                    n = np.minimum(size[first:last] - k, most) if last == first + 1 else size[first:last]
                    x, y = np.repeat(i[first:last], n), at[bits.ranges(a[first:last] + k, n)]
                    if mask == MASKS[0]:
                        new = (x == self.row_start(x)) | (y == self.start[self.item[y]])
                        new |= token[np.maximum(x - 1, 0)] != self.token[np.maximum(y - 1, 0)]
                        x, y = x[new], y[new]
                    yield x, y
                first = last

    def row_start(self, x: np.ndarray) -> np.ndarray:
        return self.rows[0][np.searchsorted(self.rows[1], x, "right")]

    def overlaps(self, column: pa.Array, least: int, similarity: float) -> list[list[dict]]:
        """For each text its overlaps: item, first and end token, tokens that agree; one for each alignment."""
        token, count = tokens(column)
        end = np.cumsum(count)
        start = end - count
        self.rows = (np.append(start, 0), end)
        out: list[list[dict]] = [[] for _ in count]
        # the shortest stretch around a seed has fewer than 2 * least tokens: of two halves of a longer one, one has the share too.
        # A hit stands for the up to `least` hits after it on its diagonal; a longer run of equal tokens is a stretch by itself
        around = np.arange(-2 * least + 2, 3 * least - 1)
        lengths = [(n, int(np.ceil(n * similarity - 1e-9))) for n in range(least, 2 * least)]
        step = max(1, CELLS // len(around))
        found: set[tuple[int, int, int]] = set()
        for all_i, all_j in self.hits(token, count):
            for a in range(0, len(all_i), step):
                i, j = all_i[a : a + step], all_j[a : a + step]
                row, item = np.searchsorted(end, i, "right"), self.item[j]
                low, high = np.maximum(start[row] - i, self.start[item] - j), np.minimum(end[row] - i, self.end[item] - j)
                inside = (around >= low[:, None]) & (around < high[:, None])
                same = inside & (token[np.where(inside, i[:, None] + around, 0)] == self.token[np.where(inside, j[:, None] + around, 0)])
                some = np.flatnonzero(same.sum(1) >= np.minimum(lengths[0][1], self.count[item]))
                sums = np.zeros((len(some), len(around) + 1), np.int32)
                np.cumsum(same[some], axis=1, out=sums[:, 1:])
                good = self.count[item[some]] < least
                for n, need in lengths:
                    good |= (sums[:, n:] - sums[:, :-n]).max(1) >= need
                row, item, i, j = (x[some[good]] for x in (row, item, i, j))
                found.update(zip(row.tolist(), item.tolist(), ((i - start[row]) - (j - self.start[item])).tolist()))
        for r, k, s in sorted(found):
            first, last = max(0, s), min(int(count[r]), s + int(self.count[k]))
            a, b = int(start[r]) + first, int(self.start[k]) + first - s
            same = token[a : a + last - first] == self.token[b : b + last - first]
            if self.count[k] < least:
                part = (0, len(same)) if len(same) == self.count[k] and same.all() else None
            else:
                part = stretch(same, least, similarity)
            if part:
                out[r].append({"item_id": self.ids[k], "first": first + part[0], "end": first + part[1], "equal": int(same[part[0] : part[1]].sum())})
        for x in out:
            x.sort(key=_order)
        return out


def _order(hit: dict) -> tuple:
    return hit["item_id"] is None, hit["item_id"] or 0, hit["first"]


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("equal", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("equal", pa.int32())]))


def overlapping(docs: DataFrame, benchmark: DataFrame, least: int = 13, similarity: float = 0.8, block: int = 1_000_000, column: str = "overlaps") -> DataFrame:
    """docs with the array `column` of overlaps with benchmark(item_id, text); a column of that name is replaced."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // (4 * block)))

    def own(k: int) -> tuple[list, list[str]]:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").collect()
        return [r[0] for r in rows], [r[1] for r in rows]

    keep = [c for c in docs.columns if c != column]
    carry = [c for c in keep if c != "text"]
    base = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*base.schema.fields, T.StructField("hits", HITS)])
    if n_blocks == 1:
        out = base.mapInArrow(_by_block(*own(0), least, similarity), schema)
    else:
        text = packs(base)
        found = None
        for k in range(n_blocks):  # a job a block; the checkpoint holds hits only
            hits = checkpointed(each_pack(text, _in_pack(*own(k), least, similarity)))
            found = hits if found is None else found.unionAll(hits)
        out = by_key(text.unionAll(found), "pack", max(1, text.count()), _with_hits, schema)
    return out.select(*(F.col(f"c{carry.index(c)}").alias(c) if c != "text" else F.col("text").cast(docs.schema["text"].dataType).alias(c) for c in keep), F.col("hits").alias(column))


def _by_block(ids: list, texts: list[str], least: int, similarity: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits.release()
        own = None
        for batch in batches:
            own = own or Block(ids, texts)
            for part in bits.slices(batch, "text", SLICE):
                hits = pa.array(own.overlaps(part.column("text"), least, similarity), _ARROW)
                yield pa.RecordBatch.from_arrays([*part.columns, hits], [*part.schema.names, "hits"])

    return run


def _in_pack(ids: list, texts: list[str], least: int, similarity: float):
    """The hits of a pack's rows with one block, as one Arrow stream of (row, hits)."""
    held: list[Block] = []

    def run(pack: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Block(ids, texts))
        row, hits, base = [], [], 0
        for batch in table.to_batches():
            for part in bits.slices(batch, "text", SLICE):
                found = held[0].overlaps(part.column("text"), least, similarity)
                some = [i for i, f in enumerate(found) if f]
                row += [base + i for i in some]
                hits += [found[i] for i in some]
                base += part.num_rows
        if row:
            yield rows([(pack, 1, 0, packed(pa.table({"row": pa.array(row, pa.int64()), "hits": pa.array(hits, _ARROW)})))])

    return run


def _with_hits(pack: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    table = unpacked(held[0][3])
    found: dict[int, list] = {}
    for *_, blob in held[1:]:
        for row, hits in zip(*(c.to_pylist() for c in unpacked(blob).columns)):
            found.setdefault(row, []).extend(hits)
    base = 0
    for batch in table.to_batches():
        for part in bits.slices(batch, "text", SLICE):
            hits = [sorted(found.get(base + i, []), key=_order) for i in range(part.num_rows)]
            base += part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, _ARROW)], [*part.schema.names, "hits"])


def judged(docs: DataFrame, benchmark: DataFrame, least: int = 13, similarity: float = 0.8) -> DataFrame:
    """(doc_id, contaminated, n_overlaps long, item_ids array<long>, overlaps) for every row of docs."""
    found = overlapping(docs.select("doc_id", "text"), benchmark, least, similarity)
    items = F.array_sort(F.array_distinct(F.transform("overlaps", lambda x: x["item_id"])))
    return found.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size("overlaps").cast("long").alias("n_overlaps"), items.alias("item_ids"), "overlaps")

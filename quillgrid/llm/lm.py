"""Language-model scores from a sharded n-gram trie in Elias-Fano form.

The model is a bigram model with interpolated absolute discounting over an add-one unigram distribution:
p(w | v) = max(c(vw) - D, 0) / c(v) + D n(v) / c(v) * (c(w) + 1) / (N + V + 1), n(v) the number of successors of v.

The trie is cut by ranges of the hash of the first word, so a shard holds whole contexts. Its first level has the words; an Elias-Fano
sequence of pointers, monotone, gives each word's range of successors; the second level has the successors, each as
the rank of its context followed by 28 bits of its hash, which makes the level one monotone sequence, again in Elias-Fano form. The
discounted probabilities and back-off weights are quantised to 8 bits in equal-population bins, as in memory-mapped language
models; all levels of a shard lie in one anonymous memory map and are queried as they lie there. A query (v, w) takes the range of v
from two pointers and searches the successor of its value in it: select on the high bits gives a bucket, bisection of packed low bits the place.

A pack of documents sends its distinct words and bigrams once, with their counts in training documents, to the shards of their contexts.
A shard adds up all packs, builds its trie, and answers each pack in the order of its keys; with the answers a pack scores its documents.
So both the model and what is gathered grow with the corpus while no task holds more than a shard or a pack, and
a frequent word costs a pack one entry for each distinct successor.

A frequent context is split: its successors go to one of `SPLIT` shards by their hash. Its totals are not in one shard then, so
contexts are split only where a first pass has found the word frequent, and that pass, which counts such words exactly, supplies the totals.

Edge cases: a null text counts as empty; an empty text has one token, the end; a null doc_id is never trained on and counts as held
out; rows that repeat are rows; without training documents every count is 0 (train_tokens 0); an empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits
from .exchange import PACKS, by_key, checkpointed, each_pack, packs, rows, shard_of, unpacked

SLICE = 1 << 20
TEXT, GRAMS, STATS = range(3)
END, BOS = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0xB05B05B05B05B057)
WIDTH = 28
DISCOUNT = 0.75
LEVELS = 255
#: Queries that are answered together.
QUERIES = 1 << 16
#: A word with this share of a pack's tokens is a candidate for splitting; with this share of all it is split.
FREQUENT = 1 / 256
SPLIT = 16


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Position of the k-th set bit of a byte.
_SELECT = np.argsort(1 - _BITS.astype(np.int8), axis=1, kind="stable").astype(np.int64)


class EliasFano:
    """A monotone sequence of 64-bit integers: low bits packed, high bits in unary with the number of ones before each 256 bits.

    It is read as it lies: an element by the select of its one, a bucket of equal high bits by the selects of two zeros.
    """

    BLOCK = 1 << 15

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before
        self.words = np.ndarray(max(0, len(low) - 7), "<u8", low, strides=(1,)) if len(low) > 7 else np.zeros(1, np.uint64)
        self.unary = np.ndarray(8 * len(high) - 7, "<u8", high, strides=(1,)) if len(high) else np.zeros(1, np.uint64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        low_bits = min(56, max(0, int(values[-1]).bit_length() - n.bit_length())) if n else 0
        parts = []
        for a in range(0, n, cls.BLOCK):
            part = values[a : a + cls.BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
            parts.append(np.packbits(np.unpackbits(part, axis=1, count=low_bits, bitorder="little").ravel(), bitorder="little") if low_bits else np.zeros(0, np.uint8))
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(at[-1]) if n else 0) // 256 + 1) * 256 + 256, np.uint8)  # zeros follow the last one
        unary[at] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).reshape(-1, 4).sum(1)
        return cls(n, low_bits, np.concatenate([*parts, np.zeros(8, np.uint8)]), high, np.concatenate(([0], np.cumsum(ones)))[:-1].astype(np.uint32))

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th one, or zero, of the unary part."""
        before = self.before.astype(np.int64)
        before = before if one else 256 * np.arange(len(before)) - before
        block = np.searchsorted(before, k, "right") - 1
        rest = k - before[block]
        word = self.high[4 * block[:, None] + np.arange(4)]
        word = word if one else ~word
        place = block * 256
        for step, part in ((64, word), (8, None)):
            part = chosen.view(np.uint8).reshape(-1, 8) if part is None else part
            done = np.cumsum(np.bitwise_count(part), axis=1, dtype=np.int64)
            own = (done <= rest[:, None]).sum(1)
            rest = rest - np.where(own > 0, np.take_along_axis(done, np.maximum(own - 1, 0)[:, None], 1)[:, 0], 0)
            chosen = np.ascontiguousarray(np.take_along_axis(part, own[:, None], 1)[:, 0])
            place = place + step * own
        return place + _SELECT[chosen, rest]

    def low_at(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        return (self.words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(i), np.uint64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at these places."""
        return (self.select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits) | self.low_at(i)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the elements with these high bits: a select for the first, then the ones that follow."""
        high = np.minimum(high, 64 * len(self.high) - self.n - 1)  # the zeros there are
        first = np.where(high > 0, self.select(np.maximum(high - 1, 0), False) - high + 1, 0)
        at = first + high
        zeros = ~(self.unary[np.minimum(at >> 3, len(self.unary) - 1)] >> (at & 7).astype(np.uint64))
        size = np.bitwise_count((zeros & (~zeros + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        more = np.flatnonzero(size >= 56)  # the word may not hold them all
        size[more] = self.select(high[more], False) - high[more] - first[more]
        return first, first + size

    def search(self, value: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in first..end of the first element not less than each value, and whether it equals it: by its bucket, then by bisection of the low bits."""
        a, b = self.bucket((value >> np.uint64(self.low_bits)).astype(np.int64))
        at, stop = np.minimum(np.maximum(a, first), end), np.maximum(np.minimum(b, end), first)
        last = stop.copy()
        low = value & np.uint64((1 << self.low_bits) - 1)
        while len(alive := np.flatnonzero(at < last)):
            middle = (at[alive] + last[alive]) >> 1
            less = self.low_at(middle) < low[alive]
            at[alive] = np.where(less, middle + 1, at[alive])
            last[alive] = np.where(less, last[alive], middle)
        equal = at < stop  # in the bucket the high bits agree
        equal[equal] = self.low_at(at[equal]) == low[equal]
        return at, equal

    def successor(self, value: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.search(value, first, end)[0]

    def values(self) -> np.ndarray:
        """All elements, for a reader that wants every one."""
        out = np.zeros(self.n, np.uint64)
        for a in range(0, self.n, self.BLOCK):
            i = np.arange(a, min(self.n, a + self.BLOCK))
            out[a : a + self.BLOCK] = self.low_at(i)
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        return out | (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)

    def tobytes(self) -> bytes:
        return struct.pack("<qqqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.before)) + self.low.tobytes() + self.high.tobytes() + self.before.tobytes()

    @classmethod
    def read(cls, raw: bytes | mmap.mmap, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<qqqqq", raw, at)
        at += 40
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, "<u8", b, at + a), np.frombuffer(raw, np.uint32, c, at + a + 8 * b)), at + a + 8 * b + 4 * c


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1..LEVELS of positive values by equal-population bins, and the codebook of bin means; code 0 is zero."""
    book = np.zeros(LEVELS + 1, np.float32)
    if not len(values):
        return np.zeros(0, np.uint8), book
    distinct = np.unique(values)
    if len(distinct) <= LEVELS:
        book[1 : len(distinct) + 1] = distinct
        return (np.searchsorted(distinct, values) + 1).astype(np.uint8), book
    edges = np.unique(np.quantile(values, np.arange(1, LEVELS) / LEVELS))
    code = np.searchsorted(edges, values, "right") + 1
    total, size = np.bincount(code, values, LEVELS + 1), np.bincount(code, minlength=LEVELS + 1)
    book[:] = total / np.maximum(size, 1)
    return code.astype(np.uint8), book


class Trie:
    """One shard: words, their ranges of successors, quantised probabilities and back-off weights."""

    def __init__(self, words: int, value: np.ndarray, count: np.ndarray, total: dict[int, int]) -> None:
        """value: sorted (context rank << WIDTH | successor); total: counts of split contexts, by rank."""
        context = (value >> np.uint64(WIDTH)).astype(np.int64)
        n = np.bincount(context, minlength=words)
        history = np.bincount(context, count, words)
        for k, c in total.items():
            history[k] = c
        some = n > 0
        code, book = quantised((count - DISCOUNT) / history[context] if len(value) else np.zeros(0))
        weight = np.zeros(words, np.uint8)
        weight[some], weights = quantised(DISCOUNT * n[some] / history[some])
        self.book, self.weights, self.successors = book, weights, n
        raw = [EliasFano.of(np.concatenate(([0], np.cumsum(n))).astype(np.uint64)).tobytes(), EliasFano.of(value).tobytes(), code.tobytes(), weight.tobytes()]
        self.map = mmap.mmap(-1, max(1, sum(map(len, raw))))
        self.map.write(b"".join(raw))
        self.pointer, at = EliasFano.read(self.map, 0)
        self.level, at = EliasFano.read(self.map, at)
        self.code = np.frombuffer(self.map, np.uint8, len(code), at)
        self.weight = np.frombuffer(self.map, np.uint8, words, at + len(code))

    def successor(self, value: np.ndarray) -> np.ndarray:
        """The code of each query value: the successor of it within the range that the pointers give to its context, if that equals it."""
        out = np.zeros(len(value), np.uint8)
        for a in range(0, len(value) if self.level.n else 0, QUERIES):
            own = value[a : a + QUERIES]
            context, which = np.unique((own >> np.uint64(WIDTH)).astype(np.int64), return_inverse=True)
            first, end = (self.pointer.get(c).astype(np.int64)[which] for c in (context, context + 1))
            at, found = self.level.search(own, first, end)
            out[a + np.flatnonzero(found)] = self.code[at[found]]
        return out


class Grams:
    """The tokens of a pack: distinct words and bigrams in the order in which they are dealt, with training counts."""

    def __init__(self, table: pa.Table, frequent: dict[int, int]) -> None:
        self.part: list[pa.RecordBatch] = []
        tok, ctx, row, train, base = [], [], [], [], 0
        for batch in table.to_batches():
            for part in bits.slices(batch, "text", SLICE):
                t, c, r = tokens(part.column("text"))
                tok.append(t)
                ctx.append(c)
                row.append(r + base)
                train.append(trained(part.column("doc_id")))
                base += part.num_rows
        self.n_rows = base
        self.token, self.row, self.train = np.concatenate(tok), np.concatenate(row), np.concatenate(train)
        context = np.concatenate(ctx)
        if frequent:  # a split context has one word for each part
            hot = np.isin(context, np.array(list(frequent), np.uint64))
            context = np.where(hot, parts_of(context, self.token), context)
        self.word, self.which = np.unique(np.concatenate((self.token, context)), return_inverse=True)
        n = len(self.token)
        self.which, self.context = self.which[:n], self.which[n:]
        weight = self.train[self.row].astype(np.float64)
        self.count = np.bincount(self.which, weight, len(self.word)).astype(np.uint32)
        value = (self.context.astype(np.uint64) << np.uint64(WIDTH)) | (self.token >> np.uint64(64 - WIDTH))
        self.value, self.pair = np.unique(value, return_inverse=True)
        self.pair_count = np.bincount(self.pair, weight, len(self.value)).astype(np.uint32)

    def blocks(self, shards: int) -> Iterator[tuple[int, bytes]]:
        cut = np.searchsorted(shard_of(self.word, shards), np.arange(shards + 1))
        pair_cut = np.searchsorted(self.value, cut.astype(np.uint64) << np.uint64(WIDTH))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            a, b, c, d = cut[k], cut[k + 1], pair_cut[k], pair_cut[k + 1]
            own = self.value[c:d] - (np.uint64(a) << np.uint64(WIDTH))
            raw = struct.pack("<ii", b - a, d - c) + self.word[a:b].tobytes() + self.count[a:b].tobytes() + self.pair_count[c:d].tobytes() + EliasFano.of(own).tobytes()
            yield k, zstandard.ZstdCompressor(level=1).compress(raw)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, context and row: the words of each text in lower case, then its end."""
    data, offsets = bits.buffer(column)
    data = bits.LOWER[data]
    start, end, count = bits.words(data, offsets)
    word = bits.hashes(data, start, end) if len(data) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(count)), count + 1)
    token = np.full(len(row), END)
    token[np.arange(len(word)) + np.repeat(np.arange(len(count)), count)] = word
    context = np.empty(len(row), np.uint64)
    context[1:] = token[:-1]
    context[np.cumsum(count + 1) - count - 1] = BOS
    return token, context, row


def parts_of(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return bits.mix(context + np.uint64(1) + ((token >> np.uint64(8)) % np.uint64(SPLIT)))


def split_of(key: int) -> list[int]:
    """The hashes of the parts of a split context."""
    return parts_of(np.full(SPLIT, key, np.uint64), np.arange(SPLIT, dtype=np.uint64) << np.uint64(8)).tolist()


def trained(ids: pa.Array) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i in ids.to_pylist()], bool)


def _shard(frequent: dict[int, int]):
    """Adds up what all packs sent, builds the trie, answers each pack."""
    totals = {int(h): c for key, c in frequent.items() for h in split_of(key)}

    def run(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = []
        for *_, blob in held:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n, m = struct.unpack_from("<ii", raw)
            word, count, pairs = np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n), np.frombuffer(raw, np.uint32, m, 8 + 12 * n)
            parts.append((word, count, pairs, EliasFano.read(raw, 8 + 12 * n + 4 * m)[0].values()))
        word, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(which, np.concatenate([p[1] for p in parts]), len(word)).astype(np.int64)
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        asked = []
        for p, a, b in zip(parts, cut, cut[1:]):
            rank = which[a:b].astype(np.uint64)
            asked.append((rank[(p[3] >> np.uint64(WIDTH)).astype(np.int64)] << np.uint64(WIDTH)) | (p[3] & np.uint64((1 << WIDTH) - 1)))
        value, pair = np.unique(np.concatenate(asked), return_inverse=True)
        times = np.bincount(pair, np.concatenate([p[2] for p in parts]), len(value))
        some = times > 0
        rank = {int(h): k for k, h in enumerate(word.tolist()) if h in totals} if totals else {}
        trie = Trie(len(word), value[some], times[some], {k: totals[h] for h, k in rank.items()})
        books = trie.book.tobytes() + trie.weights.tobytes()
        del pair, value, times
        split = np.array([[h, trie.successors[k]] for h, k in rank.items()], np.uint64).reshape(-1, 2)
        out = [(0, STATS, shard, struct.pack("<qq", int(count.sum()), int((count > 0).sum())) + split.tobytes())]
        for row, v, a, b in zip(held, asked, cut, cut[1:]):
            own = which[a:b]
            raw = struct.pack("<ii", b - a, len(v)) + books + count[own].tobytes() + trie.weight[own].tobytes() + trie.successor(v).tobytes()
            out.append((row[0], GRAMS, shard, zstandard.ZstdCompressor(level=1).compress(raw)))
        yield rows(out)

    return run


def frequent_words(text: DataFrame, share: float = FREQUENT) -> dict[int, int]:
    """Words that are contexts of more than this share of the training tokens, with their exact counts; at most 1/share of them.

    A word with that share of all tokens has it in some pack; such words are candidates, at most 1/share a pack. A second
    pass counts the candidates, of which the most frequent 16/share are enough to hold all frequent words.
    """

    def top(pack: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        found, n = _contexts(table, None)
        keep = [(k, c) for k, c in found if c > share * n]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.int64()), pa.array([c for _, c in keep], pa.int64())], ["word", "n"])

    candidates = each_pack(text, top, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(int(16 / share)).collect()
    if not candidates:
        return {}
    wanted = np.sort(np.array([r[0] for r in candidates], np.int64).view(np.uint64))

    def exact(pack: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        found, n = _contexts(table, wanted)
        yield pa.RecordBatch.from_arrays([pa.array([*(k for k, _ in found), None], pa.int64()), pa.array([*(c for _, c in found), n], pa.int64())], ["word", "n"])

    counted = {r[0]: r[1] for r in each_pack(text, exact, "word long, n long").groupBy("word").agg(F.sum("n")).collect()}
    total = counted.pop(None, 0)
    return {k & (1 << 64) - 1: c for k, c in counted.items() if c > share * total}


def _contexts(table: pa.Table, wanted: np.ndarray | None) -> tuple[list[tuple[int, int]], int]:
    own, n = [], 0
    for batch in table.to_batches():
        for part in bits.slices(batch, "text", SLICE):
            _, context, row = tokens(part.column("text"))
            context = context[trained(part.column("doc_id"))[row]]
            n += len(context)
            own.append(context[np.isin(context, wanted)] if wanted is not None else context)
    key, count = np.unique(np.concatenate(own), return_counts=True)
    return list(zip(key.view(np.int64).tolist(), count.tolist())) if wanted is not None else [(k, c) for k, c in zip(key[count > 1].view(np.int64).tolist(), count[count > 1].tolist())], n


def scored(docs: DataFrame, pack_bytes: int | None = None, share: float = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    text = packs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), limit=pack_bytes)
    n_packs = max(1, text.count())
    shards = max(4, n_packs // 2)
    frequent = frequent_words(text, share)

    def ask(pack: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield rows([(pack, GRAMS, k, blob) for k, blob in Grams(table, frequent).blocks(shards)])

    told = checkpointed(by_key(each_pack(text, ask), "part", shards, _shard(frequent), PACKS))
    stats = told.where(F.col("kind") == STATS)
    big_n, big_v, split = _totals(stats, frequent)

    def score(pack: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        table = unpacked(held[0][3])
        g = Grams(table, frequent)
        count, weight, ratio = np.zeros(len(g.word), np.int64), np.zeros(len(g.word)), np.zeros(len(g.value))
        a = c = 0
        for *_, blob in held[1:]:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n, m = struct.unpack_from("<ii", raw)
            size = 4 * (LEVELS + 1)
            book, weights = np.frombuffer(raw, np.float32, LEVELS + 1, 8), np.frombuffer(raw, np.float32, LEVELS + 1, 8 + size)
            at = 8 + 2 * size
            count[a : a + n] = np.frombuffer(raw, np.int64, n, at)
            weight[a : a + n] = weights[np.frombuffer(raw, np.uint8, n, at + 8 * n)]
            ratio[c : c + m] = book[np.frombuffer(raw, np.uint8, m, at + 9 * n)]
            a, c = a + n, c + m
        if a != len(g.word) or c != len(g.value):
            raise RuntimeError("the answers do not fit the pack")
        own = count[g.which]
        base = np.log10((own + 1) / (big_n + big_v + 1))
        lam = weight[g.context]
        if split:
            keys = np.array(sorted(split), np.uint64)
            at = np.minimum(np.searchsorted(keys, g.word), len(keys) - 1)
            lam = np.where(keys[at] == g.word, np.array([split[int(k)] for k in keys])[at], weight)[g.context]
        lam[lam == 0] = 1
        p = ratio[g.pair] + lam * (own + 1) / (big_n + big_v + 1)
        sums = [np.bincount(g.row, x, g.n_rows) for x in (np.ones(len(own)), own > 0, base, np.log10(p))]
        yield pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks(), pa.array(~g.train), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(np.full(g.n_rows, big_n)), pa.array(sums[2]), pa.array(sums[3])],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_key(text.unionAll(told.where(F.col("kind") == GRAMS)), "pack", n_packs, score, schema)


def _totals(stats: DataFrame, frequent: dict[int, int]) -> tuple[int, int, dict[int, float]]:
    """Training tokens, distinct training tokens, and the back-off weight by part of each split context.

    One row a shard is summed by Spark; what comes to the driver is bounded by the number of frequent words.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                n, v = struct.unpack_from("<qq", blob)
                split = np.frombuffer(blob, np.uint64, -1, 16).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([None, *split[:, 0].view(np.int64).tolist()], pa.int64()), pa.array([n, *split[:, 1].tolist()], pa.int64()), pa.array([v, *(0 for _ in split)], pa.int64())], ["part", "n", "v"])

    found = {r[0]: (r[1], r[2]) for r in stats.mapInArrow(run, "part long, n long, v long").groupBy("part").agg(F.sum("n"), F.sum("v")).collect()}
    n, v = found.pop(None, (0, 0))
    out = {}
    for key, c in frequent.items():
        parts = split_of(key)
        size = sum(found.get(h - (1 << 64) if h >> 63 else h, (0, 0))[0] for h in parts)
        out |= {h: DISCOUNT * size / c for h in parts}
    return int(n), int(v), out

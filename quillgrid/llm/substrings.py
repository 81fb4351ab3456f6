"""Removal of word passages that an earlier document has: seed and extend on winnowed anchors.

Words are runs of other than white space. Every window of `length` words is seen at the least hash of its `gram`-word
grams (winnowing), so two equal windows share an anchor at the same place.

1. Seeds: each pack sends its distinct anchors; shards tell which anchors occur in two documents. That is the join of documents on anchors, with
   one entry a pack for each anchor.
2. Extension: around each joined anchor the matches are extended both ways over the windows that see it. Each window goes as 93 bits of two hashes, once a pack and
   with its least doc_id, to a shard, which tells whether a document outside the pack has it earlier. No pairs are made, so a
   passage in a third of all documents costs one entry a pack and window.
3. Windows that match are joined to maximal repeats, which all are `length` words or longer, and their words go.

Edge cases: null and empty texts have no words (null stays null in `kept`); fewer words than `length` are never touched; rows that repeat a doc_id
do not remove each other's words; a null doc_id loses nothing and removes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits
from .exchange import PACKS, by_key, dealt, each_pack, packs, rows, unpacked
from .winnow import chosen

SLICE = 1 << 20
TEXT, SEEDS, WINDOWS, SEEDED = range(4)
KEY = 5


class Words:
    """A slice of texts as words, with its anchors; rows without an id have none."""

    def __init__(self, part: pa.RecordBatch, length: int, gram: int) -> None:
        self.part = part
        self.data, offsets = bits.buffer(part.column("text"))
        self.start, self.end, self.count = bits.words(self.data, offsets)
        self.length = length
        ids = part.column("id")
        self.id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        first = np.cumsum(self.count) - self.count
        windows = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.maximum(self.count - length + 1, 0), 0)
        token = bits.hashes(self.data, self.start, self.end) if len(self.data) else np.zeros(0, np.uint64)
        self.roll, self.second = bits.Roll(token), bits.Roll(token, second=True)
        grams = bits.grams(token, gram)
        self.pos, self.lo, self.hi = chosen(grams, first, windows, length - gram + 1)
        self.key = grams[self.pos] if len(self.pos) else np.zeros(0, np.uint64)
        self.row = np.searchsorted(np.cumsum(self.count), self.pos, "right")

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, hash, 32 bits of another hash, and row of each window that sees the given anchors."""
        size = (self.hi - self.lo + 1)[of]
        at = bits.ranges(self.lo[of], size)
        return at, self.roll.spans(at, at + self.length), (self.second.spans(at, at + self.length) >> np.uint64(32)).astype(np.uint32), np.repeat(self.row[of], size)


def _slices(table: pa.Table, length: int, gram: int) -> Iterator[Words]:
    for batch in table.to_batches():
        for part in bits.slices(batch, "text", SLICE):
            yield Words(part, length, gram)


def _least(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, the least doc of each, and whether it has another."""
    if not len(key):
        return key, doc, np.zeros(0, bool)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.append(first[1:], len(key)) - 1
    return key[first], doc[first], doc[first] != doc[last]


def _least_window(key: np.ndarray, more: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted windows as two hashes, the least doc of each, and the place of each given window among them."""
    order = np.lexsort((doc, more, key))
    key, more, doc = key[order], more[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return key[new], more[new], doc[new], place


def _short(keys: np.ndarray) -> bytes:
    """The middle five bytes of keys, which are in one shard: enough to tell candidates."""
    return keys.view(np.uint8).reshape(-1, 8)[:, 2 : 2 + KEY].tobytes()


def _long(blob: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(blob, np.uint8, n * KEY, at).reshape(n, KEY)
    return out.view(np.uint64).ravel()


def _seeds(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """For each key of each pack, a bit: two documents have it."""
    keys, many = [], []
    for *_, blob in held:
        n = struct.unpack_from("<i", blob)[0]
        keys.append(_long(blob, n, 4))
        many.append(np.unpackbits(np.frombuffer(blob, np.uint8, -1, 4 + n * KEY), count=n))
    key, more = np.concatenate(keys), np.concatenate(many)
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    size = np.diff(np.append(first, len(key)))
    flag = (size > 1) | (np.add.reduceat(more[order].astype(np.int64), first) > 0)
    out = np.empty(len(key), np.uint8)
    out[order] = np.repeat(flag, size)
    cut = np.cumsum([0, *map(len, keys)])
    yield rows([(r[0], SEEDS, shard, struct.pack("<i", b - a) + np.packbits(out[a:b]).tobytes()) for r, a, b in zip(held, cut, cut[1:])])


def _earlier(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """For each window of each pack, a bit: a document outside the pack has it, with a smaller id than any in the pack."""
    own = [r for r in held if r[1] == WINDOWS]
    keys, more, docs = [], [], []
    for *_, blob in own:
        n = struct.unpack_from("<i", blob)[0]
        keys.append(np.frombuffer(blob, np.uint64, n, 4))
        docs.append(np.frombuffer(blob, np.int64, n, 4 + 8 * n))
        more.append(np.frombuffer(blob, np.uint32, n, 4 + 16 * n))
    out = [(pack, SEEDED, part, blob) for pack, kind, part, blob in held if kind == SEEDED]
    if own:
        doc = np.concatenate(docs)
        _, _, least, place = _least_window(np.concatenate(keys), np.concatenate(more), doc)
        flag = (least[place] < doc).astype(np.uint8)
        cut = np.cumsum([0, *map(len, keys)])
        out += [(r[0], WINDOWS, shard, struct.pack("<i", b - a) + np.packbits(flag[a:b]).tobytes()) for r, a, b in zip(own, cut, cut[1:])]
    yield rows(out)


def _bits(held: list[tuple], n: int) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(b, np.uint8, -1, 4), count=struct.unpack_from("<i", b)[0]) for *_, b in held]
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    if len(out) != n:
        raise RuntimeError(f"{len(out)} answers to {n} keys")
    return out.astype(bool)


def removed(docs: DataFrame, length: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, pack_bytes: int | None = None) -> DataFrame:
    """The columns in carry, with kept string, n_words and n_removed long for each row of docs."""
    carry = [id_col] if carry is None else carry
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    text = packs(inner, limit=pack_bytes)
    n_packs = max(1, text.count())
    shards = max(4, n_packs // 4)

    def ask(pack: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = list(_slices(table, length, gram))
        key, _, more = _least(np.concatenate([p.key for p in parts]), np.concatenate([p.id[p.row] for p in parts]))
        yield rows([(pack, SEEDS, k, struct.pack("<i", b - a) + _short(key[a:b]) + np.packbits(more[a:b]).tobytes()) for k, a, b in dealt(key, shards)])

    told = by_key(each_pack(text, ask), "part", shards, _seeds, PACKS)

    def extend(pack: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = list(_slices(unpacked(held[0][3]), length, gram))
        key = np.concatenate([p.key for p in parts])
        unique = np.unique(key)
        joined = _bits(held[1:], len(unique))[np.searchsorted(unique, key)] if len(key) else np.zeros(0, bool)
        window, base = [], 0
        for p in parts:
            _, h, more, row = p.windows(np.flatnonzero(joined[base : base + len(p.pos)]))
            window.append((h, more, p.id[row]))
            base += len(p.pos)
        if joined.any():
            h, m, d, _ = _least_window(*map(np.concatenate, zip(*window)))
            out = [(pack, WINDOWS, k, struct.pack("<i", b - a) + h[a:b].tobytes() + d[a:b].tobytes() + m[a:b].tobytes()) for k, a, b in dealt(h, shards)]
            yield rows([*out, (pack, SEEDED, out[0][2], struct.pack("<i", len(joined)) + np.packbits(joined).tobytes())])

    found = by_key(by_key(text.unionAll(told), "pack", n_packs, extend, PACKS), "part", shards, _earlier, PACKS)

    def cut(pack: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = list(_slices(unpacked(held[0][3]), length, gram))
        seeded = [r for r in held if r[1] == SEEDED]
        total = sum(len(p.pos) for p in parts)
        joined = _bits(seeded, total) if seeded else np.zeros(total, bool)
        wins, base = [], 0
        for p in parts:
            wins.append(p.windows(np.flatnonzero(joined[base : base + len(p.pos)])))
            base += len(p.pos)
        _, _, d, place = _least_window(*(np.concatenate([w[c] for w in wins]) for c in (1, 2)), np.concatenate([p.id[w[3]] for p, w in zip(parts, wins)]))
        elsewhere = _bits([r for r in held if r[1] == WINDOWS], len(d))
        base = 0
        for p, (at, *_, row) in zip(parts, wins):
            k = place[base : base + len(at)]
            base += len(at)
            at = at[elsewhere[k] | (d[k] < p.id[row])]
            cover = np.zeros(len(p.start) + 1, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            yield _result(p, np.cumsum(cover[:-1]) > 0, len(carry))

    schema = T.StructType([*(T.StructField(f"c{i}", inner.schema[f"c{i}"].dataType) for i in range(len(carry))), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = by_key(text.unionAll(found), "pack", n_packs, cut, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "kept", "n_words", "n_removed")


def _result(p: Words, gone: np.ndarray, n_carry: int) -> pa.RecordBatch:
    row = np.repeat(np.arange(len(p.count)), p.count)
    kept = np.flatnonzero(~gone)
    size = (p.end - p.start)[kept] + 1
    data = np.append(p.data, np.uint8(32))[bits.ranges(p.start[kept], size)]
    data[np.cumsum(size) - 1] = 32
    per_row = np.bincount(row[kept], size, len(p.count)).astype(np.int64)
    ends = np.cumsum(per_row)
    keep = np.ones(len(data), bool)
    keep[ends[per_row > 0] - 1] = False
    offsets = np.concatenate(([0], np.cumsum(np.maximum(per_row - 1, 0))))
    null = p.part.column("text").is_null().to_numpy(zero_copy_only=False)
    text = pa.Array.from_buffers(pa.large_string(), len(p.count), [pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())])
    lost = np.bincount(row[gone], minlength=len(p.count)).astype(np.int64)
    return pa.RecordBatch.from_arrays([*(p.part.column(f"c{i}") for i in range(n_carry)), text.cast(pa.string()), pa.array(p.count.astype(np.int64)), pa.array(lost)], [*(f"c{i}" for i in range(n_carry)), "kept", "n_words", "n_removed"])

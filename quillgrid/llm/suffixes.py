"""Removal of repeated byte strings by a distributed merge sort of sparse suffixes.

A string of `length` bytes that occurs twice holds, in both places and at the same offset, the least hash of its first
`window` short grams (winnowing). Only the suffixes that start at such anchors are sorted: about two in `window` + 1 bytes, and
every repeated string is seen at one of them. The steps follow the distributed string sorters of Bingmann et al.:

1. Each pack of documents sends one hash of the common prefix of each anchor's suffix; shards of the key space tell which prefixes
   occur twice (distinguishing-prefix detection). Suffixes with a prefix of their own cannot repeat and are not exchanged.
2. Each pack sorts its remaining suffixes into a run, keeps equal contexts once, front-codes the run (common prefix with the
   predecessor, rest) and sends it in ranges of the alphabet.
3. Each range merges its runs with a loser tree that carries the common prefix lengths: heads are compared from the first byte
   that is not known to agree. The lengths come out with the merged order and delimit classes that share the prefix.
4. Within a class, the strings at each offset before the anchor are compared exactly, and the intervals of offsets whose string
   occurs twice go back to the packs, which remove the bytes they cover.

A class with more than `most` distinct contexts (a passage in a great many documents) is not merged in one task: its
strings go by hash, 77 bits of two, to shards that count them. A group of equal documents is one context a pack, whatever its size. Elsewhere
hashes only name candidates, and bytes decide.

Edge cases: a null text has no bytes and stays null in `kept`; texts under `length` bytes are never touched; null or repeated
doc_ids are rows like any other, as matching goes by row; an empty table gives an empty result. Removal is by bytes and may cut
a character; `kept` is therefore binary.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits
from .exchange import PACKS, by_key, checkpointed, dealt, each_pack, packs, rows, unpacked
from .winnow import chosen

GRAM = 16
SLICE = 1 << 20
SAMPLE = 48
TEXT, ASK, RUN, WINDOWS, MARKS, WINDOW_ANSWER, HOT = range(7)


class Anchors:
    """The anchors of one slice of texts: position, first and last string start, prefix key and context key."""

    def __init__(self, column: pa.Array, length: int) -> None:
        self.data, self.offsets = bits.buffer(column)
        self.length, window = length, length // 2
        empty = np.zeros(0, np.int64)
        self.pos = self.lo = self.hi = empty
        self.key = self.context = empty.view(np.uint64)
        size = np.diff(self.offsets)
        starts = np.maximum(size - length + 1, 0)
        if not starts.sum():
            return
        roll = bits.Roll(self.data)  # eight bytes a byte of text: not kept, as few slices need it again
        self.pos, self.lo, self.hi = chosen(bits.grams(self.data, GRAM), self.offsets[:-1], starts, window)
        self.key = roll.spans(self.pos, self.pos + shared(length))
        self.context = bits.mix(roll.spans(self.lo, self.hi + length) + (self.pos - self.lo).astype(np.uint64))

    def strings(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, hash and 16 bits of another hash of each string of the given anchors."""
        at = bits.ranges(self.lo[of], (self.hi - self.lo + 1)[of])
        if not len(at):
            return at, at.view(np.uint64), np.zeros(0, np.uint16)
        return at, bits.Roll(self.data).spans(at, at + self.length), (bits.Roll(self.data, second=True).spans(at, at + self.length) >> np.uint64(48)).astype(np.uint16)


def shared(length: int) -> int:
    """Bytes after an anchor that two equal strings share at least."""
    return length - length // 2 + 1


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their counts, at most 65535."""
    keys, count = np.unique(keys, return_counts=True)
    return keys, np.minimum(count, 65535).astype(np.uint16)


def paired(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted pairs as two arrays, their counts, at most 65535, and the place of each given pair among them."""
    order = np.lexsort((more, keys))
    keys, more = keys[order], more[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])
    first = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[first], more[first], np.minimum(np.diff(np.append(first, len(keys))), 65535).astype(np.uint16), place


def question(pack: int, kind: int, keys: np.ndarray, count: np.ndarray, more: np.ndarray, shards: int) -> list[tuple]:
    return [(pack, kind, k, struct.pack("<i", b - a) + keys[a:b].tobytes() + count[a:b].tobytes() + more[a:b].tobytes()) for k, a, b in dealt(keys, shards)]


def answers(most: int | None, kind: int):
    """Per key of each pack: bit 0 if it occurs twice in all, bit 1 if its contexts (`more`) are over `most`; without it, `more` is part of the key."""

    def run(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = []
        for *_, blob in held:
            n = struct.unpack_from("<i", blob)[0]
            parts.append((np.frombuffer(blob, np.uint64, n, 4), np.frombuffer(blob, np.uint16, n, 4 + 8 * n), np.frombuffer(blob, np.uint16, n, 4 + 10 * n)))
        keys, count, more = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys) if most is not None else np.lexsort((more, keys))
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        if most is None:
            new[1:] |= more[order][1:] != more[order][:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(keys)))
        flag = np.add.reduceat(count[order].astype(np.int64), first) > 1
        if most is not None:
            flag = flag | ((np.add.reduceat(more[order].astype(np.int64), first) > most).astype(np.uint8) << 1)
        out = np.empty(len(keys), np.uint8)
        out[order] = np.repeat(flag.astype(np.uint8), size)
        cut = np.cumsum([0, *(len(k) for k, *_ in parts)])
        yield rows([(row[0], kind, shard, out[a:b].tobytes()) for row, a, b in zip(held, cut, cut[1:])])

    return run


def common(s: bytes, t: bytes, h: int) -> int:
    """Length of the common prefix, of which h bytes are known."""
    n = min(len(s), len(t))
    while h < n:
        step = min(64, n - h)
        a, b = s[h : h + step], t[h : h + step]
        if a != b:
            return h + step - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8
        h += step
    return n


def front_coded(items: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, context before, anchor, copies here) as one compressed block."""
    lcp = np.zeros(len(items), np.uint16)
    tails = []
    last = b""
    for i, (s, *_) in enumerate(items):
        lcp[i] = h = common(last, s, 0)
        tails.append(s[h:])
        last = s
    head = [lcp, np.array([len(t) for t in tails], np.uint16), np.array([len(b) for _, b, *_ in items], np.uint16), np.array([k for *_, k, _ in items], np.uint32), np.array([c for *_, c in items], np.uint8)]
    raw = struct.pack("<i", len(items)) + b"".join(x.tobytes() for x in head) + b"".join(tails) + b"".join(b for _, b, *_ in items)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def decoded(blob: bytes) -> tuple[list[bytes], list[int], list[bytes], list[int], list[int]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = struct.unpack_from("<i", raw)[0], 4
    head = []
    for kind in (np.uint16, np.uint16, np.uint16, np.uint32, np.uint8):
        head.append(np.frombuffer(raw, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    lcp, tail, before, anchor, copies = head
    strings, last = [], b""
    for h, t in zip(lcp, tail):
        last = last[:h] + raw[at : at + t]
        strings.append(last)
        at += t
    contexts = []
    for b in before:
        contexts.append(raw[at : at + b])
        at += b
    return strings, lcp, contexts, anchor, copies


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the string before) in sorted order, by a loser tree of the runs.

    Each loser keeps its common prefix with the string that beat it. A head with the longer known prefix is the smaller
    one; only heads with equal known prefixes are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known, index = [0] * k, [0] * k
    tree = [0] * (2 * k)

    def play(a: int, b: int) -> tuple[int, int]:
        s, t = heads[a], heads[b]
        if s is None or t is None:
            return (b, a) if s is None else (a, b)
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        h = common(s, t, x)
        if h == len(s) and (h < len(t) or a < b) or h < len(s) and h < len(t) and s[h] < t[h]:
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while heads[best] is not None:
        yield best, index[best], known[best]
        index[best] = i = index[best] + 1
        strings, lcp = runs[best]
        if i < len(strings):
            heads[best], known[best] = strings[i], lcp[i]
        else:
            heads[best] = None
        node = (best + k) >> 1
        while node:
            best, tree[node] = play(best, tree[node])
            node >>= 1


def repeated(members: list[tuple[bytes, bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each (suffix, context before, copies) of a class: the intervals of offsets whose string occurs twice."""
    groups: dict[tuple[int, bytes], list[int]] = {}
    for i, (s, b, _) in enumerate(members):
        groups.setdefault((len(b), b + s), []).append(i)
    out: list[list[tuple[int, int]]] = [[] for _ in members]
    single = []
    for (most, text), own in groups.items():
        least = length - (len(text) - most)
        if len(own) > 1 or members[own[0]][2] > 1:
            for i in own:
                out[i] = [(least, most)]
        else:
            single.append((own[0], least, most))
    if not single or len(groups) < 2:
        return out
    spans = [(length - (len(text) - most), most, text, own[0]) for (most, text), own in groups.items()]
    for o in range(min(x[1] for x in single), max(x[2] for x in single) + 1):
        seen: dict[bytes, int] = {}
        again = set()
        here = []
        for least, most, text, i in spans:
            if least <= o <= most:
                s = text[most - o : most - o + length]
                here.append((s, i))
                if seen.setdefault(s, i) != i:
                    again.add(s)
        if again:
            for s, i in here:
                if s in again:
                    own = out[i]
                    if own and own[-1][1] >= o:
                        continue
                    if own and own[-1][1] == o - 1:
                        own[-1] = (own[-1][0], o)
                    else:
                        own.append((o, o))
    return out


def _anchors_of(table: pa.Table, length: int) -> Iterator[Anchors]:
    for batch in table.to_batches():
        for part in bits.slices(batch, "text", SLICE):
            yield Anchors(part.column("text"), length)


def _contexts_of(slices: list[Anchors]):
    """The bytes of an anchor's context, with the anchor's place in them, by the anchor's number in the pack."""
    cuts = np.cumsum([0, *(len(a.pos) for a in slices)])

    def text(i: int) -> tuple[int, bytes]:
        k = int(np.searchsorted(cuts, i, "right")) - 1
        a, i = slices[k], i - int(cuts[k])
        return int(a.pos[i] - a.lo[i]), a.data[a.lo[i] : a.hi[i] + a.length].tobytes()

    return text


def _flags(held: list[tuple], n: int) -> np.ndarray:
    """The answers, which are in the order of the n distinct keys."""
    flag = np.frombuffer(b"".join(blob for *_, blob in held), np.uint8)
    if len(flag) != n:
        raise RuntimeError(f"{len(flag)} answers to {n} keys")
    return flag


def removed(docs: DataFrame, length: int = 400, most: int = 20000, text_col: str = "text", carry: list[str] | None = None, as_text: bool = False, pack_bytes: int | None = None) -> DataFrame:
    """The columns in carry, with kept, n_bytes, n_removed and n_spans long for each row of docs.

    kept is binary, or with as_text a string without the characters that a removal cuts.
    """
    carry = ["doc_id"] if carry is None else carry
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col(f"`{text_col}`").cast("string").alias("text"))
    text = packs(inner, limit=pack_bytes)
    n_packs = max(1, text.count())
    shards = max(4, n_packs // 6)
    prefix = shared(length)

    def ask(pack: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        bits.release(powers=False)
        keys, contexts, sample = [], [], []
        for a in _anchors_of(table, length):
            keys.append(a.key)
            contexts.append(a.context)
            for p in a.pos[np.argsort(a.context)[: max(1, SAMPLE * len(a.data) // (6 << 20))]].tolist():
                sample.append((int.from_bytes(a.data[p : p + 8].tobytes(), "big") >> 1, RUN, 0, b""))
        key, context = np.concatenate(keys), np.concatenate(contexts)
        unique, count = counted(key)
        _, first = np.unique(bits.mix(key) + context, return_index=True)
        _, distinct = counted(key[first])
        yield rows(question(pack, ASK, unique, count, distinct, shards) + sample)

    asked = checkpointed(each_pack(text, ask))
    share = [k / n_packs for k in range(1, n_packs)]
    cuts = asked.where(F.col("kind") == RUN).agg(F.percentile_approx("pack", share, 20000)).first()[0] if share else []
    splitters = np.unique(np.array(cuts or [], np.int64))
    told = by_key(asked.where(F.col("kind") == ASK), "part", shards, answers(most, ASK), PACKS)

    def runs(pack: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held[0][1] != TEXT:
            raise RuntimeError("a pack without its text")
        bits.release(powers=False)
        slices = list(_anchors_of(unpacked(held[0][3]), length))
        key = np.concatenate([a.key for a in slices])
        unique, which = np.unique(key, return_inverse=True)
        flag = _flags(held[1:], len(unique))[which]
        items, window, hot, done, base = [], [], [], {}, 0
        for a in slices:
            own = flag[base : base + len(a.pos)]
            raw = a.data.tobytes()
            for i in np.flatnonzero(own == 1).tolist():
                p = int(a.pos[i])
                text = raw[p : int(a.hi[i]) + length], raw[int(a.lo[i]) : p]
                if text in done:
                    done[text][3] = min(255, done[text][3] + 1)
                else:
                    done[text] = item = [*text, base + i, 1]
                    items.append(item)
            if len(of := np.flatnonzero(own == 3)):
                window.append(a.strings(of)[1:])
                hot.append(of + base)
            base += len(a.pos)
        items.sort()
        out = []
        where = np.searchsorted(splitters, np.array([int.from_bytes(x[0][:8], "big") >> 1 for x in items], np.int64), "right") if items else np.zeros(0, np.int64)
        for k in np.unique(where).tolist():
            a, b = np.searchsorted(where, [k, k + 1])
            out.append((pack, RUN, k, front_coded(items[a:b])))
        if hot:
            unique, more, count, _ = paired(*map(np.concatenate, zip(*window)))
            out += question(pack, WINDOWS, unique, count, more, shards)
            out.append((pack, HOT, 0, np.concatenate(hot).astype(np.uint32).tobytes()))
        if out:
            yield rows(out)

    sent = checkpointed(by_key(text.unionAll(told), "pack", n_packs, runs, PACKS))

    def merge(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        bits.release(powers=False)
        blocks = [decoded(blob) for *_, blob in held]
        found: dict[int, list[tuple[int, int, int]]] = {}

        def close(group: list[tuple[int, int]]) -> None:
            if len(group) > 1 or blocks[group[0][0]][4][group[0][1]] > 1:
                members = [(blocks[r][0][i], blocks[r][2][i], blocks[r][4][i]) for r, i in group]
                for (r, i), spans in zip(group, repeated(members, length)):
                    if spans:
                        found.setdefault(r, []).extend((blocks[r][3][i], a, b) for a, b in spans)

        group: list[tuple[int, int]] = []
        for r, i, h in merged([(b[0], b[1]) for b in blocks]):
            if group and h < prefix:
                close(group)
                group = []
            group.append((r, i))
        if group:
            close(group)
        if found:
            yield rows([(held[r][0], MARKS, part, np.array(x, np.uint32).tobytes()) for r, x in found.items()])

    marks = by_key(sent.where(F.col("kind") == RUN), "part", len(splitters) + 1, merge, PACKS)
    counts = by_key(sent.where(F.col("kind") == WINDOWS), "part", shards, answers(None, WINDOW_ANSWER), PACKS)

    def cut(pack: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        bits.release(powers=False)
        table = unpacked(held[0][3])
        slices = list(_anchors_of(table, length))
        context = np.concatenate([a.context for a in slices])
        order = np.argsort(context)
        mark = np.concatenate([np.frombuffer(b, np.uint32).reshape(-1, 3) for _, kind, _, b in held if kind == MARKS] or [np.zeros((0, 3), np.uint32)]).astype(np.int64)
        lo, hi = (np.searchsorted(context, context[mark[:, 0]], side, sorter=order) for side in ("left", "right"))
        of, times = order[bits.ranges(lo, hi - lo)], hi - lo
        least, high = np.repeat(mark[:, 1], times), np.repeat(mark[:, 2], times)
        texts = _contexts_of(slices)  # equal hashes are candidates, equal bytes decide
        same = np.fromiter((texts(i) == texts(k) if i != k else True for i, k in zip(of.tolist(), np.repeat(mark[:, 0], times).tolist())), bool, len(of))
        of, least, high = of[same], least[same], high[same]
        hot = np.concatenate([np.frombuffer(b, np.uint32) for _, kind, _, b in held if kind == HOT] or [np.zeros(0, np.uint32)]).astype(np.int64)
        gone_at: list[np.ndarray] = []
        if len(hot):
            base, window = 0, []
            for a in slices:
                window.append(a.strings(hot[(hot >= base) & (hot < base + len(a.pos))] - base))
                base += len(a.pos)
            at, *keys = map(np.concatenate, zip(*window))
            unique, _, _, place = paired(*keys)
            again = (_flags([x for x in held if x[1] == WINDOW_ANSWER], len(unique))[place] & 1) > 0
            cuts = np.cumsum([0, *(len(w[0]) for w in window)])
            gone_at = [at[x:y][again[x:y]] for x, y in zip(cuts, cuts[1:])]
        base = row = 0
        for k, a in enumerate(slices):
            cover = np.zeros(len(a.data) + 1, np.int32)
            mine = (of >= base) & (of < base + len(a.pos))
            pos = a.pos[of[mine] - base]
            np.add.at(cover, pos - high[mine], 1)
            np.add.at(cover, pos - least[mine] + length, -1)
            if gone_at:
                np.add.at(cover, gone_at[k], 1)
                np.add.at(cover, gone_at[k] + length, -1)
            base += len(a.pos)
            gone = np.cumsum(cover[:-1]) > 0
            n = len(a.offsets) - 1
            part = table.slice(row, n)
            row += n
            yield _result(part, a, gone, len(carry), as_text)

    schema = T.StructType([T.StructField(f"c{i}", inner.schema[f"c{i}"].dataType) for i in range(len(carry))] + [T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])
    out = by_key(text.unionAll(marks).unionAll(counts).unionAll(sent.where(F.col("kind") == HOT)), "pack", n_packs, cut, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "kept", "n_bytes", "n_removed", "n_spans")


def _result(part: pa.Table, a: Anchors, gone: np.ndarray, n_carry: int, as_text: bool) -> pa.RecordBatch:
    """One row for each text of the slice, given which of its bytes go."""
    size = np.diff(a.offsets)
    sums = np.concatenate(([0], np.cumsum(gone)))
    lost = sums[a.offsets[1:]] - sums[a.offsets[:-1]]
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    heads = a.offsets[:-1][size > 0]
    first[heads] = gone[heads]
    runs = np.concatenate(([0], np.cumsum(first)))
    kept = a.data[~gone]
    ends = np.concatenate(([0], np.cumsum(size - lost)))
    null = part.column("text").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    binary = pa.Array.from_buffers(pa.large_binary(), len(size), [pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())])
    kept_column = binary.cast(pa.binary())
    if as_text:
        cut = set(np.flatnonzero(lost).tolist())
        kept_column = pa.array([x if i not in cut or x is None else x.decode("utf-8", "ignore").encode() for i, x in enumerate(kept_column.to_pylist())], pa.binary()).cast(pa.string())
    columns = [part.column(f"c{i}").combine_chunks() for i in range(n_carry)] + [kept_column, pa.array(size), pa.array(lost), pa.array(runs[a.offsets[1:]] - runs[a.offsets[:-1]])]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(n_carry)] + ["kept", "n_bytes", "n_removed", "n_spans"])

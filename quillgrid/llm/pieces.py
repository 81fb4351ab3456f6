"""SentencePiece encoding and decoding, driven by an Aho-Corasick automaton over the pieces.

One pass over a text follows the automaton; at each position its output links name the pieces that end there, and each of them
tries to improve the best segmentation that ends there:

* a unigram model keeps the highest sum of piece scores (Viterbi; of equal sums the longer last piece);
* a BPE model's own segmentation is not the one with the highest sum. There the one candidate is kept that merging would also
  leave as the last piece: the piece whose pair with the best piece before it is stable under the model's merges. The result is
  exactly that of the merges, in the same single pass.

Texts are cut between two bytes that stand side by side in no piece, which no segmentation crosses: before a run of spaces, around line feeds and most
punctuation. Each distinct segment of a worker's batches is encoded once; the rest is array work. Decoding gathers the bytes of the pieces.

The model is a SentencePiece file (a parameter); only the identity normaliser is supported, other models raise ValueError.

Edge cases: null and empty texts have no pieces (null stays null in `decoded`); characters without a piece become byte pieces, or the unknown
piece if the model has no bytes; equal rows are encoded alike; an empty table gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 1 << 20
#: Distinct segments that a worker remembers.
REMEMBERED = 1_000_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """A model: pieces, scores and the automaton."""

    def __init__(self, proto: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        norm, self.kind = model.normalizer_spec, model.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser are supported")
        if self.kind not in (UNIGRAM, BPE) or any(p.type == USER for p in model.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.prefix = norm.add_dummy_prefix
        self.score = {p.piece.replace("▁", " "): p.score for p in model.pieces if p.type == NORMAL}
        self.id = {p.piece.replace("▁", " "): i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.least = min(self.score.values(), default=0.0) - 10.0
        self.raw = [bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace("▁", " ").encode() for p in model.pieces]
        #: Byte pairs that stand side by side in some piece; no piece crosses any other pair, so texts are cut there.
        self.joins = np.zeros((256, 256), bool)
        for p in self.score:
            raw = p.encode()
            self.joins[list(raw[:-1]), list(raw[1:])] = True
        self.joins[:, 0x80:0xC0] = True  # never inside a character
        self.alphabet = frozenset(p for p in self.score if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.stable_pairs: dict[tuple[str, str], bool] = {}
        self.memory: dict[bytes, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merges themselves: the best pair first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (s := self.score.get(both := parts[i] + parts[j])) is not None:
                heappush(queue, (-s, i, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, both = heappop(queue)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def stable(self, left: str, right: str) -> bool:
        """Whether merging left + right ends with exactly these two; left may be empty."""
        found = self.stable_pairs.get((left, right))
        if found is None:
            if len(self.stable_pairs) > 2_000_000:
                self.stable_pairs.clear()
            found = self.stable_pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def segment(self, text: str) -> list[str]:
        """The pieces of a text, in one pass over the automaton's outputs; characters without a piece stand alone."""
        n = len(text)
        last: list[str] = [""] * (n + 1)
        if self.kind == BPE and text.startswith("  "):  # runs of spaces are pieces of equal score; merging has no stable pairs there
            return self.merged(text)
        outputs = ((end + 1, piece) for end, piece in self.automaton.iter(text)) if self.alphabet.issuperset(text) else self._outputs(text)
        if self.kind == BPE:
            pairs, score = self.stable_pairs, self.score
            for end, piece in outputs:
                if last[end]:
                    continue
                start = end - len(piece)
                left = last[start] if start else ""
                if start and not left:
                    continue
                own = pairs.get(("", piece))
                if self.stable("", piece) if own is None else own:
                    if left and left in score:
                        own = pairs.get((left, piece))
                        own = self.stable(left, piece) if own is None else own
                    else:
                        own = True
                    if own:
                        last[end] = piece
        else:
            best = [0.0] + [float("-inf")] * n
            for end, piece in outputs:
                start = end - len(piece)
                total = best[start] + self.score.get(piece, self.least)
                if total > best[end]:
                    best[end], last[end] = total, piece
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def _outputs(self, text: str) -> Iterator[tuple[int, str]]:
        """(end, piece) for all occurrences, by end, longest first; a character that no piece equals stands for itself."""
        at = 0
        for end, piece in self.automaton.iter(text):
            while at <= end:
                if text[at] not in self.score:
                    yield at + 1, text[at]
                at += 1
            yield end + 1, piece
        for i in range(at, len(text)):
            if text[i] not in self.score:
                yield i + 1, text[i]

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        unknown = False
        for p in self.segment(text):
            if (i := self.id.get(p)) is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            elif not unknown:
                out.append(self.unknown)
            unknown = i is None
        return out

    def known(self, raw: bytes) -> bytes:
        """The ids of a segment, four bytes each."""
        found = self.memory.get(raw)
        if found is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            found = self.memory[raw] = array("i", self.ids(raw.decode("utf-8", "replace"))).tobytes()
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and each row's offsets in them."""
        column = pc.replace_substring(column, "▁", " ")  # to a model they are the same
        if self.prefix:
            some = pc.greater(pc.binary_length(column), 0)
            column = pc.if_else(some, pc.binary_join_element_wise(" ", column, ""), column)
        data, offsets = bits.buffer(column)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        cut[1:n] |= ~self.joins[data[:-1], data[1:]]
        cut[n] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        raw = data.tobytes()
        _, first, which = np.unique(bits.hashes(data, start, end), return_index=True, return_inverse=True)
        size = end - start
        if not (np.array_equal(size, size[first][which]) and np.array_equal(data, data[bits.ranges(start[first][which], size)])):  # a hash that two segments share
            seen: dict[bytes, int] = {}
            which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist())])
            first = np.unique(which, return_index=True)[1]
        found = [self.known(raw[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist())]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        count = size[which]
        ids = flat[bits.ranges((np.cumsum(size) - size)[which], count)]
        total = np.concatenate(([0], np.cumsum(count)))
        return ids, total[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each row's pieces, without the space that encoding put before the text."""
        size = np.array([len(x) for x in self.raw], np.int64)
        table = np.frombuffer(b"".join(self.raw), np.uint8)
        count = size[ids]
        data = table[bits.ranges((np.cumsum(size) - size)[ids], count)]
        at = np.concatenate(([0], np.cumsum(count)))[offsets]
        if self.prefix and len(data):
            keep = np.ones(len(data), bool)
            heads = at[:-1][np.diff(at) > 0]
            keep[heads[data[heads] == 32]] = False
            moved = np.concatenate(([0], np.cumsum(keep)))
            return data[keep], moved[at]
        return data, at


@lru_cache(maxsize=2)
def load(proto: bytes) -> Pieces:
    return Pieces(proto)


bits.MODELS.append(load.cache_clear)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def encoded(docs: DataFrame, model: str = MODEL, carry: list[str] | None = None) -> DataFrame:
    """The columns in carry, with ids array<int>, n_pieces long and round_trip boolean (the decoded pieces are the text) per row.

    The model's bytes are read on the driver and travel with the tasks: half a megabyte for 32,000 pieces, whatever the corpus.
    """
    carry = ["doc_id"] if carry is None else carry
    with open(model, "rb") as f:
        proto = f.read()
    if len(proto) > 64 << 20:
        raise ValueError("the model is too large to send along")
    Pieces(proto)
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(proto)
        for batch in batches:
            for part in bits.slices(batch, "text", SLICE):
                text = part.column("text")
                ids, offsets = pieces.encode(text)
                back, at = pieces.decode(ids, offsets)
                data, own = bits.buffer(text)
                same = np.diff(at) == np.diff(own)
                if len(back) == len(data) and same.all():
                    wrong = np.concatenate(([0], np.cumsum(back != data)))
                    same = wrong[own[1:]] == wrong[own[:-1]]
                else:
                    same = np.array([back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(at, at[1:], own, own[1:])], bool)
                columns = [part.column(f"c{i}") for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*columns, lists(ids, offsets), pa.array(np.diff(offsets)), pa.array(same)], [*(f"c{i}" for i in range(len(carry))), "ids", "n_pieces", "round_trip"])
            bits.release(models=False)

    schema = T.StructType([*(T.StructField(f"c{i}", inner.schema[f"c{i}"].dataType) for i in range(len(carry))), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return inner.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "ids", "n_pieces", "round_trip")


def decoded(tokens: DataFrame, model: str = MODEL, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """tokens with the text of each row's ids; null ids give null."""
    with open(model, "rb") as f:
        proto = f.read()
    keep = [c for c in tokens.columns if c != column]
    inner = tokens.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{ids}`").cast("array<int>").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(proto)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                got = part.column("ids")
                flat = got.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = pc.fill_null(pc.list_value_length(got), 0).to_numpy(zero_copy_only=False)
                data, at = pieces.decode(flat, np.concatenate(([0], np.cumsum(size))))
                text = pa.array([None if null else data[x:y].tobytes().decode("utf-8", "replace") for null, x, y in zip(got.is_null().to_pylist(), at, at[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(f"c{i}") for i in range(len(keep))), text], [*(f"c{i}" for i in range(len(keep))), "text"])

    schema = T.StructType([*(T.StructField(f"c{i}", inner.schema[f"c{i}"].dataType) for i in range(len(keep))), T.StructField("text", T.StringType())])
    return inner.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.col("text").alias(column))

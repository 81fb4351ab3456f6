"""Vectorised text primitives over Arrow string columns: buffers, words, rolling hashes.

Everything works on whole record batches at once (numpy over the column's own bytes), so no Python object is made
per byte or per word. A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise; a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


P61 = (1 << 61) - 1
_P = U64(P61)
_MASK32, _MASK31, _MASK30, _MASK29 = (U64((1 << k) - 1) for k in (32, 31, 30, 29))
_BASES = (0x1A96D2F7B3C4E58D, 0x0B7E151628AED2A7)
_POWERS: dict[int, np.ndarray] = {}
_BLOCK = 1 << 20
LONG = 64


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit words modulo 2**61 - 1."""
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, elementwise, for a and b below it."""
    a1, a0, b1, b0 = a >> U64(31), a & _MASK31, b >> U64(31), b & _MASK31
    middle = a1 * b0 + a0 * b1
    low = a0 * b0
    return reduced(U64(2) * (a1 * b1) + (middle >> U64(30)) + ((middle & _MASK30) << U64(31)) + (low & _P) + (low >> U64(61)))


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers of the base, by doubling."""
    own = _POWERS.get(base, np.ones(1, U64))
    while len(own) < n:
        own = np.concatenate((own, product(own, U64(pow(base, len(own), P61)))))
    _POWERS[base] = own
    return own


#: What forgets a module's loaded models and the segments they remember.
MODELS: list[Callable[[], None]] = []


def release(powers: bool = True, models: bool = True) -> None:
    """Gives back what earlier tasks left in this worker, which Spark uses again: powers for long texts, models, free Arrow and C memory."""
    if powers:
        _POWERS.clear()
    for forget in MODELS if models else ():
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Roll:
    """Prefix sums of a polynomial hash modulo the prime 2**61 - 1: the hash of any span in constant time.

    Two different spans of n symbols have one hash for at most n of the 2**61 bases; modulo a power of two, strings such as Thue and
    Morse's would have one for every base. values are bytes or 64-bit words. A second hash, with another base, tells apart what the
    first by chance does not.
    """

    def __init__(self, values: np.ndarray, second: bool = False) -> None:
        n = len(values)
        base = _BASES[second]
        power, self.inverse = _powers(base, n + 1), _powers(pow(base, -1, P61), n + 1)
        self.acc = np.zeros(n + 1, U64)
        carry = U64(0)
        for a in range(0, n, _BLOCK):
            own, scale = values[a : a + _BLOCK], power[a : min(n, a + _BLOCK)]
            if own.dtype == np.uint8:  # 9 bits times 61 bits: sums of both halves fit
                own = own.astype(U64) + U64(1)
                low, high = np.cumsum(own * (scale & _MASK32)), np.cumsum(own * (scale >> U64(32)))
            else:
                terms = product(reduced(own), scale)
                low, high = np.cumsum(terms & _MASK32), np.cumsum(terms >> U64(32))
            high = reduced(high)
            out = reduced((((high & _MASK29) << U64(32)) | (high >> U64(29))) + reduced(low) + carry)
            self.acc[a + 1 : a + 1 + len(own)] = out
            carry = out[-1]

    def _hash(self, low: np.ndarray, high: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return product(np.where(high >= low, high - low, high + _P - low), inverse)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self._hash(self.acc[start], self.acc[end], self.inverse[start]) + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of every span of this width, by start."""
        n = max(0, len(self.acc) - width)
        return mix(self._hash(self.acc[:n], self.acc[width : width + n], self.inverse[:n]) + U64(width * 0x9E3779B97F4A7C15 % (1 << 64))) if n else np.zeros(0, U64)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans that are mostly short, as words are: eight bytes at a time, mixed after each; of more than LONG bytes by Roll."""
    size = end - start
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15))
    if not len(start):
        return out
    load = np.ndarray(len(data), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    alive = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        left = size[alive] - k
        alive, left = alive[left > 0], left[left > 0]
        if not len(alive):
            break
        part = load[start[alive] + k] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * np.minimum(left, 8).astype(U64)))
        out[alive] = mix((out[alive] ^ part) + U64(0xD1342543DE82EF95))
    long = np.flatnonzero(size > LONG)
    if len(long):
        ends = np.cumsum(size[long])
        out[long] = Roll(data[ranges(start[long], size[long])]).spans(ends - size[long], ends)
    return out


def grams(values: np.ndarray, width: int) -> np.ndarray:
    """A number for every span of this width, by start, that equal spans share: for choosing places, not for telling spans apart."""
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, U64)
    if n and values.dtype == np.uint8 and width % 8 == 0:
        values, width = np.ndarray(len(values) - 7, "<u8", np.ascontiguousarray(values), strides=(1,)), width // 8
        steps = range(0, 8 * width, 8)
    else:
        steps = range(width if n else 0)
    for k in steps:
        out = (out ^ (out >> U64(29))) * U64(0xD1342543DE82EF95) + values[k : k + n]
    return mix(out)


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about this many bytes; a row is never cut."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all rows, and each row's number of words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    start = np.flatnonzero(~space & (before | cut[:-1]))
    end = np.flatnonzero(~space & (after | cut[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with each run of white space as one space."""
    space = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    moved = np.concatenate(([0], np.cumsum(keep)))
    out = np.where(space, np.uint8(0x20), data)[keep]
    return out, moved[offsets]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... count[i] times, for every i."""
    total = int(count.sum())
    step = np.ones(total, np.int64)
    full = np.flatnonzero(count)
    if not total:
        return np.zeros(0, np.int64)
    head = np.cumsum(count[full]) - count[full]
    step[head] = first[full]
    step[head[1:]] -= first[full][:-1] + count[full][:-1] - 1
    return np.cumsum(step)

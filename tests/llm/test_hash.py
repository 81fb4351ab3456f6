"""Texts and words in the order of Thue and Morse, whose polynomial hashes modulo a power of two all agree."""

from __future__ import annotations

import hashlib
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from test_dedup import cut_bytes, cut_words

from quillgrid.llm import bits, lm, pieces, substrings, suffixes

ORDER = [k.bit_count() & 1 for k in range(2048)]
PLAIN, OTHER = "".join("ab"[t] for t in ORDER), "".join("ba"[t] for t in ORDER)


def test_spans_are_the_polynomial_modulo_the_prime():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, (1 << 20) + 5000).astype(np.uint8)
    own, base = bits.Roll(data), bits._BASES[0]
    for a, b in ((0, 5), (17, 90), ((1 << 20) - 6, (1 << 20) + 9), (len(data) - 3, len(data))):
        want = sum((int(c) + 1) * pow(base, k, bits.P61) for k, c in enumerate(data[a:b])) % bits.P61
        assert int(own._hash(own.acc[a : a + 1], own.acc[b : b + 1], own.inverse[a : a + 1])[0]) == want
    x, y = (draw.integers(0, bits.P61, 1000).astype(np.uint64) for _ in range(2))
    assert bits.product(x, y).tolist() == [int(a) * int(b) % bits.P61 for a, b in zip(x, y)]
    assert np.array_equal(own.windows(40)[:100], own.spans(np.arange(100), np.arange(100) + 40))


def test_segments_differ():
    with open(pieces.MODEL, "rb") as f:
        own = pieces.Pieces(f.read())
    texts = [PLAIN, OTHER, PLAIN + " " + OTHER]
    ids, offsets = own.encode(pa.array(texts))
    back, at = own.decode(ids, offsets)
    assert [back[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == texts


def test_segments_of_one_hash_are_told_apart(monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        own = pieces.Pieces(f.read())
    want = [x.tolist() for x in own.encode(pa.array(["some words of it", "more"]))]
    monkeypatch.setattr(bits.Roll, "spans", lambda self, start, end: (end - start).astype(np.uint64))
    assert [x.tolist() for x in own.encode(pa.array(["some words of it", "more"]))] == want


def test_passages_differ(spark):
    texts = [PLAIN, OTHER, "x" + PLAIN[:900], "tail " + OTHER[300:1200], PLAIN]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for most in (20000, 1):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.removed(docs, length=400, most=most).collect())
        assert got == [(i, *w) for i, w in enumerate(cut_bytes(texts, 400))], most


def test_words_and_windows_differ(spark):
    plain, other = ["aa" if t else "b" for t in ORDER[:64]], ["b" if t else "aa" for t in ORDER[:64]]
    texts = [f"one two {PLAIN} three four five six seven eight nine ten eleven", f"one two {OTHER} three four five six seven eight nine ten eleven", " ".join(plain), " ".join(other), PLAIN + " " + PLAIN]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.removed(docs).collect())
    assert got == sorted(cut_words(rows))
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    count: dict = {}
    for t, (_, x) in zip(train, rows):
        for w in [*x.split(), None] if t else []:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in lm.scored(docs).collect():
        assert math.isclose(r.base_score, sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in [*texts[r.doc_id].split(), None]), rel_tol=1e-12)


def test_short_spans_hash_by_their_bytes_alone():
    draw = np.random.default_rng(5)
    words = [draw.integers(97, 100, n).astype(np.uint8).tobytes() for n in (*range(1, 80), 200, 1000) for _ in range(30)]
    words += [b"a\0", b"a", b"a\0\0", b"\0" * 8, b"\0" * 9, PLAIN.encode(), OTHER.encode()]
    place = draw.permutation(len(words))
    for order in (np.arange(len(words)), place):
        data = np.frombuffer(b"".join(words[k] for k in order), np.uint8)
        size = np.array([len(words[k]) for k in order])
        end = np.cumsum(size)
        got = bits.hashes(data, end - size, end)
        seen: dict = {}
        for k, h in zip(order, got.tolist()):
            assert seen.setdefault(words[k], h) == h
        assert len(set(seen.values())) == len(seen)
        first = seen if order is not place else first  # noqa: F821
        assert seen == first


def test_workers_give_back_the_powers_of_long_texts():
    data, start, end = np.arange(1 << 18, dtype=np.uint8), np.array([5, 70_000]), np.array([90_000, 200_000])
    before = bits.Roll(data).spans(start, end)
    assert sum(p.nbytes for p in bits._POWERS.values()) > 1 << 21
    bits.release()
    assert not bits._POWERS and (bits.Roll(data).spans(start, end) == before).all()


def test_workers_give_back_models_between_stages():
    with open(pieces.MODEL, "rb") as f:
        pieces.load(f.read()).encode(pa.array(["some words of a text"]))
    bits.release(models=False)
    assert pieces.load.cache_info().currsize == 1
    bits.release()
    assert pieces.load.cache_info().currsize == 0


def test_anchors_hold_less_than_their_text():
    column = pa.array([np.random.default_rng(8).integers(97, 123, 1 << 20, np.uint8).tobytes().decode()])
    suffixes.Anchors(column, 400)  # powers are shared by all
    tracemalloc.start()
    held = suffixes.Anchors(column, 400)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(held.pos) and size < 1 << 20

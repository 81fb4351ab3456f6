from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

from quillgrid.llm import simhash, substrings, suffixes
from quillgrid.llm.lm import EliasFano

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None) -> int:
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORD.findall(raw)
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> i & 1 for s in shingles) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def components(ids: list, fps: list[int]) -> list:
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [min((ids[k] for k in range(len(ids)) if root[k] == r and ids[k] is not None), default=None) for r in root]


def test_simhash_is_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], components([r.doc_id for r in rows], fps)))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_simhash_links_within_four_bits_meet():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = base.copy()
    for i in range(4):
        near ^= np.uint64(1) << draw.integers(0, 64, 200).astype(np.uint64)
    fp = np.concatenate((base, near))
    at, anchor = simhash.anchors(fp)
    order = np.lexsort((fp[at], anchor))
    i, j = simhash.links(anchor[order], fp[at][order], buffer=50)
    linked = {frozenset((a, b)) for a, b in zip(fp[at][order][i].tolist(), fp[at][order][j].tolist())}
    assert all(frozenset((a, b)) in linked for a, b in zip(base.tolist(), near.tolist()) if a != b)


def test_simhash_links_of_a_dense_anchor_are_all_pairs():
    draw = np.random.default_rng(4)
    fp = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (60, 5)).astype(np.uint64), axis=1) for b in draw.integers(0, 1 << 63, 12, dtype=np.uint64)]))
    anchor = np.repeat([1, 2], [len(fp), len(fp)])
    both = np.concatenate((fp, fp))
    want = simhash.links(anchor, both, dense=1 << 30)
    got = simhash.links(anchor, both, dense=10, buffer=100)
    assert len(want[0]) > 50 and all(np.array_equal(a, b) for a, b in zip(want, got))


def test_simhash_edges(no_docs, odd_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 7
    assert {r.component_id for r in rows if r.doc_id == 8} == {7}
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 7, 9]


def cut_bytes(texts: list[str | None], length: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_is_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    for length, most, pack in ((400, 20000, 6 << 20), (400, 20000, 3000), (60, 1, 3000), (61, 20000, 5000)):
        got = suffixes.removed(docs, length=length, most=most, pack_bytes=pack).collect()
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept or b"").hexdigest()) for r in got)
        assert got == sorted((r.doc_id, *w) for r, w in zip(rows, cut_bytes([r.text for r in rows], length))), (length, most, pack)


def test_suffix_dedup_edges(no_docs, odd_docs):
    assert suffixes.removed(no_docs).count() == 0
    got = suffixes.removed(odd_docs, carry=["doc_id", "fp", "kept"], as_text=True)
    assert len(got.columns) == 7
    rows = {(r[0], r[1]): r for r in got.collect()}
    assert rows[None, None][3] is None and rows[8, 4].n_removed == 600


def test_loser_tree_merges_with_prefixes():
    draw = np.random.default_rng(5)
    runs = [sorted(bytes(draw.integers(97, 99, draw.integers(1, 9))) for _ in range(draw.integers(0, 30))) for _ in range(7)]
    coded = [(r, [suffixes.common(a, b, 0) for a, b in zip([b"", *r], r)]) for r in runs]
    out = [(runs[k][i], h) for k, i, h in suffixes.merged(coded)]
    assert [s for s, _ in out] == sorted(s for r in runs for s in r)
    assert all(h == suffixes.common(a[0], s, 0) for a, (s, h) in zip([(b"", 0), *out], out))


def cut_words(rows: list) -> list[tuple]:
    own = [WORD.findall((t or "").encode()) for _, t in rows]
    first: dict = {}
    for (i, _), w in zip(rows, own):
        for p in range(len(w) - 12):
            if i is not None:
                k = tuple(w[p : p + 13])
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, own):
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_substring_dedup_is_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for pack in (6 << 20, 3000):
        got = substrings.removed(docs, pack_bytes=pack).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept or "") for r in got) == sorted(cut_words(rows)), pack


def test_substring_dedup_edges(no_docs, odd_docs):
    assert substrings.removed(no_docs).count() == 0
    rows = {(r[0], r[1]): r for r in substrings.removed(odd_docs, carry=["doc_id", "fp"]).collect()}
    assert rows[7, 2].n_removed == 0 and rows[8, 4].n_removed == 120 and rows[None, 1].n_removed == 0 and rows[None, None].kept is None


def test_elias_fano_round_trip():
    draw = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1 << 62), (7, 3), (50000, 1 << 50), (40000, 60)):
        values = np.sort(draw.integers(0, top, n, dtype=np.uint64))
        own = EliasFano.of(values)
        assert np.array_equal(own.values(), values)
        back, _ = EliasFano.read(own.tobytes(), 0)
        assert np.array_equal(back.values(), values)


def test_elias_fano_is_queried_as_it_lies():
    draw = np.random.default_rng(7)
    for n, top in ((1, 1), (5, 1 << 60), (3000, 1 << 40), (70_000, 1 << 33), (5000, 300)):
        values = np.sort(draw.integers(0, top, n, dtype=np.uint64))
        own, _ = EliasFano.read(b"x" + EliasFano.of(values).tobytes(), 1)
        i = draw.integers(0, n, 400)
        assert np.array_equal(own.get(i), values[i])
        asked = np.concatenate((draw.integers(0, top + top // 4 + 1, 300, dtype=np.uint64), values[i]))
        first = draw.integers(0, n + 1, len(asked))
        end = np.maximum(first, draw.integers(0, n + 1, len(asked)))
        want = [f + int(np.searchsorted(values[f:e], v)) for v, f, e in zip(asked, first.tolist(), end.tolist())]
        assert own.successor(asked, first, end).tolist() == want, (n, top)

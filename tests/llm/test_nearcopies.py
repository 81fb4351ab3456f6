from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from quillgrid.llm import bits, nearcopies, simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingled(text: str | None) -> frozenset:
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows: list) -> list[set]:
    """Positions of rows by component, by brute force."""
    sets, root = [shingled(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [{k for k, r in enumerate(root) if r == own} for own in sorted(set(root))]


def test_near_copies_are_brute_force(spark, docs, tmp_path):
    draw = random.Random(6)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in range(80):
        own = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(30, 150))]
        for c in range(4):
            rows.append((1000 + 10 * k + c, " ".join(own)))
            for _ in range(draw.randint(1, 2)):
                own[draw.randrange(len(own))] = f"new{draw.randrange(5000)}"
    want = groups(rows)
    assert len(want) < len(rows) - 100
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, frame, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(min(rows[k][0] for k in g) for g in want)


def test_near_copies_edges(spark, no_docs, odd_docs):
    assert nearcopies.representatives(no_docs).count() == 0
    kept = nearcopies.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, "null "), (7, "other"), (7, "same "), (9, "")]


def test_simhash_groups_are_candidates(spark, monkeypatch, tmp_path):
    """Where no two sets share a band, SimHash alone brings near copies together, chains too."""
    draw = random.Random(12)
    rows = []
    for k in range(6):
        own = [f"w{draw.randrange(5000)}" for _ in range(300)]
        rows.append((10 * k, " ".join(own)))
        while len(rows) % 3:
            changed = own.copy()
            changed[draw.randrange(300)] = f"new{draw.randrange(5000)}"
            a, b = simhash.fingerprint_array(pa.array([" ".join(own), " ".join(changed)])).tolist()
            if 0 < (a ^ b).bit_count() <= 4:
                own = changed
                rows.append((10 * k + len(rows) % 3, " ".join(own)))
    rows += [(100, ""), (101, None), (102, "a few words")]
    none = lambda h, count: bits.mix(nearcopies.set_hashes(h, count)[count > 0, None] + np.arange(nearcopies.BANDS, dtype=np.uint64))
    monkeypatch.setattr(nearcopies, "bands", none)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [0, 10, 20, 30, 40, 50, 100, 102]

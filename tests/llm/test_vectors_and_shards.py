from __future__ import annotations

import math
import random
import zlib

import numpy as np

from quillgrid.llm import sharding, topk


def test_top_k_is_brute_force(spark):
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(300, 8))
    vectors[50:60] = vectors[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1050, [1.0] * 7 + [float("nan")]), (1100, []), (None, [1.0] * 8), (1150, [float("inf")] * 8), (1200, [0.5, None] + [0.0] * 6), (1250, [1.0, 2.0]), (1251, [3.0, 1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    own = {i: [math.floor(256 * x) for x in v] for i, v in rows} | {1250: [256, 512], 1251: [768, 256]}
    for wave in (8192, 2):
        got = sorted(map(tuple, topk.top_k(frame, "vec_id % 50 = 0", wave=wave).collect()))
        want = []
        for q in (i for i in own if i % 50 == 0):
            best = sorted(((-sum(a * b for a, b in zip(own[q], x)), i) for i, x in own.items() if i != q and len(x) == len(own[q])))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert got == sorted(want), wave
    assert topk.top_k(frame.limit(0), "vec_id % 50 = 0").count() == 0


def test_top_k_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 2.0]), (50, [0.0, 0.0]), (3, None)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0", k=4).orderBy("query_id", "rank").collect()]
    # the least vector of id 0 asks, (0, 1); every other row is a candidate
    assert got == [(0, 1, 2, 512 * 256), (0, 2, 1, 128 * 256), (0, 3, 1, 128 * 256), (0, 4, 50, 0), (50, 1, 0, 0), (50, 2, 0, 0), (50, 3, 1, 0), (50, 4, 1, 0)]


def test_large_components_are_exact():
    x, q = np.array([[2.0**40, 3.0], [1.0, -(2.0**41)]]), np.array([2.0**20, 1.0])
    assert topk.dots(x, q).tolist() == [2**60 + 3, 2**20 - 2**41]


def check(rows, n_shards, out):
    assert len(out) == len(rows)
    slots: dict = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < n_shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out) == want


def test_shards_balance_and_keep_groups(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(draw.randint(1, 80)))) for i in range(3000)]
    rows += [(3000 + i, rows[i % 40][1]) for i in range(200)] + [(None, None), (5000, ""), (5000, "")]
    hot = [(10_000 + i, "the one text of a third of all rows") for i in range(1600)]
    for own in (rows, rows + hot):
        out = sharding.sharded(spark.createDataFrame(own, "doc_id long, text string").repartition(4)).collect()
        check(own, 16, out)
        size = np.zeros(16)
        for r in out:
            size[r.shard] += r.size
        assert size.max() / size.mean() < 1.03 and size.min() / size.mean() > 0.97, size
        groups: dict = {}
        for r in out:
            groups.setdefault(r.text_crc32, set()).add(r.shard)
        if own is rows:
            assert all(len(s) == 1 for s in groups.values())


def test_shards_of_little(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check([(1, "a")], 16, sharding.sharded(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect())


def test_groups_are_placed_by_the_dot_product():
    draw = np.random.default_rng(4)
    sizes = sharding.shares(draw.integers(1, 50, (200, 3)).astype(float))
    residual, want = [[1 / 16] * 3 for _ in range(16)], {}
    for i in sorted(range(200), key=lambda i: (-max(sizes[i]), i)):
        worth = [sum(r * x * w for r, x, w in zip(own, sizes[i], sharding.WEIGHT)) for own in residual]
        want[i] = worth.index(max(worth))
        residual[want[i]] = [r - x for r, x in zip(residual[want[i]], sizes[i])]
    assert sharding.placed(sizes, 16).tolist() == [want[i] for i in range(200)]


def test_shards_by_several_levels_of_batches(spark):
    draw = random.Random(12)
    rows = [(i, " ".join("x" * draw.randint(1, 9) + str(i) for _ in range(draw.randint(1, 60)))) for i in range(4000)]
    rows += [(9000 + i, rows[i][1]) for i in range(300)] + [(20_000 + i, "hot text") for i in range(2100)]
    rows += [(30_000 + i, "a group of a twentieth of all rows, whole") for i in range(320)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batch=1000).collect()
    check(rows, 16, out)
    sums, groups = np.zeros((16, 2)), {}
    for r in out:
        sums[r.shard] += (r.size, 1)
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert (abs(sums / sums.mean(0) - 1).max(0) < (0.04, 0.3)).all(), sums
    hot = zlib.crc32(b"hot text")
    assert len(groups.pop(hot)) > 8 and all(len(s) == 1 for s in groups.values())

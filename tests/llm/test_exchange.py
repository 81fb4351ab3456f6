from __future__ import annotations

import os
import random

import pytest
from quillgrid.llm import exchange


def test_components_with_hubs_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exchange, "HUB", 5)
    draw = random.Random(3)
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 2000) for k in range(80)] + [(draw.randrange(3000, 3400), draw.randrange(3000, 3400)) for _ in range(250)] + [(7, 1005)] + [(5000 + k, 5001 + k) for k in range(40)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not changed:
            break
    got = {r.node: r.root for r in exchange.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_checkpoints_go_when_nothing_reads_them(spark):
    df = exchange.checkpointed(spark.range(10).toDF("n"))
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(file) and df.count() == 10
    exchange.forget(df)
    assert not os.path.exists(file)


def test_packs_grow_with_the_root_of_the_input(spark, tmp_path):
    spark.range(1000).selectExpr("repeat('x', 100) AS text").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert exchange.pack_bytes(docs) == exchange.PACK_BYTES == exchange.pack_bytes(spark.createDataFrame([("a",)], "text string"))


def test_packs_beyond_many_bytes(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("uuid() AS text").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(exchange, "MANY_BYTES", 100.0)
    assert exchange.pack_bytes(docs) > 10 * exchange.PACK_BYTES


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Nothing:
        def __getattr__(self, name):
            return lambda *_: self

        def isEmpty(self):
            return True

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"_jsc": Nothing(), "master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        exchange.checkpointed(type("D", (), {"sparkSession": Session})())

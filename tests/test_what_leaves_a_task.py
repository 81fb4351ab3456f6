"""Searches send no more than hits from task to task: nothing for each word of a document, whatever its length."""

from __future__ import annotations

import random

import pytest
from test_against_sql import DOCUMENTS, differs, put

BENCHMARK = "item_id long, text string"
N, WORDS = 60, 400


def sent(spark, run) -> tuple[object, int]:
    """What run() returns, and the rows that the stages of its jobs wrote for others."""
    sc = spark.sparkContext._jsc.sc()
    first = sc.dagScheduler().nextStageId()
    out = run()
    sc.listenerBus().waitUntilEmpty(30_000)
    total = 0
    for k in range(first, sc.dagScheduler().nextStageId()):
        try:
            total += sc.statusStore().lastStageAttempt(k).shuffleWriteRecords()
        except Exception:  # a stage that was skipped
            pass
    return out, total


@pytest.fixture
def home(spark, tmp_path):
    """Documents of 400 different words each, of which many are words of some query too; nothing is stored of them yet."""
    out, draw = str(tmp_path), random.Random(5)
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(draw.sample(words, WORDS)) + ("\nheit onan que revenue" if i % 3 == 0 else "") for i in range(N)]
    put(spark, out, "documents", [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], DOCUMENTS)
    put(spark, out, "benchmark", [(i, " ".join(texts[i].split()[: 1 + 30 * i])) for i in range(8)], BENCHMARK)
    put(spark, out, "embeddings", [(i, [draw.gauss(0, 1) for _ in range(4)], 0) for i in range(N)], "vec_id long, embedding array<float>, label int")
    return out


@pytest.mark.parametrize("name", ["series_receipt", "search_exact", "search_legacy", "search_tiered", "have_verdicts", "inside_caption_label", "exact_grouped", "inside_caption_first", "series_by_family", "cards_bm25_fields", "find", "best_fusion", "rrf_fusion", "search_all", "search_any"])
def test_only_hits_leave(spark, home, name):
    """Before, each word of a document was a row that was sent at least once."""
    (got, want), rows = sent(spark, lambda: differs(spark, name, home, ("documents", "benchmark", "embeddings")))
    assert got == want and want
    assert rows < N * WORDS / 2

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillgrid.operators import vectors


def test_what_is_sent_for_all_neighbours():
    """Each table is sent once for each block of the other: 614,000 vectors were sent 600 times before."""
    n, m = vectors._grid(614_000, 614_000, 48, 65536)
    assert n * m >= 48 and max(614_000 / n, 614_000 / m) <= 65536 and n + m <= 24
    n, m = vectors._grid(200, 614_000, 48, 65536)
    assert n * m >= 48 and n + m <= 64


@pytest.mark.parametrize("kind", ["plain", "alike", "huge", "short"])
def test_best_of_is_exact(kind):
    """Ties, a vector that most rows share, values beyond single precision, fewer vectors than are asked for."""
    draw = np.random.default_rng(7)
    v = np.round(draw.normal(size=(1500, 6)), 1) if kind != "short" else draw.normal(size=(4, 6))
    if kind == "alike":
        v[draw.random(1500) < 0.6] = v[0]
    if kind == "huge":
        v[::50] *= 1e30
    ids = draw.permutation(len(v))
    i, found, score = vectors.best_of(v, ids, v, 9, rows=100, chunk=128)
    exact = np.round(np.einsum("ik,jk->ij", v, v), 9)
    for q in range(0, len(v), 37):
        want = sorted(range(len(v)), key=lambda j: (-exact[q, j], ids[j]))[:9]
        assert found[i == q].tolist() == ids[want].tolist()
        assert np.allclose(score[i == q], exact[q, want])


def test_hashed_terms_stay_in_their_task(spark):
    """No exchange for the terms of a text; a null text and an empty one have the zero vector."""
    own = vectors.embedded(spark.createDataFrame([(1, "tax tax budget"), (2, None), (3, "")], "id int, t string"), ["id"], F.col("t"))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.vector for r in own.collect()}
    assert sorted(abs(round(x * 5**0.5, 9)) for x in got[1] if x) == [1.0, 2.0] and got[2] == got[3] == [0.0] * 64

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillgrid.operators import search, vectors
from quillgrid.plans import ranking

SF = "/root/testdata/sf0.001"


def test_nearest_takes_a_query_table(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = vectors.nearest_each(frame, frame.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 5, block=64).collect()
    want = [(i, j, r + 1) for i, s in enumerate(v @ v.T) for r, j in enumerate(sorted(range(300), key=lambda j: (-round(s[j], 9), j))[:5])]
    assert sorted((r.qid, r.vec_id, r["rank"]) for r in got) == sorted(want)


def test_fusion_answers_every_query(spark):
    """Every benchmark query and every vector is answered; the lists and both fusions are those of plain loops."""
    queries = {r.qid for r in ranking.asked(spark, SF).collect()}
    own = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = [r.vec_id for r in own], np.array([r.embedding for r in own], float)
    score = v @ v.T
    near = {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(s[j], 9), ids[j]))[:50]] for i, s in zip(ids, score)}
    knn: dict = {}
    for r in ranking.vec_knn(spark, SF).collect():
        knn.setdefault(r.qid, {})[r["rank"]] = r.vec_id
    assert {q: [x[k] for k in sorted(x)] for q, x in knn.items()} == {q: n[:10] for q, n in near.items()}
    index = ranking.index(spark, SF, "documents")
    lex: dict = {}
    for r in search.top(search.scored(index, search.words_of(ranking.asked(spark, SF))), 50, ["doc_id"]).collect():
        lex.setdefault(r.qid, {})[r["rank"]] = r.doc_id
    rrf = {(r.qid, r.id): (r.rrf, r["rank"]) for r in ranking.rrf_fusion(spark, SF).collect()}
    best = {(r.qid, r.id): (r.best_rank, r.n_lists, r["rank"]) for r in ranking.best_fusion(spark, SF).collect()}
    assert len(queries) > 3 and {q for q, _ in rrf} == queries
    for q in queries:
        lists = [[lex.get(q, {})[k] for k in sorted(lex.get(q, {}))], near.get(q, [])]
        total, places = {}, {}
        for rows in lists:
            for k, i in enumerate(rows, 1):
                total[i] = total.get(i, 0) + 1 / (60 + k)
                places.setdefault(i, []).append(k)
        order = list(total)
        for k, i in enumerate(sorted(total, key=lambda i: (-round(total[i], 9), order.index(i))), 1):
            assert rrf[q, i] == (round(total[i], 6), k)
        for k, i in enumerate(sorted(total, key=lambda i: (min(places[i]), -len(places[i]), -round(total[i], 9), order.index(i))), 1):
            assert best[q, i] == (min(places[i]), len(places[i]), k)

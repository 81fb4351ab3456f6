from __future__ import annotations

import random

import corpus_pipeline
from quillgrid.llm import simhash


def test_stages_keep_columns_and_decide(spark, tmp_path):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijk") for _ in range(draw.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(30), text(90)
    rows = [(i, text(draw.randint(60, 150))) for i in range(120)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in text(80).split())) for i in range(30)]
    rows += [(300, rows[5][1]), (301, text(60) + " " + item + " " + text(60)), (302, text(50) + " " + passage), (303, passage + " " + text(50)), (304, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if 200 <= i < 230 else 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        own = stage(spark, own, str(tmp_path))
        own.write.parquet(f"{tmp_path}/{k}")
        own = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r for r in own.collect()}
        if k < 4:
            assert own.columns == docs.columns
    kept = set(seen["quality"])
    assert not kept & set(range(200, 230)) and set(range(120)) <= kept
    near = simhash.near_duplicates(spark.read.parquet(f"{tmp_path}/0")).where("doc_id = component_id").select("doc_id").distinct().collect()
    assert set(seen["near_dedup"]) == {r.doc_id for r in near} and 300 not in seen["near_dedup"]
    cut = seen["suffix_dedup"]
    assert set(cut) == set(seen["near_dedup"]) and passage not in cut[302].text + cut[303].text
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.values())
    assert set(cut) - set(seen["decontamination"]) == {301}
    assert set(seen["sentencepiece"]) == set(seen["decontamination"]) and all(r.round_trip for r in seen["sentencepiece"].values())


def written(spark, tmp_path, rows, schema, labels=(), items=()):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def staged(spark, tmp_path):
    own, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, own, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        own = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(own)
    return seen


def test_stages_of_an_empty_table(spark, tmp_path):
    written(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    assert [s.count() for s in staged(spark, tmp_path)] == [0] * 5


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    draw = random.Random(6)
    text = lambda n: " ".join("".join(draw.choice("abcdefghijk") for _ in range(draw.randint(2, 8))) for _ in range(n))
    passage, long = text(90), text(30_000)
    rows = [(None, text(70)), (None, None), (7, passage + text(40)), (7, text(50)), (8, None), (9, ""), (10, long), (11, text(30) + passage), (12, text(60))]
    schema = "doc_id long, text string, kept string, n_bytes long, n_removed string, n_spans long, score double, overlaps string, ids string, `quality score` string, c0 long"
    written(spark, tmp_path, [(i, t, "k", 5, "r", None, 0.25, "o", "i", "q", 3) for i, t in rows], schema, items=[(0, None), (1, "")])
    stages = staged(spark, tmp_path)
    for s in stages[:4]:
        assert s.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
        assert all(tuple(r)[2:] == ("k", 5, "r", None, 0.25, "o", "i", "q", 3) for r in s.collect())
    assert [s.count() for s in stages] == [9, 7, 7, 7, 7]  # the null and empty texts are one group
    final = {r.doc_id: r for r in stages[3].collect()}
    assert final[10].text == long and passage not in final[11].text and sorted(i for i in final if i) == [7, 8, 10, 11, 12]

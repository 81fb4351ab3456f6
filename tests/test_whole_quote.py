from __future__ import annotations

from quillgrid.plans import proof


def test_quote_on_page_wants_the_whole_passage(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    docs = [(0, f"before {passage} after"), (1, f"before {passage[:66]} and another end"), (2, "nothing")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in proof.quote_on_page(spark, str(tmp_path)).collect()] == [(5, 1)]

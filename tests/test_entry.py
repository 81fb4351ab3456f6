"""The driver contract."""

from __future__ import annotations

import __spark_entry__


def test_every_oracle_has_a_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["qid", "doc_id", "score", "rank"] and rows.count() > 0

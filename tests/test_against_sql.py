"""Queries against their own SQL, on small tables that the shipped ones do not resemble."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__


def differs(spark, name: str, home: str, tables: tuple[str, ...] = ("documents",)) -> tuple[list, list]:
    """Rows of the query and of its SQL, sorted."""
    own = __spark_entry__.queries()[name](spark, home)
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{home}/{t}.parquet/*.parquet'")
    found = db.execute(f"SELECT {', '.join(own.columns)} FROM ({__spark_entry__.oracle_sql()[name]}) t").fetchall()
    plain = lambda rows: sorted(map(repr, (tuple(int(x) if hasattr(x, "as_tuple") else round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)))
    return plain(tuple(r) for r in own.collect()), plain(found)


def put(spark, home: str, table: str, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{home}/{table}.parquet")


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["dupe_audit_totals", "dupe_audit_worst"])
def test_audit_of_copies_anywhere(spark, tmp_path, name):
    """Copies that lie beside their keeper, not under 'copies again', are audited by the same rule; a keeper's own path says nothing."""
    text = {i: f"text {i % 5}\nline" for i in range(240)}
    put(spark, str(tmp_path), "documents", [(i, t, "en", f"src{i % 2}", len(t)) for i, t in text.items()], DOCUMENTS)
    got, want = differs(spark, name, str(tmp_path))
    assert got == want and want

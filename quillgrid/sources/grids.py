"""Table grids from page text and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 120
ROWS = 60


def _cell(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, CELL)


def _numbered(rows: DataFrame, key: list[str], max_rows: int) -> DataFrame:
    """Rows with something in them, numbered within their grid; a grid shows at most max_rows."""
    own = rows.where(F.exists("cells", lambda c: c != ""))
    order = Window.partitionBy(*key, "grid").orderBy("line")
    return own.withColumn("row", F.row_number().over(order)).where(F.col("row") <= max_rows).select(*key, "grid", "row", "cells")


def delimited(pages: DataFrame, key: list[str], body: str = "body", mark: str = "|", max_rows: int = ROWS) -> DataFrame:
    """(key, grid, row, cells): lines with at least two marks; runs of such lines are one grid."""
    lines = pages.select(*key, F.posexplode(F.split(F.col(body), "\n")).alias("line", "text")).where(F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit(""))) >= 2)
    run = F.col("line") - F.row_number().over(Window.partitionBy(*key).orderBy("line"))
    lines = lines.withColumn("run", run).withColumn("grid", F.dense_rank().over(Window.partitionBy(*key).orderBy("run")))
    return _numbered(lines.withColumn("cells", F.transform(F.split("text", "\\" + mark), _cell)), key, max_rows)


def html(pages: DataFrame, key: list[str], column: str = "html", max_rows: int = ROWS) -> DataFrame:
    """(key, grid, row, cells) of the tables of HTML pages; nested tables are not told apart."""
    tables = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<table\b.*?</table\s*>"), F.lit(0))
    own = pages.select(*key, F.posexplode(tables).alias("grid", "t")).withColumn("grid", F.col("grid") + 1)
    rows = own.select(*key, "grid", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b.*?(?=<tr\b|</tr|</table)"), F.lit(0))).alias("line", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dhr]|\z)"), F.lit(1)), lambda c: _cell(F.regexp_replace(c, "<[^>]+>", " ")))
    return _numbered(rows.withColumn("cells", cells), key, max_rows)


def of_page(grids: DataFrame, pages: DataFrame, key: list[str], wanted: dict) -> DataFrame:
    """The grids of one page, or the reason for none: PAGE_OUT_OF_RANGE or NO_TABLE_ON_PAGE."""
    here = lambda d: d.where(" and ".join(f"`{k}` = {v!r}" for k, v in wanted.items()))
    found, page = here(grids).withColumn("error", F.lit(None).cast("string")), here(pages).select(*key).distinct()
    none = page.join(found.select(*key).distinct(), key, "left_anti").withColumn("error", F.lit("NO_TABLE_ON_PAGE"))
    out = found.unionByName(none, allowMissingColumns=True)
    if page.isEmpty():
        out = pages.sparkSession.createDataFrame([(*wanted.values(), "PAGE_OUT_OF_RANGE")], [*wanted, "error"]).select(*(F.col(c).cast(found.schema[c].dataType) if c in (*wanted, "error") else F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns))
    return out

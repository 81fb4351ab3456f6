"""Scalar functions against plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.sources import files


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("foo_bar 2012-13 Éducation ß", ["foo", "bar", "2012", "13", "education", "ß"]), ("", []), ("a--b", ["a", "b"])],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


def test_words(spark):
    assert one(spark, T.content_words(F.col("t")), t="Show the Revenue of 2012-13 and revenue x Éducation") == ["revenue", "2012-13", "ducation"]
    assert one(spark, T.content_words(F.col("t"), unicode=True), t="Éducation") == ["éducation"]
    assert one(spark, T.label_words(F.col("t")), t="gone much 2012-13 tax revenue years") == ["tax", "revenue"]
    assert one(spark, T.content_words(F.col("t").cast("string")), t=None) == []


def test_years(spark):
    assert one(spark, T.fiscal_years(F.col("t")), t="FY 2012-13, 2045-46 and 2013-99x 1999-00") == ["2012-13"]
    assert one(spark, T.bare_years(F.col("t")), t="1999 2012-13 12012") == ["1999", "2012"]


def test_titles(spark):
    page = "[1,2,3]\nab 1\n" + ",".join(["word"] * 30) + "\n  Annual Budget Statement 2012-13 \nrest"
    assert one(spark, T.title(F.col("p"), F.lit("a/x.txt")), p=page) == "Annual Budget Statement 2012-13"
    assert one(spark, T.title(F.col("p"), F.lit("a/my_file-name.txt")), p="no\n1 2") == "my file name"


@pytest.mark.parametrize(
    ("title", "want"),
    [("Annual Budget 2012-13 (1) draft", "annual budget {fy}"), ("New(1) Report v2", "1 report"), ("Renewed drafting", "renewed drafting"), ("use this one: X-Y", "x y")],
)
def test_family(spark, title, want):
    assert one(spark, T.family(F.col("t"), T.fiscal_years(F.col("t"))), t=title) == want


def test_captions(spark):
    body = "  Table 1.1: Receipts of all\nTable 2 nothing\nTABLE 3: no\nTable A.4 - Something long enough\n"
    assert one(spark, T.captions(F.col("t")), t=body) == ["Table 1.1: Receipts of all", "Table A.4 - Something long enough"]


PAGE = "Budget\n Table 4: Outlay\nProvince   2025-26  2026-27\nPunjab     18,420   21,375\nIt rose to 21,375 in all.\n"


@pytest.mark.parametrize(
    ("quote", "ok"),
    [("Punjab 18,420 21,375", True), ("PUNJAB   18,420", True), ("Sindh 9,999 8,888", False), ("Punjab ... in all.", True), ("Punjab ... absent words", False), ("21,375", True), ("42", True)],
)
def test_quotes(spark, quote, ok):
    assert one(spark, T.quote_on_page(F.col("q"), F.lit(PAGE)), q=quote) is ok


def test_numbers(spark):
    assert one(spark, T.numbers_in(F.col("t")), t="In FY 2026-27 and 2018/19, 2019: 1,234.50 and 7 and 610.456.") == ["1234.50", "610.456"]
    assert one(spark, T.quote_numbers(F.col("t")), t="2018-19 and 1,000 1000") == ["2018", "19", "1000"]
    note = F.lit("a line | dir/file.pdf | p417")
    assert one(spark, T.citation_path(note)) == "dir/file.pdf" and one(spark, T.citation_page(note)) == 417


def test_junk_and_budget(spark):
    for text, want in (("plain prose", False), ("", False), ("tabs\tand\nlines", False), ("x" * 20 + "\x03" * 3, False), ("ab" + "\x03" * 9, True), ("" * 20, True)):
        assert one(spark, T.is_junk(F.col("t")), t=text) is want, repr(text)
    assert one(spark, T.timeout_budget(F.lit(200.0))) == 180
    assert 180 < one(spark, T.timeout_budget(F.lit(100.0 * (1 << 20)))) < 1800
    assert one(spark, T.timeout_budget(F.lit(400.0 * (1 << 20)))) == 1800


def test_guards(spark):
    assert one(spark, T.page_refs(F.col("t")), t="see p. 12, p13 and page 14, not 2012-13, p2012-13 or map 5") == [12, 13, 14]
    assert one(spark, T.figures_without_citation(F.col("t")), t="It was about 610 million.") is True
    assert one(spark, T.figures_without_citation(F.col("t")), t="It was about 610 million, p. 3.") is False
    assert one(spark, T.prose_after_sources(F.col("t")), t="x\n## Sources\n- a | b | p1\n\nand more") is True
    assert one(spark, T.prose_after_sources(F.col("t")), t="x\n**Sources**:\nintro\n- a | b | p1\n") is False
    assert one(spark, T.has_header(F.col("t"), "(on)"), t="  `(on)` text") is True
    assert one(spark, T.machinery_words(F.col("t")), t="The index of prices; I searched the index. Slug!") == ["searched the index", "slug"]
    assert one(spark, T.same_path(F.lit("from some dir/x.pdf"), F.lit("root/dir/X.pdf"))) is True
    assert one(spark, T.same_path(F.lit("other/x.pdf"), F.lit("dir/x.pdf"))) is False
    assert one(spark, T.tail2(F.lit("x.pdf"))) == "x.pdf" and one(spark, T.tail2(F.lit("A\\b/C.pdf"))) == "b/c.pdf"


def test_best_line_and_snippet(spark):
    assert one(spark, T.best_line(F.col("t"), F.array(F.lit("tax"), F.lit("total"))), t="none\nthe tax\nTotal   tax\ntotal tax") == "Total tax"
    assert one(spark, T.why_lines(F.col("t"), F.array(F.lit("tax"), F.lit("total")), F.lit("T")), t="none\nthe tax\ntotal tax\ntotal") == ["total tax", "the tax"]
    assert one(spark, T.why_lines(F.col("t"), F.array(F.lit("zzz")), F.lit("T")), t="none") == ["T"]
    assert ">>tax<<" in one(spark, T.snippet(F.col("t"), F.array(F.lit("tax"))), t=" ".join(["w"] * 40) + " Tax tax".lower())


def test_listing_and_kinds(spark, tmp_path):
    for name, text in {"CLAUDE.md": "x", ".claude/settings.json": "{}", "sub/CLAUDE.md": "kept", "doc.pdf": "%PDF", "node_modules/a.js": "x", "a b/n.txt": "l1\nl2\n", "zero.txt": ""}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    seen = files.listing(spark, str(tmp_path))
    kept, excluded = files.walk(seen)
    assert sorted(r.rel for r in kept.select("rel").collect()) == ["a b/n.txt", "doc.pdf", "sub/CLAUDE.md", "zero.txt"]
    assert excluded.count() == 2  # the reader itself skips names with a leading dot
    status = {r.rel: (r.k, r.g) for r in kept.select("rel", files.kind(F.col("rel")).alias("k"), files.size_gate(F.col("size")).alias("g")).collect()}
    assert status["doc.pdf"] == ("pdf", None) and status["zero.txt"] == ("text", "zero_byte")
    import hashlib

    assert kept.where("rel = 'doc.pdf'").select(files.content_hash(F.col("content"), F.col("size")).alias("h")).first().h == hashlib.sha256(b"%PDF").hexdigest()


def test_office_and_extractor(spark):
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", "<w:p>Hello <w:b>big</w:b></w:p>")
        z.writestr("other.bin", "x")
    frame = spark.createDataFrame([("a.docx", bytearray(raw.getvalue())), ("b.docx", bytearray(b"no zip"))], "rel string, content binary")
    assert {tuple(r) for r in files.office_pages(frame).collect()} == {("a.docx", "indexed", "Hello big"), ("b.docx", "failed_corrupt", None)}
    texts = {r.rel: r.text for r in files.extracted(frame, lambda c: c.decode("ascii")).collect()}
    assert texts == {"a.docx": None, "b.docx": "no zip"}


def test_pages_and_to_do(spark):
    frame = spark.createDataFrame([("a", "1\n2\n3\n"), ("b", " \n"), ("c", "x")], "rel string, text string")
    assert {tuple(r) for r in files.text_pages(frame, ["rel"], chunk=2).collect()} == {("a", 1, "1\n2"), ("a", 2, "3"), ("c", 1, "x")}
    feed = spark.createDataFrame([("a", "one\f \fthree\f")], "rel string, text string")
    assert {tuple(r) for r in files.feed_pages(feed, ["rel"]).collect()} == {("a", 1, "one"), ("a", 3, "three")}
    indexed = spark.createDataFrame([("a", "indexed"), ("b", "zero_byte"), ("d", "image_only_no_text")], "rel string, status string")
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "rel string")
    assert sorted(r.rel for r in files.to_do(listed, indexed).collect()) == ["b", "c"]
    assert sorted(r.rel for r in files.to_do(listed, indexed, recognition=True).collect()) == ["b", "c", "d"]


def test_transcripts(spark, tmp_path):
    import json

    p = tmp_path / "t.jsonl"
    p.write_text(json.dumps({"type": "assistant", "uuid": "u", "message": {"role": "assistant", "content": [{"type": "tool_use", "input": {"command": 'x.py open "a b/c.pdf" 12'}}, {"type": "text", "text": "hi"}]}}) + "\n{broken\n")
    assert [tuple(r) for r in files.opened_in(files.transcripts(spark, str(p))).collect()] == [("a b/c.pdf", 12)]

"""Operators on small tables, and BM25 against a full-text engine of its own."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import coverage, evidence, ledger, retrieval, search, shelf, vectors
from quillgrid.sources import grids
from quillgrid.streaming import refresh

BODIES = ["budget of the year", "the budget budget statement", "revenue and tax revenue", "tax year 2012-13", "", "statement on tax budget"]


def test_bm25_is_fts5(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table p using fts5(body)")
    db.executemany("insert into p(rowid, body) values (?, ?)", list(enumerate(BODIES)))
    want = {r[0]: round(-r[1], 6) for r in db.execute("select rowid, bm25(p) from p where p match 'budget OR tax'")}
    docs = spark.createDataFrame(list(enumerate(BODIES)), "id int, body string")
    hits = search.bm25(docs, spark.createDataFrame([(0, "budget tax")], "qid int, query string"), ["id"], {"body": 1.0})
    assert {r.id: round(r.score, 6) for r in hits.collect()} == want


def test_tiers_and_phrases(spark):
    docs = spark.createDataFrame(list(enumerate(BODIES)), "id int, body string")
    queries = spark.createDataFrame([(0, "budget statement"), (1, "budget zebra"), (2, "2012-13"), (3, "zebra")], "qid int, query string")
    own = search.tiered(search.bm25(docs, queries, ["id"], {"body": 1.0}), queries)
    assert {(r.qid, r.id, r.tier) for r in own.collect()} == {(0, 1, "all"), (0, 5, "all"), (1, 0, "any"), (1, 1, "any"), (1, 5, "any"), (2, 3, "all")}
    assert {tuple(r) for r in search.phrase(docs, queries, ["id"], "body").collect()} == {(0, 1), (2, 3)}


DOCS = [
    ("a/one.txt", "f", "2012-13", 10, 100, "s1"), ("a/one copy.txt", "f", "2012-13", 10, 100, "s1"), ("a/two draft.txt", "f", "2012-13", 20, 90, "s2"), ("b/x.txt", "f", "2013-14", 5, 5, "s3"),
    ("c/n1.txt", "g", None, 1, 1, "s4"), ("c/n2.txt", "g", None, 1, 1, "s5"),
]
SCHEMA = "rel string, family string, fy string, n_pages int, size long, sha256 string"


def test_editions(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    kept = shelf.with_primary(shelf.survivors(docs))
    got = {r.rel: (r.is_primary, r.dupes) for r in kept.collect()}
    assert got == {"a/one.txt": (False, ["a/one copy.txt"]), "a/two draft.txt": (True, []), "b/x.txt": (True, []), "c/n1.txt": (True, []), "c/n2.txt": (True, [])}
    consensus = {r.rel for r in shelf.with_primary(shelf.survivors(docs), True).where("is_primary").collect()}
    assert "a/one.txt" in consensus and "a/two draft.txt" not in consensus
    assert {tuple(r) for r in shelf.families(kept).select("family", "n_editions", "n_members").collect()} == {("f", 2, 3), ("g", 0, 2)}
    near = {tuple(r) for r in shelf.nearest_years(kept, F.lit("2014-15")).collect()}
    assert near == {("f", "2014-15", "NO_EDITION_FOR", "2013-14", None)}


@pytest.mark.parametrize("split", [1, 2, 3, 5])
def test_update_is_rebuild(spark, split):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    old = spark.createDataFrame(DOCS[:split], SCHEMA)
    new = spark.createDataFrame(DOCS[split:], SCHEMA)
    columns = ["rel", "family", "fy", "is_primary", "dupes"]
    out = shelf.updated(shelf.with_primary(shelf.survivors(old)), docs, new)
    full = shelf.with_primary(shelf.survivors(docs))
    key = lambda r: r.rel
    assert sorted(out.select(columns).collect(), key=key) == sorted(full.select(columns).collect(), key=key)
    assert shelf.canonical_hash(out.select(columns)).collect() == shelf.canonical_hash(full.select(columns).repartition(3)).collect()


def test_rebuild_preferred():
    assert shelf.rebuild_preferred(8, 16) and not shelf.rebuild_preferred(7, 16)


def test_fragments(spark):
    counts = spark.createDataFrame([("annual budget statement {fy}", 5), ("see the annual budget statement {fy}", 2), ("page of annual budget statement {fy}", 9), ("x y z", 1)], "family string, n long")
    assert {tuple(r) for r in shelf.merge_targets(counts).collect()} == {("see the annual budget statement {fy}", "annual budget statement {fy}")}


@pytest.mark.parametrize(("keeper", "shadow", "risky"), [((120, 9), (150, 8), True), ((120, 4), (118, 9), False), ((400, 1), (12, 99), False), ((10, 5), (10, 6), True)])
def test_dupe_audit(spark, keeper, shadow, risky):
    kept = spark.createDataFrame([("k", "f", "y", ["s"], 1)], "rel string, family string, fy string, dupes array<string>, n_dupes int")
    files = spark.createDataFrame([("k", *keeper), ("s", *shadow)], "rel string, n_pages int, size long")
    assert shelf.dupe_audit(kept, files).first().risky is risky


def test_coverage(spark):
    files = spark.createDataFrame([("a", "indexed"), ("b", "failed_parser"), ("c", "zero_byte")], "rel string, status string")
    row = coverage.rollup(files, 5).first()
    assert (row.discovered, row.excluded, row.indexed, row.failed, row.other, row.holds) == (5, 2, 1, 1, 1, True)
    assert coverage.rollup(files, 2).first().holds is False
    assert {tuple(r) for r in coverage.deltas(files, spark.createDataFrame([("a",), ("z",)], "rel string")).collect()} == {("b", "disk"), ("c", "disk"), ("z", "index")}


def test_notes(spark):
    pages = spark.createDataFrame([("d/a.txt", 1, "Punjab 18,420 21,375 in all")], "rel string, page_index int, body string")
    files = pages.select("rel")
    opened = spark.createDataFrame([("s", "x/d/a.txt", 1), ("s", "d/a.txt", 7)], "slug string, rel string, page_index int")
    tail = " | d/a.txt | p1"
    notes = spark.createDataFrame(
        [(0, "s", "q" + tail, "Punjab 18,420", None), (1, "s", "no tail", "x", None), (2, "t", "q" + tail, "Punjab 18,420", None), (3, "s", "q" + tail, "zz", None), (4, "s", "q | d/a.txt | p7", "Punjab 18,420", None), (5, "s", "q" + tail, "invented 99", None), (6, "s", "q" + tail, "invented 99", "old"), (7, "s", "q | e/b.txt | p1", "Punjab 18,420", None)],
        "note_id int, slug string, text string, quote string, page_sha string",
    )
    got = {r.note_id: r.verdict for r in evidence.note_verdicts(notes, opened, files, pages).collect()}
    assert got == {0: "ok", 1: "NO_CITATION", 2: "PAGE_NOT_OPENED", 3: "NO_QUOTE", 4: "PAGE_NOT_IN_INDEX", 5: "QUOTE_NOT_ON_PAGE", 6: "QUOTE_NOT_ON_PAGE", 7: "PAGE_NOT_OPENED"}
    checks = {r.note_id: r.error for r in evidence.verified(notes, files, pages).collect()}
    assert checks == {0: "ok", 1: "NO_CITATION_TAIL", 2: "ok", 3: "ok", 4: "CITED_PAGE_NOT_IN_INDEX", 5: "QUOTE_NOT_ON_PAGE", 6: "PAGE_CHANGED_SINCE_NOTE", 7: "CITED_FILE_NOT_IN_INDEX"}


def test_figures(spark):
    answers = spark.createDataFrame([("s", "It was 610.456, then 444.999 and 21375 | a/b.txt | p12; 18 percent")], "slug string, text string")
    notes = spark.createDataFrame([("s", 1, "610.456 802.560"), ("s", 2, "21,375 in 2018-19"), ("t", 3, "444.999")], "slug string, note_id int, quote string")
    assert {r.figure: r.supported for r in evidence.figures(answers, notes).collect()} == {"610.456": True, "444.999": False, "21375": True, "18": False}
    checked = spark.createDataFrame([(1, "a", "1", False), (1, "a", "9", False), (1, "b", "2", False), (1, "b", "9", False), (1, "b", "1", True)], "session int, slug string, figure string, supported boolean")
    assert [tuple(r) for r in evidence.unsupported_everywhere(checked).collect()] == [(1, "9")]


@pytest.mark.parametrize(
    ("answer", "rel", "rule"),
    [("in Docs/Final/a.txt", "docs/final/a.txt", "full_path"), ("final\\a.txt", "docs/final/a.txt", "last_two_segments"), ("a.txt in the final folder", "docs/final/a.txt", "parent_and_child_adjacent"),
     ("a.txt " + "x" * 200 + " final", "docs/final/a.txt", "basename_only_or_absent"), ("LOCAL_ENVIRONMENT_SETUP.md", "local_environment_setup.md", "full_path"), ("", "a.txt", "empty"), ("nothing", "a.txt", "absent")],
)
def test_scoring(spark, answer, rel, rule):
    assert spark.range(1).select(evidence.answer_names(F.lit(answer), F.lit(rel)).alias("x")).first().x == rule


def test_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "vec_id int, embedding array<double>")
    assert [(r.vec_id, r["rank"]) for r in vectors.nearest(frame, [(0, [0.0, 1.0])], 2).orderBy("rank").collect()] == [(3, 1), (2, 2)]
    own = {r.t: r.vector for r in vectors.embedded(spark.createDataFrame([("tax budget",), ("",)], "t string"), ["t"], F.col("t")).collect()}
    assert abs(sum(x * x for x in own["tax budget"]) - 1) < 1e-9 and own[""] == [0.0] * 64


def test_refresh_is_rebuild(spark, tmp_path):
    arriving = str(tmp_path / "in")
    for k in range(0, len(DOCS), 2):
        spark.createDataFrame(DOCS[k : k + 2], SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
        refresh.refresh(spark, arriving, SCHEMA, str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination(120)
    columns = ["rel", "is_primary", "n_dupes"]
    got = spark.read.parquet(f"{tmp_path}/store/shelf/version=2").select(columns).collect()
    want = shelf.with_primary(shelf.survivors(spark.createDataFrame(DOCS, SCHEMA))).select(columns).collect()
    assert sorted(got) == sorted(want)


def test_grids(spark):
    pages = spark.createDataFrame([("a", 1, "x\n| h  1 | h2 |\n| | |\n| 3 | 4 |\ntext\n|5|6|"), ("b", 1, "none")], "rel string, page_index int, body string")
    own = grids.delimited(pages, ["rel", "page_index"])
    assert {(r.grid, r.row, tuple(r.cells)) for r in own.collect()} == {(1, 1, ("", "h 1", "h2", "")), (1, 2, ("", "3", "4", "")), (2, 1, ("", "5", "6", ""))}
    errors = lambda rel: {r.error for r in grids.of_page(own, pages, ["rel", "page_index"], {"rel": rel, "page_index": 1}).collect()}
    assert errors("a") == {None} and errors("b") == {"NO_TABLE_ON_PAGE"} and errors("z") == {"PAGE_OUT_OF_RANGE"}
    html = spark.createDataFrame([("a", "<table><tr><th>A<th>B</tr><tr><td>1</td><td><b>2</b></td></tr></table>")], "rel string, html string")
    assert [r.cells for r in grids.html(html, ["rel"]).orderBy("row").collect()] == [["A", "B"], ["1", "2"]]


def test_ledger(spark, tmp_path):
    path, out = str(tmp_path / "run.json"), str(tmp_path / "out")
    table = spark.createDataFrame([(1, "a")], "id int, t string")
    ledger.start(spark, path, "r1", {"docs": "x"}, [out])
    ledger.note(spark, path, "half way")
    with pytest.raises(ValueError):
        ledger.finish(spark, path, {})
    done = ledger.finish(spark, path, {out: table})
    assert ledger.load(spark, path) == done and done["notes"][0]["text"] == "half way"
    with pytest.raises(FileExistsError):
        ledger.start(spark, path, "r2", {}, [])
    table.write.parquet(out)
    with pytest.raises(FileExistsError):
        ledger.start(spark, str(tmp_path / "other.json"), "r3", {}, [out])
    assert ledger.start(spark, path, "r2", {}, [out], supersedes="r1")["supersedes"] == "r1"
    a, b = ledger.manifest({"t": table}), ledger.manifest({"t": table.withColumn("mtime", F.lit(1.0)), "u": table})
    assert ledger.differences(a, b) == ["u"]


def test_decisions(spark):
    rows = [(1, "a", 1, 0, False), (1, "b", 0, 2, False), (2, "c", 0, 1, False), (3, "d", 0, 0, False), (4, "e", 3, 3, True)]
    frame = spark.createDataFrame(rows, "session int, slug string, n_bad int, n_bad_answer int, marked boolean")
    assert {(r.session, r.reason, tuple(r.slugs or ())) for r in evidence.decisions(frame).collect()} == {(1, "notes", ("a",)), (2, "figures", ("c",)), (3, None, ()), (4, None, ())}


def test_catalog(spark, tmp_path):
    from quillgrid.sources import catalog

    registry = str(tmp_path / "registry.json")
    catalog.register(spark, registry, "C:\\Docs", "s1")
    catalog.register(spark, registry, "c:/docs/inner/", "s2")
    assert catalog.resolve(spark, registry, "C:/Docs/inner/x.txt")["store"] == "s2"
    assert catalog.resolve(spark, registry, "c:/docs/other")["store"] == "s1"
    with pytest.raises(LookupError):
        catalog.resolve(spark, registry, "d:/x")
    opened = spark.createDataFrame([("s", "a.txt", 1)], "slug string, rel string, page_index int")
    notes = spark.createDataFrame([("s", "n", "q", "h"), ("t", "m", "q", "h")], "slug string, text string, quote string, page_sha string")
    catalog.log_opened(opened, str(tmp_path / "o"))
    catalog.log_opened(opened, str(tmp_path / "o"))
    catalog.log_notes(notes, str(tmp_path / "n"))
    own = catalog.session(spark.read.parquet(str(tmp_path / "o")), spark.read.parquet(str(tmp_path / "n")), "s").collect()
    assert [(r.kind, r.what) for r in own] == [("opened", "a.txt p1"), ("opened", "a.txt p1"), ("note", "n")]


PHRASED = ["seats for 2012-13 in all", "13 seats in 2012", "2012 and 13", "budget 2012-13 and 2012-13 again", "snake_case words-of-three parts", "words of three", "three of words", "seats"]


@pytest.mark.parametrize("text", ["2012-13", "2012-13 seats", "snake_case budget", "words-of-three seats zebra-x", "seats budget parts"])
def test_hyphenated_words_are_phrases(spark, text):
    """Scores, matches of all words and of any, against a full-text engine; scattered tokens are no match."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table p using fts5(body)")
    db.executemany("insert into p(rowid, body) values (?, ?)", list(enumerate(PHRASED)))
    run = lambda op, words: {r[0]: round(-r[1], 6) for r in db.execute("select rowid, bm25(p) from p where p match ?", (op.join(f'"{w}"' for w in words),))}
    docs = spark.createDataFrame(list(enumerate(PHRASED)), "id int, body string")
    queries = spark.createDataFrame([(0, text)], "qid int, query string")
    index = search.Index.of(docs, ["id"], ["body"])
    assert {r.id: round(r.score, 6) for r in search.bm25(index, queries, ["id"], {"body": 1.0}).collect()} == run(" OR ", text.split())
    every = run(" AND ", text.split())
    own = search.paged(index, queries).collect()
    assert {r.id: round(r.score, 6) for r in own} == (every or run(" OR ", text.split())) and {r.tier for r in own} <= {"all" if every else "any"}
    exact = {r.id: round(r.score, 6) for r in search.paged(index, queries, "exact").collect()}
    assert exact == run(" OR ", [text])
    assert {r.id for r in search.phrase(index, queries, ["id"], "body").collect()} == set(exact)


def test_field_weights_and_filters_are_fts5(spark):
    rows = [("tax budget", "the budget year", "other"), ("year", "tax-year tables", "budget tax"), ("statement", "", "tax tax tax"), ("tax year", "x", "y")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table p using fts5(title, family, head)")
    db.executemany("insert into p(rowid, title, family, head) values (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    index = search.Index.of(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, title string, family string, head string"), ["id"], ["title", "family", "head"])
    for text in ("tax budget", "tax-year"):
        queries = spark.createDataFrame([(0, text)], "qid int, query string")
        words = " OR ".join(f'"{w}"' for w in text.split())
        for weights, match in (({"title": 3.0, "family": 2.0, "head": 1.0}, words), ({"title": 3.0, "family": 2.0}, "{title family} : (" + words + ")")):
            want = {r[0]: round(-r[1], 6) for r in db.execute("select rowid, bm25(p, 3.0, 2.0, 1.0) from p where p match ?", (match,))}
            assert {r.id: round(r.score, 6) for r in search.bm25(index, queries, ["id"], weights).collect()} == want, (text, weights)


def test_legacy_search_wants_stop_words_too(spark):
    docs = spark.createDataFrame([(0, "the budget of tax"), (1, "budget tax"), (2, "the the tax budget")], "id int, body string")
    got = search.paged(search.Index.of(docs, ["id"], ["body"]), spark.createDataFrame([(0, "the tax budget")], "qid int, query string"), "legacy")
    assert {(r.id, r.tier) for r in got.collect()} == {(0, "all"), (2, "all")}


def test_pages_of_hits_are_grouped(spark):
    hits = spark.createDataFrame([(0, r, p) for r in "ab" for p in range(1, 41)], "qid int, rel string, page_index int")
    got = {r.rel: (r.pages, r.total) for r in search.grouped_pages(hits).collect()}
    assert got == {"a": (list(range(1, 41)), 80), "b": (list(range(1, 11)), 80)}


def test_stored_tables_are_made_once_and_whole(spark, tmp_path):
    from quillgrid.sources import store

    spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, body string").write.parquet(f"{tmp_path}/in")
    made = []

    def build():
        made.append(1)
        index = search.Index.of(spark.read.parquet(f"{tmp_path}/in"), ["id"], ["body"])
        return {"postings": (index.postings, ["bucket"]), "sizes": (index.sizes, None)}

    for _ in range(2):
        got = store.stored(spark, "t", [f"{tmp_path}/in"], build)
        assert sorted((r.id, r.term, r.pos) for r in got["postings"].collect()) == [(1, "a", [0]), (1, "b", [1]), (2, "b", [0]), (2, "c", [1])]
    assert len(made) == 1
    spark.createDataFrame([(3, "d")], "id int, body string").write.mode("append").parquet(f"{tmp_path}/in")
    assert store.stored(spark, "t", [f"{tmp_path}/in"], build)["sizes"].count() == 3 and len(made) == 2
    with pytest.raises(store.CountMismatch):
        store.checked_write(spark.range(3).toDF("n"), f"{tmp_path}/out", expected=4)


PAGES = [
    ("d", 1, "Tax tables 2012-13\nTable 1: Revenue by province\nnothing"), ("d", 2, "revenue of the province\nprovince and revenue"), ("d", 3, "revenue"), ("d", 4, "Table 2: Expenditure of districts\n2013-14"),
    ("e", 1, "other words"), ("f", 1, "revenue province revenue province"), ("f", 2, "province revenue"),
]


def _pages(spark):
    pages = spark.createDataFrame(PAGES, "rel string, page_index int, body string")
    return search.Index.of(pages, ["rel", "page_index"], ["body"]), pages, shelf.harvested(pages)


def _fts(rel, match):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table p using fts5(page_index unindexed, body)")
    db.executemany("insert into p values (?, ?)", [(p, b) for r, p, b in PAGES if r == rel])
    return [(p, round(-s, 3)) for p, s in db.execute("select page_index, bm25(p) from p where p match ? order by round(bm25(p), 9), page_index", (match,))]


def test_inside_tries_a_phrase_then_any_word(spark):
    index, pages, captions = _pages(spark)
    got = retrieval.inside(index, pages, captions, [(0, "province revenue"), (1, "revenue province districts nothing tables"), (2, "the of")], channel=None).orderBy("qid", "rel", "rank").collect()
    own = {}
    for r in got:
        own.setdefault((r.qid, r.rel, r.tier), []).append((r.page_index, r.score))
    either = '"province" OR "revenue"'
    many = " OR ".join(f'"{w}"' for w in "revenue province districts nothing tables".split())
    assert own == {(0, "d", "any"): _fts("d", either), (0, "f", "phrase"): _fts("f", '"province revenue"'), (1, "d", "any"): _fts("d", many), (1, "f", "any"): _fts("f", many)}
    assert {r.line for r in got if r.qid == 0 and r.page_index == 2 and r.rel == "d"} == {"revenue of the province"}


def test_inside_by_captions(spark):
    index, pages, captions = _pages(spark)
    places = lambda channel, text, vectors_=None: {rel: [(r.page_index, r.via) for r in retrieval.inside(index, pages, captions, [(0, text)], 8, channel, vectors_).where(F.col("rel") == rel).orderBy("rank").collect()] for rel in "de"}
    assert places("first", "revenue province")["d"] == [(1, "caption"), (2, "body"), (3, "body")]
    assert places("first", "expenditure")["d"] == [(4, "caption")] and places("first", "nothing there")["e"] == []
    # the year is in no caption: label words find the page, and its body has the year
    assert places("first", "revenue province 2012-13")["d"][0][1] == "body" and places("first_label", "revenue province 2012-13 trajectory")["d"][0] == (1, "caption")
    assert (4, "caption") not in places("first_label", "districts 2012-13")["d"][1:] and places("first_label", "districts 2012-13")["d"][0] == (4, "caption")  # unless all would go
    assert places("rrf", "revenue province")["d"][0] == (1, "caption")
    key = ["rel", "page_index", "ord"]
    known = vectors.embedded(captions, key, F.col("caption")).join(captions, key)
    assert places("dense_first", "expenditure of districts 2013-14", known)["d"][0] == (4, "caption")
    with pytest.raises(ValueError):
        retrieval.inside(index, pages, captions, [(0, "x")], 8, "none")


def test_dense_captions_keep_the_half_and_three(spark):
    rows = [("a", 1, k, f"c{k}", [1.0 - k / 10, 0.0]) for k in range(9)] + [("b", 1, k, f"c{k}", [0.1 * k, 0.0]) for k in range(2)]
    own = vectors.above_median(spark.createDataFrame(rows, "rel string, page_index int, ord int, caption string, v array<double>").withColumn("score", F.get("v", F.lit(0))), ["rel"], "ord")
    assert sorted((r.rel, r.ord) for r in own.collect()) == [("a", k) for k in range(5)] + [("b", 0), ("b", 1)]


SHELF = [("a/1", "a {fy}", "2012-13", "A one", 5, True), ("a/2", "a {fy}", "2013-14", "A two", 6, True), ("a/3", "a {fy}", "2013-14", "A two", 4, False), ("b/1", "b", None, "B", 1, True), ("c/1", "c {fy}", "2012-13", "C", 2, True)]


def _shelf(spark):
    return spark.createDataFrame(SHELF, "rel string, family string, fy string, title string, n_pages int, is_primary boolean")


def test_find_fuses_questions_both_ways(spark):
    lists = spark.createDataFrame([(0, 0, "a/3", 1), (0, 0, "c/1", 2), (0, 1, "c/1", 1), (1, 0, "c/1", 1), (1, 0, "b/1", 2), (2, 0, "b/1", 1), (2, 0, "zz", 2)], "qid int, list_no int, rel string, rank int")
    catalogs = spark.createDataFrame([("a/3", "Table 1: tax of all\nother\nTable 2: tax"), ("c/1", "none")], "rel string, catalog string")
    queries, asks = [(0, "tax of all"), (1, "c tax"), (2, "b")], {0: 0, 1: 0, 2: 2}
    got = {(r.ask, r["rank"]): r for r in retrieval.find(lists, _shelf(spark), catalogs, queries, asks).collect()}
    assert [got[0, k].family for k in (1, 2, 3)] == ["c {fy}", "a {fy}", "b"] and got[2, 1].family == "b" and (2, 2) not in got
    a = got[0, 2]
    assert (a.best_rel, a.primary_rel, a.kind, a.n_editions, a.n_copies_hidden, a.why) == ("a/3", "a/2", "fy", 2, 1, ["Table 1: tax of all", "Table 2: tax"])
    assert [(e.fy, e.rel) for e in a.editions] == [("2012-13", "a/1"), ("2013-14", "a/2")] and got[0, 1].why == ["C"] and got[0, 3].kind == "singleton"
    best = {(r.ask, r["rank"]): r.family for r in retrieval.find(lists, _shelf(spark), catalogs, queries, asks, "best").collect()}
    assert best == {(0, 1): "c {fy}", (0, 2): "a {fy}", (0, 3): "b", (2, 1): "b"}
    lines = {r["rank"]: r.line for r in retrieval.compact(retrieval.find(lists, _shelf(spark), catalogs, queries, asks).where("ask = 0")).collect()}
    assert lines[2] == "a | 2 editions: 2012-13, 2013-14 | Table 1: tax of all / Table 2: tax"


def test_have_answers_with_the_nearest_years(spark):
    cards = _shelf(spark).select("rel", "title", "family", F.lit("x").alias("catalog"), F.lit("y").alias("head"))
    index = search.Index.of(cards, ["rel"], ["title", "family", "catalog", "head"])
    files = spark.createDataFrame([("z/a one.pdf", "failed_parser"), ("z/A-ONE.pdf", "image_only_no_text"), ("z/a one.txt", "indexed")], "rel string, status string")
    families, verdict = retrieval.have(index, _shelf(spark), files, [(0, "A two"), (1, "one"), (2, "zebra"), (3, "two")], {0: "2013-14", 1: "2010-11", 3: "2099-00"})
    assert {(r.qid, r.place, r.family, r.tier, tuple(r.fy_list)) for r in families.collect()} == {(0, 1, "a {fy}", "phrase", ("2012-13", "2013-14")), (1, 1, "a {fy}", "phrase", ("2012-13", "2013-14")), (3, 1, "a {fy}", "phrase", ("2012-13", "2013-14"))}
    got = {r.qid: r for r in verdict.collect()}
    assert (got[0].status, got[0].rel, got[0].n_pages) == ("EDITION_PRESENT", "a/2", 6)
    assert (got[1].status, got[1].nearest_before, got[1].nearest_after, got[1].unreadable) == ("NO_EDITION_FOR", None, "2012-13", 2)
    assert got[2].status == "NO_FAMILY_MATCHES" and (got[3].nearest_before, got[3].nearest_after) == ("2013-14", None)


def test_series_has_lines_and_a_receipt(spark):
    pages = spark.createDataFrame([("a/1", 1, "tax\n18 tax of province"), ("a/2", 1, "none"), ("c/1", 2, "tax of province 9")], "rel string, page_index int, body string")
    index = search.Index.of(pages, ["rel", "page_index"], ["body"])
    out, receipt = retrieval.series(index, pages, _shelf(spark), "tax of province", _shelf(spark).where("family <> 'b'"), "2012-13", "2013-14")
    assert {(r.family, r.fy, r.page_index, r.line, r.status) for r in out.collect()} == {("a {fy}", "2012-13", 1, "18 tax of province", "ok"), ("a {fy}", "2013-14", None, None, "NO_MATCH"), ("c {fy}", "2012-13", 2, "tax of province 9", "ok")}
    assert {tuple(r) for r in receipt.collect()} == {("a {fy}", 2, 1), ("c {fy}", 1, 1)}


def test_vectors_are_written_in_parts_and_resumed(spark, tmp_path):
    docs = spark.createDataFrame([(f"r{k}", f"word{k} of {k % 3}") for k in range(40)], "rel string, t string")
    path = str(tmp_path / "v")

    class Stop(Exception):
        pass

    def stop(part, seen=[]):  # noqa: B006
        seen.append(part)
        if len(seen) == 2:
            raise Stop

    with pytest.raises(Stop):
        vectors.written(docs, ["rel"], F.col("t"), path, parts=4, after=stop)
    done: list = []
    got = vectors.written(docs, ["rel"], F.col("t"), path, parts=4, after=done.append)
    assert len(done) == 2 and sorted(got.select("rel", "vector").collect()) == sorted(vectors.embedded(docs, ["rel"], F.col("t")).collect())
    more = docs.where("rel <> 'r1'").unionByName(spark.createDataFrame([("r1", "changed")], "rel string, t string"))
    done.clear()
    assert vectors.written(more, ["rel"], F.col("t"), path, parts=4, after=done.append).count() == 40 and len(done) == 1
    with pytest.raises(ValueError):
        vectors.written(docs.limit(0), ["rel"], F.col("t"), path)


def test_refresh_replaces_a_card_that_changes(spark, tmp_path):
    arriving, store = str(tmp_path / "in"), str(tmp_path / "store")
    run = lambda: refresh.refresh(spark, arriving, SCHEMA, store, str(tmp_path / "check")).awaitTermination(120)
    assert refresh.latest(spark, store) is None
    spark.createDataFrame(DOCS, SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
    run()
    changed = [("a/two draft.txt", "g", "2012-13", 20, 90, "s2"), ("b/x.txt", "f", "2012-13", 99, 5, "s1")]
    spark.createDataFrame(changed, SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
    run()
    now = [r for r in DOCS if r[0] not in {c[0] for c in changed}] + changed
    columns = ["rel", "family", "fy", "is_primary", "n_dupes"]
    got = spark.read.parquet(f"{store}/shelf/version={refresh.latest(spark, store)}").select(columns).collect()
    want = shelf.with_primary(shelf.survivors(spark.createDataFrame(now, SCHEMA))).select(columns).collect()
    key = lambda r: r.rel
    assert refresh.latest(spark, store) == 1 and sorted(got, key=key) == sorted(want, key=key)

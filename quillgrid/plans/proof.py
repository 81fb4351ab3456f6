"""Queries that check notes, answers and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence
from ..sources import derived
from . import sql
from .registry import query

# Notes on documents, one each, correct or wrong in a way that follows from doc_id; S is the string type.
_NOTES = """SELECT doc_id AS note_id, concat('s', CAST(doc_id % 3 AS {S})) AS slug, quote, CASE WHEN doc_id % 7 = 1 THEN quote WHEN doc_id % 7 = 2 THEN concat(quote, ' | nowhere/else/x', CAST(doc_id AS {S}), '.txt | p1') WHEN doc_id % 7 = 3 THEN concat(quote, ' | ', rel, ' | p9') ELSE concat(quote, ' | ', rel, ' | p1') END AS text,
CASE WHEN doc_id % 5 = 0 THEN 'feedfeedfeedfeed' ELSE {SHA} END AS page_sha FROM (SELECT *, CASE WHEN doc_id % 7 = 4 THEN concat('not there 991 ', left(body, 30)) WHEN doc_id % 7 = 5 THEN 'ab' ELSE concat(left(body, 30), '...', right(body, 12)) END AS quote FROM {PAGES}) z"""
_SQL = f"""{sql.CORPUS}, one AS (SELECT doc_id, rel, CAST(1 AS INTEGER) AS page_index, replace(text, '|', '/') AS body FROM corpus WHERE copy_no = 0), notes AS ({_NOTES.format(S="VARCHAR", SHA="left(sha256(body), 16)", PAGES="one")}),
seen AS (SELECT concat('s', CAST(doc_id % 3 AS VARCHAR)) AS slug, rel, CASE WHEN doc_id % 11 = 0 THEN 9 ELSE page_index END AS page FROM one WHERE doc_id % 13 <> 0 UNION ALL SELECT concat('s', CAST(doc_id % 3 AS VARCHAR)), rel, 9 FROM one WHERE doc_id % 14 = 3),
cited AS (SELECT *, nullif(regexp_extract(text, '\\|\\s*([^|]+?)\\s*\\|\\s*p(\\d+)\\s*$', 1), '') AS path, TRY_CAST(regexp_extract(text, '\\|\\s*([^|]+?)\\s*\\|\\s*p(\\d+)\\s*$', 2) AS INTEGER) AS page FROM notes),
tails AS (SELECT *, array_to_string(list_filter(string_split(lower(path), '/'), lambda x: x <> '')[-2:], '/') AS tail FROM cited),
files_by AS (SELECT array_to_string(string_split(lower(rel), '/')[-2:], '/') AS tail, min(rel) AS rel FROM one GROUP BY 1),
full_notes AS (SELECT n.*, f.rel, o.body, list_filter(list_transform(string_split(regexp_replace(quote, '\\.{{3,}}|…', chr(1), 'g'), chr(1)), lambda c: {sql.squeezed('c')}), lambda c: length(c) >= 6 OR (length(c) >= 3 AND regexp_matches(c, '\\d'))) AS chunks,
  EXISTS (SELECT 1 FROM seen s WHERE s.slug = n.slug AND s.page = n.page AND array_to_string(string_split(lower(s.rel), '/')[-2:], '/') = n.tail) AS was_seen FROM tails n LEFT JOIN files_by f USING (tail) LEFT JOIN one o ON o.rel = f.rel AND o.page_index = n.page),
judged AS (SELECT *, len(list_filter(chunks, lambda c: NOT contains({sql.squeezed('body')}, c))) = 0 AS on_page, page_sha <> left(sha256(body), 16) AS changed FROM full_notes)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.corpus(spark, sf_dir).where("copy_no = 0").select("doc_id", "rel", F.lit(1).alias("page_index"), F.replace("text", F.lit("|"), F.lit("/")).alias("body"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NOTES.format(S="STRING", SHA="left(sha2(body, 256), 16)", PAGES="{pages}"), pages=_pages(spark, sf_dir))


@query(f"WITH {_SQL} SELECT note_id, CASE WHEN path IS NULL OR page IS NULL THEN 'NO_CITATION' WHEN NOT was_seen THEN 'PAGE_NOT_OPENED' WHEN len(chunks) = 0 THEN 'NO_QUOTE' WHEN body IS NULL THEN 'PAGE_NOT_IN_INDEX' WHEN NOT on_page THEN 'QUOTE_NOT_ON_PAGE' ELSE 'ok' END AS verdict FROM judged")
def note_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    slug = F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("slug")
    opened = pages.where("doc_id % 13 <> 0").select(slug, "rel", F.when(F.col("doc_id") % 11 == 0, 9).otherwise(F.col("page_index")).alias("page_index"))
    opened = opened.unionAll(pages.where("doc_id % 14 = 3").select(slug, "rel", F.lit(9)))
    return evidence.note_verdicts(_notes(spark, sf_dir), opened, pages.select("rel"), pages.select("rel", "page_index", "body"))


_ERROR = "CASE WHEN path IS NULL THEN 'NO_CITATION_TAIL' WHEN rel IS NULL THEN 'CITED_FILE_NOT_IN_INDEX' WHEN body IS NULL THEN 'CITED_PAGE_NOT_IN_INDEX' WHEN NOT on_page AND changed THEN 'PAGE_CHANGED_SINCE_NOTE' WHEN NOT on_page THEN 'QUOTE_NOT_ON_PAGE' ELSE 'ok' END"


@query(f"WITH {_SQL} SELECT note_id, {_ERROR} AS error, coalesce(changed, false) AS page_changed FROM judged")
def verify_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return evidence.verified(_notes(spark, sf_dir), pages.select("rel"), pages.select("rel", "page_index", "body"))


@query(f"WITH {_SQL} SELECT count(*) AS n_notes, count(*) FILTER ({_ERROR} <> 'ok') AS n_bad FROM judged")
def verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.verify_totals(verify_notes(spark, sf_dir))


@query(f"WITH d AS (SELECT doc_id, {sql.squeezed('text')} AS t FROM documents), b AS (SELECT item_id, left({sql.squeezed('text')}, 60) AS q FROM benchmark) SELECT item_id, count(*) AS n_docs FROM b JOIN d ON contains(t, q) GROUP BY item_id")
def quote_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have each benchmark passage as a whole; candidates share its first three words."""
    from ..operators import search

    quotes = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), T.squeezed(F.col("text")).alias("quote"))
    words = quotes.select("qid", F.array_join(F.slice(T.tokens(F.col("quote")), 2, 3), " ").alias("query"))
    docs = derived.documents(spark, sf_dir)
    found = search.phrase(docs, words, ["doc_id"], "text").join(docs.select("doc_id", "text"), "doc_id").join(quotes, "qid")
    return found.where(F.contains(T.squeezed(F.col("text")), F.col("quote"))).groupBy(F.col("qid").alias("item_id")).agg(F.count("*").alias("n_docs"))


_ANSWERS = "SELECT conv_id AS session, concat('a', CAST(conv_id % 4 AS {S})) AS slug, concat(text, ' It was ', CAST(conv_id * 11 + 10 AS {S}), ' in 2018-19, and 4242 of 7,', CAST(100 + conv_id AS {S}), ' | x/y.txt | p', CAST(conv_id AS {S})) AS text FROM (SELECT conv_id, max_by(text, turn) AS text FROM {T} GROUP BY conv_id) z"
_QUOTES = "SELECT conv_id AS note_id, concat('a', CAST(conv_id % 4 AS {S})) AS slug, concat('row ', CAST(conv_id * 11 + 10 AS {S}), ' and 7', CAST(101 + conv_id AS {S})) AS quote FROM (SELECT DISTINCT conv_id FROM {T}) z WHERE conv_id % 3 <> 0"
_FIG = f"""answers AS ({_ANSWERS.format(S="VARCHAR", T="conversations").replace("max_by", "arg_max")}), quotes AS ({_QUOTES.format(S="VARCHAR", T="conversations")}),
prose AS (SELECT session, slug, regexp_replace(text, '(?i)\\|[^|\\n]*\\|\\s*p\\d+\\b|\\bp\\d+\\b', ' ', 'g') AS t FROM answers), stated AS (SELECT DISTINCT session, slug, unnest(list_filter(list_transform(regexp_extract_all(regexp_replace(t, '\\b(19|20)\\d\\d\\s*[-/]\\s*\\d\\d\\b', ' ', 'g'), '\\d[\\d,]*(?:\\.\\d+)?'), lambda n: regexp_replace(replace(n, ',', ''), '\\.+$', '')), lambda n: length(replace(n, '.', '')) >= 2 AND NOT regexp_matches(replace(n, '.', ''), '^(19|20)\\d\\d$'))) AS figure FROM prose),
quoted AS (SELECT DISTINCT slug, note_id, unnest(list_transform(regexp_extract_all(quote, '\\d[\\d,]*(?:\\.\\d+)?'), lambda n: replace(n, ',', ''))) AS figure FROM quotes)"""


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return spark.sql(_ANSWERS.format(S="STRING", T="{t}"), t=talks), spark.sql(_QUOTES.format(S="STRING", T="{t}"), t=talks)


@query(f"WITH {_FIG} SELECT slug, figure, count(note_id) > 0 AS supported, coalesce(array_to_string(list_sort(list(DISTINCT note_id) FILTER (note_id IS NOT NULL))[1:3], ','), '') AS in_notes FROM (SELECT DISTINCT slug, figure FROM stated) s LEFT JOIN quoted USING (slug, figure) GROUP BY ALL")
def figures_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, quotes = _answers(spark, sf_dir)
    return evidence.figures(answers, quotes).withColumn("in_notes", F.array_join(F.col("in_notes").cast("array<string>"), ","))


@query(f"WITH {_SQL}, {_FIG}, q AS (SELECT DISTINCT slug, figure FROM stated) SELECT (SELECT count(*) FROM judged) AS n_notes, (SELECT count(*) FROM judged WHERE {_ERROR} <> 'ok') AS n_bad, (SELECT count(*) FROM q WHERE NOT EXISTS (SELECT 1 FROM quoted n WHERE n.slug = q.slug AND n.figure = q.figure)) AS n_bad_answer")
def verify_answer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the notes' checks, with the figures of answers that no note supports."""
    return evidence.verify_totals(verify_notes(spark, sf_dir), evidence.figures(*_answers(spark, sf_dir)))


@query(f"WITH {_FIG}, f AS (SELECT DISTINCT session % 5 AS session, slug, s.figure, EXISTS (SELECT 1 FROM quoted q WHERE q.slug = s.slug AND q.figure = s.figure) AS supported FROM stated s), n AS (SELECT session, count(DISTINCT slug) AS n FROM f GROUP BY session) SELECT session, figure FROM f JOIN n USING (session) WHERE NOT supported GROUP BY session, figure, n HAVING count(DISTINCT slug) = n")
def merge_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that no slug of a session supports; a session is a fifth of the conversations here."""
    answers, quotes = _answers(spark, sf_dir)
    checked = evidence.figures(answers, quotes)
    stated = answers.select((F.col("session") % 5).alias("session"), "slug", F.explode(F.array_distinct(T.numbers_in(T.without_citations(F.col("text"))))).alias("figure")).distinct()
    return evidence.unsupported_everywhere(stated.join(checked, ["slug", "figure"]))


# Final answers with injected tails; the header, the citation, the machinery words and the prose follow from conv_id.
_FINAL = """SELECT conv_id AS session, concat(CASE WHEN conv_id % 8 = 7 THEN '' ELSE '`(assistant on)`\n' END, text, CASE conv_id % 8 WHEN 1 THEN concat('\nSources:\n- line | data/dir ', CAST(conv_id AS {S}), '/a.txt | p3 |') WHEN 2 THEN concat('\nSources:\n- line | data/dir ', CAST(conv_id AS {S}), '/a.txt | p4 |') WHEN 3 THEN ' as p.239 says, and page 3'
 WHEN 4 THEN '\nThe total was 610.5 about million rupees.' WHEN 5 THEN ' so I searched the index and the slug' WHEN 6 THEN '\n## Sources\n- line | data/x | p3\n\nBut note this.' ELSE ' see docs/none/b.pdf' END) AS text FROM (SELECT conv_id, {ARGMAX}(text, turn) AS text FROM {T} WHERE role = 'assistant' GROUP BY conv_id) z"""
_FINALS = "finals AS (" + _FINAL.format(S="VARCHAR", T="conversations", ARGMAX="arg_max").replace("\n", "' || chr(10) || '").replace("' || chr(10) || ' WHEN 4", " WHEN 4") + ")"


def _finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return spark.sql(_FINAL.replace("\n WHEN", " WHEN").replace("\n", "\\n").format(S="STRING", T="{t}", ARGMAX="max_by"), t=talks)


_PAGE_REFS = "list_concat(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9])p\\.?\\s?(\\d{1,4})(?:$|[^0-9-])', 1), regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9])page\\s+(\\d{1,4})(?:$|[^0-9-])', 1))"
_HAS_SOURCES = "(regexp_matches(text, '(?im)^\\s*#{0,6}\\s*\\**\\s*sources\\s*\\**\\s*:?\\s*$') OR regexp_matches(text, '(?i)(?:^|[^A-Za-z])sources\\s*:'))"


@query(f"WITH {_FINALS} SELECT session, array_to_string({_PAGE_REFS}, ',') AS refs, {_HAS_SOURCES} AS has_sources FROM finals")
def guard_page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _finals(spark, sf_dir).select("session", F.array_join(T.page_refs(text).cast("array<string>"), ",").alias("refs"), T.has_sources(text).alias("has_sources"))


@query(f"WITH {_FINALS} SELECT session, array_to_string(list_filter(list_transform(regexp_extract_all(text, '(?i)[A-Za-z0-9_\\-.()\\[\\]][A-Za-z0-9_\\-./\\\\()\\[\\] ]{{0,180}}?[/\\\\][A-Za-z0-9_\\-.()\\[\\] ]{{1,120}}?\\.(?:{T.PATH_EXTENSIONS})'), lambda p: {sql.strip('p')}), lambda p: length(p) > 6), '|') AS paths FROM finals")
def guard_cited_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finals(spark, sf_dir).select("session", F.array_join(T.cited_paths(F.col("text")), "|").alias("paths"))


_TOKS = "regexp_extract_all(text, '\\S+')"
_UNIT = "(?i)(?:^|[^A-Za-z])(billion|million|percent|%|rs|rupees|tonnes|thousand)(?:$|[^A-Za-z])"


@query(f"WITH {_FINALS}, t AS (SELECT session, len({_PAGE_REFS}) = 0 AND NOT {_HAS_SOURCES} AS bare, {_TOKS} AS toks FROM finals) SELECT session, bare AND len(list_filter(range(1, len(toks) + 1), lambda i: regexp_matches(toks[i], '(?:^|[^A-Za-z0-9.,])\\d[\\d,]*(?:\\.\\d+)?(?:$|[^A-Za-z])') AND len(list_filter(toks[greatest(i - 3, 1):i + 3], lambda w: regexp_matches(w, '{_UNIT}'))) > 0)) > 0 AS figures FROM t")
def guard_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finals(spark, sf_dir).select("session", T.figures_without_citation(F.col("text")).alias("figures"))


@query(f"WITH {_FINALS} SELECT session, CASE session % 8 WHEN 5 THEN 'searched the index,slug' ELSE '' END AS machinery, session % 8 = 6 AS prose, session % 8 <> 7 AS header FROM finals")
def guard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machinery words, prose after the sources, header; the oracle states what was injected."""
    text = F.col("text")
    return _finals(spark, sf_dir).select("session", F.array_join(T.machinery_words(text), ",").alias("machinery"), T.prose_after_sources(text).alias("prose"), T.has_header(text, "(assistant on)").alias("header"))


@query(f"WITH {_FINALS} SELECT session, CASE session % 8 WHEN 0 THEN 'cited_unopened' WHEN 1 THEN '' WHEN 2 THEN 'sources_line_not_opened' WHEN 3 THEN 'page_ref_not_opened' WHEN 4 THEN 'figures_no_citation' WHEN 5 THEN 'machinery_words' WHEN 6 THEN 'prose_after_sources' ELSE 'cited_unopened,missing_header' END AS rules FROM finals")
def guard_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that each final answer violates; the oracle states what was injected."""
    finals = _finals(spark, sf_dir)
    opened = finals.select("session", F.concat(F.lit("data/dir "), F.col("session").cast("string"), F.lit("/a.txt")).alias("rel"), F.lit(3).alias("page_index"))
    return evidence.citation_rules(finals, opened, "(assistant on)").withColumn("rules", F.array_join("rules", ","))


_SCORED = """SELECT doc_id, rel, CASE doc_id % 6 WHEN 0 THEN concat('It is in ', rel, '.') WHEN 1 THEN concat('see ', file, ' under the folder ', parent) WHEN 2 THEN concat(parent, repeat(' far', 60), ' ', file) WHEN 3 THEN concat('Look at ', upper(parent), '/', upper(file)) WHEN 4 THEN '' ELSE 'not_found here' END AS answer
FROM (SELECT doc_id, rel, {FILE} AS file, {PARENT} AS parent FROM {CORPUS}) z"""


@query("WITH " + sql.CORPUS + ", a AS (" + _SCORED.format(FILE="string_split(rel, '/')[-1]", PARENT="string_split(rel, '/')[-2]", CORPUS="corpus") + ") SELECT rel, CASE doc_id % 6 WHEN 0 THEN 'full_path' WHEN 1 THEN 'parent_and_child_adjacent' WHEN 2 THEN 'basename_only_or_absent' WHEN 3 THEN 'last_two_segments' WHEN 4 THEN 'empty' ELSE 'basename_only_or_absent' END AS rule, contains(lower(answer), 'not_found') AS said_not_found FROM a")
def score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule says that an answer names its file; the oracle states what was injected."""
    own = spark.sql(_SCORED.format(FILE="element_at(split(rel, '/'), -1)", PARENT="element_at(split(rel, '/'), -2)", CORPUS="{c}"), c=derived.corpus(spark, sf_dir))
    return own.select("rel", evidence.answer_names(F.col("answer"), F.col("rel")).alias("rule"), F.contains(T.norm_text(F.col("answer")), F.lit("not_found")).alias("said_not_found"))


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS final, max(turn) FILTER (role = 'user') AS last_user_turn, count(*) AS n FROM conversations GROUP BY conv_id")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.col("role") == "assistant"
    return talks.groupBy("conv_id").agg(F.max_by(F.when(said, F.col("text")), F.when(said, F.col("turn"))).alias("final"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_turn"), F.count("*").alias("n"))


@query("SELECT user_id AS slug FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) z WHERE last >= (SELECT max(ts) FROM events) - INTERVAL 180 MINUTE")
def recent_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note takers of the last three hours, on events."""
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("slug"), "ts")
    now = own.agg(F.max("ts")).first()[0]
    return evidence.recent_slugs(own, F.lit(now))

"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import derived
from . import sql
from .registry import query


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) a GROUP BY term")
def tokens_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.documents(spark, sf_dir).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return own.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query(f"SELECT item_id, array_to_string({sql.content_words('text')}, ' ') AS words, array_to_string(regexp_extract_all(text, '[A-Za-z0-9_\\-]+'), ' ') AS raw FROM benchmark")
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).select("item_id", F.array_join(T.content_words(F.col("text")), " ").alias("words"), F.array_join(T.raw_words(F.col("text")), " ").alias("raw"))


_LABEL = "concat('we have gone 2012-13 ', text, ' much 2019-20 decade')"
_WORDS = sql.content_words(f"regexp_replace({_LABEL}, '{sql.FY}', ' ', 'g')")


@query(f"SELECT item_id, array_to_string(list_filter({_WORDS}, lambda t: NOT list_contains({sql.FILLER}, t)), ' ') AS words FROM benchmark")
def label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).select("item_id", F.array_join(T.label_words(F.expr(_LABEL)), " ").alias("words"))


@query("SELECT o_orderkey, array_to_string(regexp_extract_all(t, '\\b(20[0-3]\\d-\\d\\d)\\b', 1), ',') AS fiscal, array_to_string(regexp_extract_all(t, '\\b(?:19|20)\\d\\d\\b'), ',') AS years FROM (SELECT o_orderkey, concat('FY ', CAST(year(o_orderdate) + 20 AS VARCHAR), '-', right(CAST(year(o_orderdate) + 21 AS VARCHAR), 2), ' since ', CAST(year(o_orderdate) AS VARCHAR), ' and 20', CAST(o_orderkey AS VARCHAR)) AS t FROM orders) a")
def year_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("concat('FY ', year(o_orderdate) + 20, '-', right(year(o_orderdate) + 21, 2), ' since ', year(o_orderdate), ' and 20', o_orderkey)")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.array_join(T.fiscal_years(t), ",").alias("fiscal"), F.array_join(T.bare_years(t), ",").alias("years"))


_GOOD = "len(regexp_extract_all(l, '[A-Za-z]{2,}')) >= 3 AND NOT regexp_matches(l, '^\\s*[\\[{]') AND len(regexp_extract_all(l, '[A-Za-z0-9_]+')) <= 25"
_LINES = f"list_transform(string_split(text, chr(10)), lambda l: {sql.strip('l')})"


@query(f"SELECT doc_id, left(coalesce(list_filter({_LINES}, lambda l: {_GOOD})[1], concat('doc ', CAST(doc_id AS VARCHAR))), 160) AS title, CASE WHEN len(list_filter({_LINES}, lambda l: {_GOOD})) > 0 THEN 'page0' ELSE 'filename' END AS source FROM documents")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.concat(F.lit("a/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return derived.documents(spark, sf_dir).select("doc_id", T.title(F.col("text"), rel).alias("title"), T.title_source(F.col("text")).alias("source"))


@query("WITH " + sql.CORPUS + f" SELECT rel, {sql.family('title_line', 'fy')} AS family FROM corpus")
def family_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.corpus(spark, sf_dir).select("rel", T.family(F.col("title_line"), T.fiscal_years(F.col("title_line"))).alias("family"))


_YEARED = "concat(title_line, ' of 2011 and ', CAST(1990 + doc_id % 30 AS VARCHAR))"


@query("WITH " + sql.CORPUS + f" SELECT rel, {sql.family(_YEARED, 'fy', True)} AS family FROM corpus")
def family_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(_YEARED.replace("VARCHAR", "STRING"))
    return derived.corpus(spark, sf_dir).select("rel", T.family(name, T.fiscal_years(F.col("title_line")), True).alias("family"))


@query(f"SELECT doc_id, {sql.squeezed('text')} AS squeezed, left(sha256(text), 16) AS page_sha FROM documents")
def squeezed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.documents(spark, sf_dir).select("doc_id", T.squeezed(F.col("text")).alias("squeezed"), T.page_sha(F.col("text")).alias("page_sha"))


_NUMS = "list_transform(regexp_extract_all(regexp_replace(t, '\\b(19|20)\\d\\d\\s*[-/]\\s*\\d\\d\\b', ' ', 'g'), '\\d[\\d,]*(?:\\.\\d+)?'), lambda n: regexp_replace(replace(n, ',', ''), '\\.+$', ''))"
_ANSWER = "concat(text, ' In 2018-19 it was ', CAST(doc_id * 1237 AS VARCHAR), ' and 1,234.50 of ', CAST(doc_id % 10 AS VARCHAR), ' in 2020')"


@query(f"SELECT doc_id, array_to_string(list_filter({_NUMS}, lambda n: length(replace(n, '.', '')) >= 2 AND NOT regexp_matches(replace(n, '.', ''), '^(19|20)\\d\\d$')), ' ') AS figures, array_to_string({sql.distinct("list_transform(regexp_extract_all(t, '\\d[\\d,]*(?:\\.\\d+)?'), lambda n: regexp_replace(replace(n, ',', ''), '\\.+$', ''))")}, ' ') AS quoted FROM (SELECT doc_id, {_ANSWER} AS t FROM documents) a")
def answer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.documents(spark, sf_dir).select("doc_id", F.expr(_ANSWER.replace("VARCHAR", "STRING")).alias("t"))
    return own.select("doc_id", F.array_join(T.numbers_in(F.col("t")), " ").alias("figures"), F.array_join(T.quote_numbers(F.col("t")), " ").alias("quoted"))


_CHUNKS = f"list_filter(list_transform(string_split(regexp_replace(q, '\\.{{3,}}|…', chr(1), 'g'), chr(1)), lambda c: {sql.squeezed('c')}), lambda c: length(c) >= 6 OR (length(c) >= 3 AND regexp_matches(c, '\\d')))"
_QUOTE = "concat(left(text, 40), ' ... ', CAST(item_id * 37 AS VARCHAR), '… ', right(text, 25))"


@query(f"SELECT item_id, array_to_string({_CHUNKS}, '|') AS chunks FROM (SELECT item_id, {_QUOTE} AS q FROM benchmark) a")
def quote_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).select("item_id", F.array_join(T.quote_chunks(F.expr(_QUOTE.replace("VARCHAR", "STRING"))), "|").alias("chunks"))


@query("WITH " + sql.CORPUS + """ SELECT rel, array_to_string(list_filter(string_split(lower(rel), '/'), lambda x: x <> '')[-2:], '/') AS tail, left(sha256(lower(rel)), 12) AS corpus_key,
regexp_replace(lower(concat('.//', rel)), '^(?:\\./|/)+', '') AS norm FROM corpus""")
def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.col("rel")
    return derived.corpus(spark, sf_dir).select("rel", T.tail2(rel).alias("tail"), T.corpus_key(rel).alias("corpus_key"), T.norm_path(F.concat(F.lit(".//"), rel)).alias("norm"))


_QUERY_WORDS = "['the', 'de', 'und', 'que']"


@query(f"""SELECT doc_id, left(trim(regexp_replace(line, '\\s+', ' ', 'g')), 200) AS line FROM (SELECT doc_id, l AS line, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_filter({_QUERY_WORDS}, lambda w: contains(lower(l), w))) DESC, i) AS k
FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) a) b) c WHERE k = 1""")
def best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.documents(spark, sf_dir).select("doc_id", T.best_line(F.col("text"), F.array(*map(F.lit, ("the", "de", "und", "que")))).alias("line"))


@query(f"""WITH l AS (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) a),
s AS (SELECT doc_id, i, {sql.strip('l')} AS l, len(list_intersect({sql.content_words('l')}, ['para', 'eau', 'heit', 'onan', 'the'])) AS n FROM l),
r AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS k FROM s WHERE n > 0)
SELECT doc_id, coalesce(string_agg(l, '|' ORDER BY k) FILTER (k <= 2), 'title') AS why FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id""")
def why_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("para", "eau", "heit", "onan", "the")))
    return derived.documents(spark, sf_dir).select("doc_id", F.array_join(T.why_lines(F.col("text"), words, F.lit("title")), "|").alias("why"))


@query()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.documents(spark, sf_dir).select("doc_id", T.snippet(F.col("text"), F.array(F.lit("heit"), F.lit("onan"), F.lit("eau"))).alias("snippet"))

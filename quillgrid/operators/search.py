"""Words, phrases and BM25 over documents. All queries of a batch run in one plan.

An index is its documents' tokens. A search reads the documents once and finds the words of all its queries where they lie (operators.scan): no
exchange is by word, as a common word is in most documents. A table of queries is met there too, and only the best of each task leave it; of a
few stated queries the places of their words are dealt by document.

Postings (bucket, key, term, pos, dl) can be stored from an index too: the positions of a term in a document, whose indexed fields have dl tokens; the
fields' positions lie GAP apart.

A query is a list of words, of which each is a phrase: a word with a hyphen or underscore gives several tokens that have to stand side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T
from . import scan
from .scan import GAP

K1, B = 1.2, 0.75
BUCKETS = 32
#: Queries that are sent to the documents together.
WAVE = 4096
#: Characters between words in the name of a phrase.
_JOIN = " "


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def _grouped(key: list[str]):
    """Rows (key, terms, parts) to rows (key, term, pos, dl); a batch is array work over all its tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(grouped, scan.slices(batches))

    def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = np.asarray(batch.column("terms").value_lengths())
        codes = batch.column("terms").flatten().dictionary_encode()
        code, row = codes.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        parts = np.asarray(batch.column("parts").flatten()).reshape(len(size), -1)
        before = np.cumsum(parts, axis=1) - parts
        for k in range(parts.shape[1] - 1, 0, -1):  # a field's positions begin at k * GAP
            here = (pos < GAP) & (pos >= before[row, k])
            pos[here] += k * GAP - before[row, k][here]
        order = np.lexsort((pos, code, row))
        code, row = code[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)), pa.int32()), pa.array(pos[order], pa.int32()))
        own = pa.array(row[head])
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in key), codes.dictionary.take(pa.array(code[head])), lists, pa.array(size[row[head]], pa.int32())], [*key, "term", "pos", "dl"])

    return run


@dataclass(frozen=True)
class Index:
    """Documents as tokens (key, terms, parts: how many of them each field has), with the key columns and the fields in the order of their positions."""

    docs: DataFrame
    key: list[str]
    fields: list[str]

    @classmethod
    def of(cls, docs: DataFrame, key: list[str], fields: list[str]) -> Index:
        """The index of docs, computed where it is used: tokens in the JVM, without an exchange."""
        tokens = [T.tokens(F.coalesce(F.col(c), F.lit(""))) for c in fields]
        return cls(docs.select(*key, F.concat(*tokens).alias("terms"), F.array(*map(F.size, tokens)).alias("parts")), key, fields)

    @property
    def sizes(self) -> DataFrame:
        """(key, dl)."""
        return self.docs.select(*self.key, F.size("terms").alias("dl"))

    @property
    def postings(self) -> DataFrame:
        """(bucket, key, term, pos, dl), grouped by term within each document's own task."""
        schema = StructType([*(self.docs.schema[k] for k in self.key), StructField("term", StringType()), StructField("pos", ArrayType(IntegerType())), StructField("dl", IntegerType())])
        return self.docs.mapInArrow(_grouped(self.key), schema).select(bucket(F.col("term")), *self.key, "term", "pos", "dl")

    def within(self, weights: dict[str, float] | None) -> tuple[Column, Column]:
        """Positions in the weighted fields, and the sum of their weights."""
        weights = weights or dict.fromkeys(self.fields, 1.0)
        of = F.array(*(F.lit(float(weights.get(c, 0.0))) for c in self.fields))
        field = lambda p: F.get(of, F.floor(p / GAP).cast("int"))
        if len(self.fields) == 1:
            return F.col("pos"), F.size("pos") * weights[self.fields[0]]
        return F.filter("pos", lambda p: field(p) > 0), F.aggregate("pos", F.lit(0.0), lambda s, p: s + field(p))


@dataclass(frozen=True)
class Words:
    """Words (qid, atom, tokens, phrase) of a stated list of queries, as literals of the plan and as rows."""

    frame: DataFrame
    rows: list[tuple]

    @property
    def phrases(self) -> dict[str, list[str]]:
        """The tokens of each distinct phrase."""
        return {r[3]: r[2] for r in self.rows}


def values(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A few rows as literals of the plan: the optimizer knows their size and folds what is computed of them."""
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items()))

    def literal(x) -> str:
        if isinstance(x, list):
            return f"array({', '.join(map(literal, x))})"
        return "NULL" if x is None else str(x) if not isinstance(x, str) else "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    own = ", ".join(f"({', '.join(map(literal, r))})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {own} AS t({', '.join(columns)})").select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))


def literal_words(spark: SparkSession, rows: list[tuple[int, list[list[str]]]]) -> Words:
    """The words (each its tokens) of each query."""
    own = [(qid, k, toks, _JOIN.join(toks)) for qid, words in rows for k, toks in enumerate(words) if toks]
    return Words(values(spark, own, {"qid": "int", "atom": "int", "tokens": "array<string>", "phrase": "string"}), own)


def stated(words: DataFrame | Words) -> Words:
    """A table of queries' words as a stated list."""
    return words if isinstance(words, Words) else Words(words, [tuple(r) for r in words.select("qid", "atom", "tokens", "phrase").collect()])


def words_of(queries: DataFrame, words: Column | None = None, query: str = "query") -> DataFrame:
    """(qid, atom, tokens, phrase): the words of each query, content words unless given, that have a token; one that repeats is several."""
    words = T.content_words(F.col(query)) if words is None else words
    own = queries.select("qid", F.posexplode(F.transform(words, T.tokens)).alias("atom", "tokens")).where("size(tokens) > 0")
    return own.withColumn("phrase", F.array_join("tokens", _JOIN))


def whole(queries: DataFrame, query: str = "query") -> DataFrame:
    """The whole text of each query as one phrase."""
    return words_of(queries, F.array(F.col(query)), query)


def occurrences(index: Index, words: DataFrame | Words) -> DataFrame:
    """(phrase, key, pos, dl): where each distinct phrase of words begins, in each document that has it; dealt by the first column of the key."""
    known = stated(words).phrases
    schema = StructType([StructField("phrase", StringType()), *(index.docs.schema[k] for k in index.key), StructField("pos", ArrayType(IntegerType())), StructField("dl", IntegerType())])
    return index.docs.mapInArrow(scan.found(scan.Phrases(list(known.values())), list(known), index.key), schema).repartition(index.key[0])  # the exchange is reused, so documents are read once


def _frame(words: DataFrame | Words) -> DataFrame:
    return F.broadcast(words.frame) if isinstance(words, Words) else words


def _numbered(words: list[tuple]) -> tuple[list, list[list[str]], list[list[int]]]:
    """Queries, phrases, and each query's phrases by number."""
    number: dict[str, int] = {}
    runs: dict = {}
    for qid, _, _, name in words:
        runs.setdefault(qid, []).append(number.setdefault(name, len(number)))
    tokens = {r[3]: r[2] for r in words}
    return list(runs), [tokens[p] for p in number], list(runs.values())


def _statistics(index: Index, phrases: scan.Phrases, weights: list[float]) -> Callable | None:
    """What a phrase adds to a document's score; its statistics are counted in the documents, a number for each phrase."""
    rows = index.docs.mapInArrow(scan.counted(phrases, weights), "phrase long, n long, tokens long").groupBy("phrase").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()
    df, docs, tokens = np.zeros(phrases.n), 0, 0
    for i, n, t in rows:
        if i < 0:
            docs, tokens = n, t
        else:
            df[i] = n
    idf = np.log((docs - df + 0.5) / (df + 0.5))
    idf, mean = np.where(idf <= 0, 1e-6, idf), tokens / docs if docs else 0.0
    return lambda phrase, f, dl: idf[phrase] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))


def met(index: Index, words: DataFrame | Words, weights: dict[str, float] | None = None, k: int | None = None, full_only: bool = False, score: bool = True) -> DataFrame:
    """(qid, full, key, score, order, n_terms, n): what each query finds, as scan.met() says; the queries go to the documents in waves, each a pass."""
    kind = _frame(words).schema["qid"].dataType
    by_query: dict = {}
    for r in stated(words).rows:
        by_query.setdefault(r[0], []).append(r)
    order = sorted(by_query)
    schema = StructType([StructField("q", IntegerType()), StructField("full", BooleanType()), *(StructField(c, index.docs.schema[c].dataType) for c in index.key), StructField("score", DoubleType()), StructField("order", DoubleType()), StructField("n_terms", LongType()), StructField("n", LongType())])
    weights = weights or dict.fromkeys(index.fields, 1.0)
    of = [float(weights.get(c, 0.0)) for c in index.fields]
    out = None
    for a in range(0, max(1, len(order)), WAVE):
        qids, tokens, runs = _numbered([r for q in order[a : a + WAVE] for r in by_query[q]])
        phrases = scan.Phrases(tokens)
        value = _statistics(index, phrases, of) if score and tokens else None
        rows = index.docs.mapInArrow(scan.met(phrases, scan.Asked(runs), index.key, of, value, k, full_only), schema)
        names = F.array(*map(F.lit, qids)) if qids else F.array()
        rows = rows.select(F.get(names, F.col("q")).cast(kind).alias("qid"), *schema.names[1:])
        out = rows if out is None else out.unionAll(rows)
    return out


def scored(index: Index, words: DataFrame | Words, weights: dict[str, float] | None = None, scope: list[str] | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(qid, key, score, n_terms): BM25 of each document that has a word of the query in a weighted field, and how many of the words it has.

    With a scope (part of the key) the statistics are those of each scope alone, as for search inside one document. hits are occurrences() of words
    that include these, if they are at hand.
    """
    if not isinstance(words, Words) and not scope:
        return met(index, words, weights).select("qid", *index.key, "score", "n_terms")
    scope = scope or []
    place, weight = index.within(weights)
    hits = occurrences(index, words) if hits is None else hits
    hits = hits.withColumn("pos", place).where("size(pos) > 0").withColumn("f", weight).drop("pos")
    stats = index.sizes.groupBy(*scope).agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    if scope:  # a scope's rows lie together
        hits = hits.withColumn("df", F.count("*").over(Window.partitionBy(*scope, "phrase"))).join(stats, scope)
    else:
        hits = hits.join(F.broadcast(hits.groupBy("phrase").agg(F.count("*").alias("df"))), "phrase").crossJoin(F.broadcast(stats))  # a row a phrase, and one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = hits.select("phrase", *index.key, part.alias("part"))
    return hits.join(_frame(words).select("qid", "atom", "phrase"), "phrase").groupBy("qid", *index.key).agg(F.sum("part").alias("score"), F.count("*").alias("n_terms"))


def best(index: Index, words: DataFrame | Words, k: int, mode: str = "any", weights: dict[str, float] | None = None) -> DataFrame:
    """(qid, key, score, n_terms, rank, tier, total): the k best of each query, ties by key, and how many it found. mode: any, all (of its words), tiered."""
    own = met(index, words, weights, k, mode == "all")
    group = Window.partitionBy("qid")  # at most 2 k rows a task and query
    own = own.withColumn("n_all", F.coalesce(F.sum(F.when(F.col("full"), F.col("n"))).over(group), F.lit(0))).withColumn("n_any", F.sum("n").over(group)).where("n is null")
    some = (F.col("n_all") > 0) if mode != "any" else F.lit(False)
    own = own.where(F.col("full") | ~some).withColumn("rank", F.row_number().over(group.orderBy(F.desc("order"), *index.key))).where(F.col("rank") <= k)
    return own.select("qid", *index.key, "score", "n_terms", "rank", F.when(some, "all").otherwise("any").alias("tier"), F.when(some, F.col("n_all")).otherwise(F.col("n_any")).alias("total"))


def bm25(docs: DataFrame | Index, queries: DataFrame, key: list[str], fields: dict[str, float], scope: list[str] | None = None) -> DataFrame:
    """(qid, key, score, n_terms) for the content words of each query, over an index or documents."""
    index = docs if isinstance(docs, Index) else Index.of(docs, key, list(fields))
    return scored(index, words_of(queries), fields, scope)


def full(scores: DataFrame, words: DataFrame | Words) -> DataFrame:
    """scores with full: whether a document has all words of its query."""
    size = F.broadcast(_frame(words).groupBy("qid").agg(F.count("*").alias("n_query")))  # a row a query
    return scores.join(size, "qid").withColumn("full", F.col("n_terms") == F.col("n_query")).drop("n_query")


def tiered(scores: DataFrame, queries: DataFrame | None, words: DataFrame | Words | None = None, least: int = 1, by: list[str] | None = None) -> DataFrame:
    """Of each query (and each value of by) the matches of all its words, or of any where fewer than `least` have all; tier says which."""
    own = full(scores, words_of(queries) if words is None else words)
    group = ["qid", *(by or [])]
    some = own.groupBy(*group).agg((F.count_if("full") >= least).alias("some"))
    return own.join(some if by else F.broadcast(some), group).where("full or not some").withColumn("tier", F.when(F.col("some"), "all").otherwise("any")).drop("full", "some")


def paged_words(queries: DataFrame, mode: str) -> tuple[DataFrame, str]:
    """The words of a page search and what is wanted of them. mode: tiered (all words, else any), exact (the text as a phrase), legacy (all raw words)."""
    if mode == "tiered":
        return words_of(queries), "tiered"
    return whole(queries) if mode == "exact" else words_of(queries, T.raw_words(F.col("query"))), "all"


def paged(index: Index, queries: DataFrame, mode: str = "tiered") -> DataFrame:
    """(qid, key, score, n_terms, tier): all matches of a page search."""
    words, wanted = paged_words(queries, mode)
    if wanted == "tiered":
        return tiered(scored(index, words), queries, words)
    return met(index, words, full_only=True).select("qid", *index.key, "score", "n_terms", F.lit("exact" if mode == "exact" else "all").alias("tier"))


def top(scores: DataFrame, k: int, key: list[str], score: str = "score", by: str = "qid") -> DataFrame:
    """The k best of each query with their rank; ties by key."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), *key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def phrase(docs: DataFrame | Index, queries: DataFrame | Words, key: list[str], body: str, query: str = "query") -> DataFrame:
    """(qid, key): documents with the query's tokens side by side; queries may be given as one word each."""
    words = queries if isinstance(queries, Words) else whole(queries, query)
    index = docs if isinstance(docs, Index) else Index.of(docs, key, [body])
    return met(index, words, {body: 1.0}, full_only=True, score=False).select("qid", *key)


def grouped_pages(hits: DataFrame, rel: str = "rel", page: str = "page_index", most: int = 50) -> DataFrame:
    """(qid, rel, pages, total): of each query's first hits, in the order of rel and page, the pages of each document; total counts all its hits."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(rel, page))
    total = hits.groupBy("qid").agg(F.count("*").alias("total"))
    shown = hits.select("qid", rel, page, place.alias("place")).where(F.col("place") <= most)  # at most `most` a query
    return shown.groupBy("qid", rel).agg(F.sort_array(F.collect_list(page)).alias("pages")).join(total, "qid")


def fused(ranks: DataFrame, key: str, k: int = 60) -> DataFrame:
    """(qid, key, rrf, best_rank, n_lists): reciprocal-rank sum and best rank over ranked lists (qid, list_no, key, rank)."""
    return ranks.groupBy("qid", key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"), F.count("*").alias("n_lists"), F.min(F.struct("list_no", "rank")).alias("first_seen"))


def by_family(scores: DataFrame, families: DataFrame, key: str = "rel", score: str = "score", tie: list[str] | None = None) -> DataFrame:
    """(qid, family, key, score): each family by its best document, the first seen of equals; unknown documents go."""
    order = Window.partitionBy("qid", "family").orderBy(F.desc(score), *(tie or [key]))
    return scores.join(families, key).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")

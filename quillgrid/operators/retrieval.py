"""The composite searches: inside a document, find, have, series, over an index, pages, captions and a shelf of cards.

Queries are a stated list [(qid, text)]; it is small and travels with the plan. Every search answers all queries for all documents in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import search, vectors
from .search import Index, Words

Queries = list[tuple[int, str]]
CHANNELS = (None, "first", "first_label", "dense_first", "rrf")
#: Up to so many content words a query inside a document is first tried as a phrase.
PHRASE_WORDS = 4


def table(spark: SparkSession, queries: Queries) -> DataFrame:
    return search.values(spark, list(queries), {"qid": "int", "query": "string"})


@dataclass(frozen=True)
class Facts:
    """What a query says: content words and label words, each with its tokens, the tokens of the whole, its first fiscal year."""

    qid: int
    words: list[str]
    word_tokens: list[list[str]]
    labels: list[str]
    label_tokens: list[list[str]]
    tokens: list[str]
    fy: str | None


def facts(spark: SparkSession, queries: Queries) -> list[Facts]:
    """Computed by the same expressions as the documents' side, of the literal queries alone."""
    words, labels = T.content_words(F.col("query")), T.label_words(F.col("query"))
    own = table(spark, queries).select("qid", words, F.transform(words, T.tokens), labels, F.transform(labels, T.tokens), T.tokens(F.col("query")), F.get(T.fiscal_years(F.col("query")), F.lit(0)))
    return [Facts(*r) for r in own.collect()]


def content(spark: SparkSession, known: list[Facts]) -> Words:
    return search.literal_words(spark, [(f.qid, f.word_tokens) for f in known])


def _each(known: list[Facts], field: str) -> Column:
    """(qid, words) of the queries that have such words, as rows beside every row."""
    own = [F.struct(F.lit(f.qid).alias("qid"), F.array(*map(F.lit, getattr(f, field))).alias("words")) for f in known if getattr(f, field)]
    return F.explode(F.array(*own) if own else F.array().cast("array<struct<qid: int, words: array<string>>>"))


def body_hits(index: Index, known: list[Facts], most: int) -> DataFrame:
    """(qid, rel, page_index, score, tier, b): of each document the best pages by statistics of its own.

    A query of few words is tried as a phrase, one of more as all its words; where that finds nothing in a document, any word does.
    """
    spark, scope = index.docs.sparkSession, index.key[:1]
    short = {f.qid for f in known if len(f.words) <= PHRASE_WORDS}
    strict = search.literal_words(spark, [(f.qid, [f.tokens] if f.qid in short else f.word_tokens) for f in known if f.words])
    kind = search.values(spark, [(f.qid, "phrase" if f.qid in short else "all") for f in known], {"qid": "int", "tier": "string"})
    every = content(spark, known)
    hits = search.occurrences(index, Words(strict.frame, [*strict.rows, *every.rows]))
    best = search.full(search.scored(index, strict, scope=scope, hits=hits), strict).where("full").drop("full").join(F.broadcast(kind), "qid")
    rest = search.scored(index, every, scope=scope, hits=hits).withColumn("tier", F.lit("any"))
    here = Window.partitionBy("qid", *scope)
    own = best.unionByName(rest).withColumn("strict", F.max(F.col("tier") != "any").over(here)).where((F.col("tier") != "any") | ~F.col("strict"))
    own = own.withColumn("b", F.row_number().over(here.orderBy(F.desc(F.round("score", 9)), "page_index"))).where(F.col("b") <= most)
    return own.select("qid", *index.key, "score", "tier", "b")


def caption_pages(captions: DataFrame, pages: DataFrame, known: list[Facts], channel: str, caption_vectors: DataFrame | None = None) -> DataFrame:
    """(qid, rel, page_index, caption): the pages whose caption answers the query.

    first and rrf: a caption with every content word; first_label: with every label word; dense_first: captions at or above the median score of
    their document, and its three best. For the last two, if the query names a fiscal year, pages without it in their body go, unless all would.
    """
    if channel == "dense_first":
        own = dense_captions(caption_vectors, known)
        shown = F.max_by("caption", F.struct(-F.round("score", 9), "ord"))
    else:
        own = captions.select("rel", "page_index", "ord", "caption", _each(known, "labels" if channel == "first_label" else "words").alias("q")).where(F.forall("q.words", lambda w: F.contains(F.lower("caption"), w)))
        own = own.select(F.col("q.qid").alias("qid"), "rel", "page_index", "ord", "caption")
        shown = F.min_by("caption", "ord")
    own = own.groupBy("qid", "rel", "page_index").agg(shown.alias("caption"))
    years = [(f.qid, f.fy) for f in known if f.fy]
    if channel in ("first", "rrf") or not years:
        return own
    asked = sorted({y for _, y in years})
    flags = F.array(*(F.contains("body", F.lit(y)) for y in asked)).alias("flags")  # a page goes to the join as these alone
    known_years = search.values(captions.sparkSession, [(i, asked.index(y)) for i, y in years], {"qid": "int", "y": "int"})
    own = own.join(F.broadcast(known_years), "qid", "left").join(pages.select("rel", "page_index", flags), ["rel", "page_index"], "left")
    own = own.withColumn("has", F.coalesce(F.get("flags", F.col("y")), F.col("y").isNull())).withColumn("some", F.max("has").over(Window.partitionBy("qid", "rel")))
    return own.where("has or not some").select("qid", "rel", "page_index", "caption")


def query_vectors(spark: SparkSession, texts: list[tuple[int, str]], embedder: vectors.Embedder | None = None) -> list[tuple[int, list[float]]]:
    """The vectors of a few stated texts; blank ones have none."""
    if not (own := [(i, t) for i, t in texts if t.strip()]):
        return []
    return [(r.qid, r.vector) for r in vectors.embedded(table(spark, own), ["qid"], F.col("query"), embedder).collect()]


def dense_captions(caption_vectors: DataFrame, known: list[Facts], always: int = 3) -> DataFrame:
    """(qid, rel, page_index, ord, caption, score): captions at or above the median of their document by cosine to the query's label words, and the best few."""
    asked = query_vectors(caption_vectors.sparkSession, [(f.qid, " ".join(f.labels)) for f in known])
    own = [F.struct(F.lit(i).alias("qid"), F.array(*map(F.lit, v)).alias("q")) for i, v in asked]
    each = F.explode(F.array(*own) if own else F.array().cast("array<struct<qid: int, q: array<double>>>"))
    scored = caption_vectors.select("rel", "page_index", "ord", "caption", "vector", each.alias("a")).select(F.col("a.qid").alias("qid"), "rel", "page_index", "ord", "caption", F.round(vectors.dot(F.col("vector"), F.col("a.q")), 9).alias("score"))
    return vectors.above_median(scored, ["qid", "rel"], "ord", always=always)


def inside(index: Index, pages: DataFrame, captions: DataFrame, queries: Queries, k: int = 8, channel: str | None = "dense_first", caption_vectors: DataFrame | None = None) -> DataFrame:
    """(qid, rel, page_index, rank, score, tier, via, line): the k best pages of each document.

    With a caption channel, of the max(5 k, 50) best pages by body those with a fitting caption come first, then pages with a fitting caption
    only, then the rest; rrf instead fuses the two lists.
    """
    if channel not in CHANNELS:
        raise ValueError(f"no such caption channel: {channel}")
    known = facts(pages.sparkSession, queries)
    words = search.values(pages.sparkSession, [(f.qid, f.words) for f in known if f.words], {"qid": "int", "words": "array<string>"})
    body = body_hits(index, known, k if channel is None else max(5 * k, 50))
    squeezed = F.substring(F.trim(F.regexp_replace("caption", r"\s+", " ")), 1, 200)
    place = Window.partitionBy("qid", "rel")
    if channel is None:
        own = body.withColumns({"rank": F.col("b"), "via": F.lit("body"), "caption": F.lit(None).cast("string")})
    else:
        found = caption_pages(captions, pages, known, channel, caption_vectors)
        own = body.join(found.withColumn("c", F.lit(True)), ["qid", "rel", "page_index"], "full_outer")
        own = own.withColumn("tier", F.coalesce(F.max("tier").over(place), F.lit("any")))  # one tier a query and document
        if channel == "rrf":
            ranked = found.withColumn("c_rank", F.row_number().over(place.orderBy("page_index"))).select("qid", "rel", "page_index", "c_rank")
            rrf = F.coalesce(1 / (60 + F.col("b")), F.lit(0.0)) + F.coalesce(1 / (60 + F.col("c_rank")), F.lit(0.0))
            own = own.join(ranked, ["qid", "rel", "page_index"], "left").withColumn("rank", F.row_number().over(place.orderBy(F.desc(F.round(rrf, 9)), "page_index")))
        else:
            group = F.when(F.col("c") & F.col("b").isNotNull(), 0).when(F.col("c"), 1).otherwise(2)
            own = own.withColumn("rank", F.row_number().over(place.orderBy(group, "b", "page_index")))
        own = own.withColumn("via", F.when(F.col("c"), "caption").otherwise("body"))
    shown = own.where(F.col("rank") <= k).join(F.broadcast(words), "qid").join(pages.select("rel", "page_index", "body"), ["rel", "page_index"], "left")
    line = F.when(F.col("b").isNotNull(), T.best_line(F.col("body"), F.col("words"))).otherwise(squeezed)
    return shown.select("qid", "rel", "page_index", "rank", F.round("score", 3).alias("score"), "tier", "via", line.alias("line"))


def caption_search(index: Index, queries: Queries, families: DataFrame, limit: int = 200, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Ranked captions (qid, rel, page_index, score, rank, tier) by label words, all where there are `least` such, else any; and the families
    (qid, family, place) in the order in which they are first seen."""
    spark = index.docs.sparkSession
    words = search.literal_words(spark, [(f.qid, f.label_tokens) for f in facts(spark, queries)])
    ranked = search.top(search.tiered(search.scored(index, words), None, words, least), limit, index.key).drop("n_terms")
    return ranked, first_seen(ranked, families)


def first_seen(ranked: DataFrame, families: DataFrame) -> DataFrame:
    """(qid, family, place): families of ranked documents in the order of their best rank."""
    seen = ranked.join(families.select("rel", "family"), "rel").groupBy("qid", "family").agg(F.min("rank").alias("first"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("first", "family"))).drop("first")


def rels_first_seen(ranked: DataFrame) -> DataFrame:
    """(qid, rel, rank): the documents of ranked captions, in the order in which they are first seen."""
    seen = ranked.groupBy("qid", "rel").agg(F.min("rank").alias("first"))
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).drop("first")


def editions(shelf: DataFrame) -> DataFrame:
    """(family, kind, n_editions, n_copies_hidden, editions): each family's primaries by year, or all of them if none has a year."""
    dated = F.col("is_primary") & F.col("fy").isNotNull()
    one = F.struct("fy", "rel", "n_pages")
    own = shelf.groupBy("family").agg(F.sort_array(F.collect_list(F.when(dated, one))).alias("dated"), F.sort_array(F.collect_list(F.when(F.col("is_primary"), one))).alias("single"), F.count_if(~F.col("is_primary")).alias("n_copies_hidden"))
    some = F.size("dated") > 0
    return own.select("family", F.when(some, "fy").otherwise("singleton").alias("kind"), F.when(some, F.size("dated")).otherwise(F.size("single")).alias("n_editions"), "n_copies_hidden", F.when(some, F.col("dated")).otherwise(F.col("single")).alias("editions"))


def primaries(shelf: DataFrame) -> DataFrame:
    """(family, fy, primary_rel): each edition's primary; without a year the greatest path, as all are primary there."""
    return shelf.where("is_primary").groupBy("family", "fy").agg(F.max("rel").alias("primary_rel"))


def find(lists: DataFrame, shelf: DataFrame, catalogs: DataFrame, queries: Queries, asks: dict[int, int] | None = None, fusion: str = "rrf") -> DataFrame:
    """(ask, family, rank, score, best_rel, primary_rel, kind, n_editions, n_copies_hidden, editions, why) for ranked lists (qid, list_no, rel, rank).

    asks says which queries are one question (each its own unless given). rrf sums reciprocal ranks over all lists of a question; best fuses each
    query by itself and takes a family's best place among them, then the number of queries that found it, then the sum.
    """
    if fusion not in ("rrf", "best"):
        raise ValueError(f"no such fusion: {fusion}")
    spark = shelf.sparkSession
    asks = asks or {i: i for i, _ in queries}
    of = F.broadcast(search.values(spark, list(asks.items()), {"qid": "int", "ask": "int"}))
    known = shelf.select("rel", "family")
    # lists of a question's queries keep their order: the first seen of equals wins
    own = lists.join(of, "qid").withColumn("list_no", F.col("qid") * 100 + F.col("list_no"))
    by = "ask" if fusion == "rrf" else "qid"
    doc = search.fused(own.select(F.col(by).alias("qid"), "list_no", "rel", "rank"), "rel").withColumn("s", F.round("rrf", 9))
    best = search.by_family(doc, known, score="s", tie=["first_seen", "rel"])
    order = Window.partitionBy("qid").orderBy(F.desc("s"), "first_seen", "rel")
    ranked = best.withColumn("place", F.row_number().over(order))
    if fusion == "rrf":
        ranked = ranked.select(F.col("qid").alias("ask"), "family", F.col("rel").alias("best_rel"), F.col("rrf").alias("score"), F.col("place").alias("rank"))
    else:
        groups = ranked.join(of, "qid").groupBy("ask", "family").agg(F.min_by("rel", F.struct("place", "qid")).alias("best_rel"), F.min("place").alias("best"), F.count("*").alias("n"), F.sum("rrf").alias("score"))
        order = Window.partitionBy("ask").orderBy("best", F.desc("n"), F.desc(F.round("score", 9)), "family")
        ranked = groups.select("ask", "family", "best_rel", "score", F.row_number().over(order).alias("rank"))
    said: dict[int, list[str]] = {}
    for f in facts(spark, queries):
        said.setdefault(asks[f.qid], []).extend(w for w in f.words if w not in said.get(asks[f.qid], []))
    words = search.values(spark, [(a, w) for a, w in said.items() if w], {"ask": "int", "words": "array<string>"})
    row = shelf.select(F.col("rel").alias("best_rel"), "fy", "title", "is_primary").join(catalogs.withColumnRenamed("rel", "best_rel"), "best_rel", "left")
    out = ranked.join(row, "best_rel").join(primaries(shelf).select(F.col("family").alias("f"), F.col("fy").alias("y"), "primary_rel"), (F.col("family") == F.col("f")) & F.col("fy").eqNullSafe(F.col("y")), "left").drop("f", "y")
    out = out.join(editions(shelf), "family").join(F.broadcast(words), "ask", "left")
    primary = F.when(F.col("is_primary"), F.col("best_rel")).otherwise(F.coalesce("primary_rel", "best_rel"))
    return out.select("ask", "family", "rank", "score", "best_rel", primary.alias("primary_rel"), "kind", "n_editions", "n_copies_hidden", "editions", T.why_lines(F.col("catalog"), F.coalesce("words", F.array().cast("array<string>")), F.col("title")).alias("why"))


def compact(found: DataFrame) -> DataFrame:
    """(ask, rank, line): one line for each family found."""
    years = F.array_join(F.transform("editions", lambda e: F.coalesce(e["fy"], e["rel"])), ", ")
    return found.select("ask", "rank", F.concat_ws(" | ", T.family_words(F.col("family")), F.concat(F.col("n_editions").cast("string"), F.lit(" editions: "), years), F.array_join("why", " / ")).alias("line"))


def have(index: Index, shelf: DataFrame, files: DataFrame, queries: Queries, years: dict[int, str] | None = None, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Families (qid, place, family, tier, fy_list) for words, and a verdict (qid, status, unreadable, family, fy, rel, n_pages, nearest_before, nearest_after).

    index is over title and family among other fields. Tiers: the words as a phrase in the title, in the order of paths; else all of them in title and
    family; else any. The verdict is on the first family and the year asked for, if one is; unreadable counts unread files whose name has all words.
    """
    spark = shelf.sparkSession
    known = facts(spark, queries)
    weights, words = {"title": 3.0, "family": 2.0}, content(spark, known)
    texts = search.literal_words(spark, [(f.qid, [f.tokens]) for f in known])
    hits = search.occurrences(index, Words(texts.frame, [*texts.rows, *words.rows]))
    titled = hits.withColumn("pos", index.within({"title": 1.0})[0]).where("size(pos) > 0").join(F.broadcast(texts.frame.select("qid", "phrase")), "phrase")
    phrase = search.top(titled.select("qid", "rel", F.lit(0.0).alias("score")), 200, ["rel"]).select("qid", "rel", "rank", F.lit("phrase").alias("tier"))
    rest = search.top(search.tiered(search.scored(index, words, weights, hits=hits), None, words), 200, ["rel"]).select("qid", "rel", "rank", "tier").join(phrase.select("qid").distinct(), "qid", "left_anti")
    ranked = phrase.unionAll(rest)
    held = shelf.groupBy("family").agg(F.sort_array(F.collect_set(F.when(F.col("is_primary"), F.col("fy")))).alias("fy_list"))
    families = first_seen(ranked, shelf).where(F.col("place") <= most).join(ranked.groupBy("qid").agg(F.first("tier").alias("tier")), "qid").join(held, "family").select("qid", "place", "family", "tier", "fy_list")
    name = F.lower(F.element_at(F.split("rel", "/"), -1))
    bad = files.where((F.col("status") == "image_only_no_text") | F.startswith("status", F.lit("failed_"))).select(name.alias("name"), _each(known, "words").alias("q"))
    unread = bad.where(F.forall("q.words", lambda w: F.contains("name", w))).groupBy(F.col("q.qid").alias("qid")).agg(F.count("*").alias("unreadable"))
    want = F.broadcast(search.values(spark, [(i, (years or {}).get(i)) for i, _ in queries], {"qid": "int", "fy": "string"}))
    first = want.join(families.where("place = 1"), "qid", "left").join(unread, "qid", "left")
    primary = shelf.where("is_primary and fy is not null").groupBy("family", "fy").agg(F.min(F.struct("rel", "n_pages")).alias("p"))
    near = lambda side: F.filter("fy_list", (lambda y: y < F.col("fy")) if side < 0 else (lambda y: y > F.col("fy")))
    there = F.array_contains("fy_list", F.col("fy"))
    status = F.when(F.col("family").isNull(), "NO_FAMILY_MATCHES").when(F.col("fy").isNull(), "FAMILIES").when(there, "EDITION_PRESENT").otherwise("NO_EDITION_FOR")
    out = first.join(primary, ["family", "fy"], "left").withColumn("status", status)
    gap = F.col("status") == "NO_EDITION_FOR"
    verdict = out.select("qid", "status", F.coalesce("unreadable", F.lit(0)).cast("long").alias("unreadable"), "family", "fy", F.col("p.rel").alias("rel"), F.col("p.n_pages").alias("n_pages"), F.when(gap, F.array_max(near(-1))).alias("nearest_before"), F.when(gap, F.array_min(near(1))).alias("nearest_after"))
    return families, verdict


def series(index: Index, pages: DataFrame, shelf: DataFrame, row_words: str, families: DataFrame, fy_from: str | None = None, fy_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Of each family (family) its dated primaries in a span of years, each with the best page and line for a row's words, or NO_MATCH; and a
    receipt (family, editions, matched). The families are given exactly; have() finds them from words."""
    members = shelf.where("is_primary and fy is not null").join(families.select("family").distinct(), "family", "left_semi")
    for bound, keep in ((fy_from, F.col("fy") >= F.lit(fy_from)), (fy_to, F.col("fy") <= F.lit(fy_to))):
        members = members.where(keep) if bound else members
    members = members.select("family", "fy", "rel")
    hits = inside(index, pages, pages, [(0, row_words)], 1, None).select("rel", "page_index", "line")
    out = members.join(hits, "rel", "left").select("family", "fy", "rel", "page_index", "line", F.when(F.col("page_index").isNull(), "NO_MATCH").otherwise("ok").alias("status"))
    return out, out.groupBy("family").agg(F.count("*").alias("editions"), F.count("page_index").alias("matched"))

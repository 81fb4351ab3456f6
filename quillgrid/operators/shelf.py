"""Cards, editions and families of publications, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def cards(pages: DataFrame, files: DataFrame, bare_years: bool = False) -> DataFrame:
    """One card a document from the first page and the captions of all: title, years, family."""
    first = pages.where("page_index = 1").select("rel", F.col("body").alias("first"))
    own = files.where("status = 'indexed'").join(first, "rel", "left")
    name, source = T.title(F.col("first"), F.col("rel")), T.title_source(F.coalesce("first", F.lit("")))
    years = F.array_distinct(F.concat(T.fiscal_years(F.col("title")), T.fiscal_years(T.stem(F.col("rel")))))
    own = own.withColumn("title", name).withColumn("title_source", source).withColumn("fy_all", years).withColumn("fy", F.get("fy_all", F.lit(0)))
    fam = T.family(F.col("title"), F.col("fy_all"), bare_years)
    fam = F.when(F.length(fam) < 4, T.family(T.file_title(F.col("rel")), F.col("fy_all"), bare_years)).otherwise(fam)
    return own.withColumn("family", fam).select("rel", "title", "title_source", "family", "fy", "fy_all", "n_pages", "size", "sha256", F.substring(F.coalesce("first", F.lit("")), 1, 1500).alias("head"))


def harvested(pages: DataFrame, most: int = 400) -> DataFrame:
    """(rel, page_index, ord, caption): the first captions of each document, each once."""
    all_ = pages.select("rel", "page_index", F.posexplode(T.captions(F.col("body"))).alias("pos", "caption"))
    first = all_.groupBy("rel", "caption").agg(F.min(F.struct("page_index", "pos")).alias("at"))
    order = Window.partitionBy("rel").orderBy("at.page_index", "at.pos")
    return first.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most).select("rel", F.col("at.page_index").alias("page_index"), "ord", "caption")


def catalogs(pages: DataFrame, captions: DataFrame, first: int = 15, chars: int = 6000) -> DataFrame:
    """(rel, catalog): the contents pages among the first pages, then the captions."""
    early = pages.withColumn("n", F.row_number().over(Window.partitionBy("rel").orderBy("page_index"))).where((F.col("n") <= first) & T.is_contents(F.col("body")))
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    contents = early.groupBy("rel").agg(F.substring(F.array_join(ordered("page_index", "body"), ""), 1, chars).alias("contents"))
    lines = captions.groupBy("rel").agg(F.array_join(ordered("ord", "caption"), "\n").alias("lines"))
    return contents.join(lines, "rel", "full_outer").select("rel", F.concat(F.coalesce("contents", F.lit("")), F.lit("\n"), F.coalesce("lines", F.lit(""))).alias("catalog"))


_GROUP = ["family", "fy", "sha256"]


def _keepers(docs: DataFrame) -> DataFrame:
    """(family, fy, sha256, keeper, n_dupes): of equal files in an edition the one with the shortest, least path."""
    return docs.groupBy(*_GROUP).agg(F.min(F.struct(F.length("rel").alias("n"), "rel"))["rel"].alias("keeper"), (F.count("*") - 1).cast("int").alias("n_dupes"))


def collapsed(docs: DataFrame) -> DataFrame:
    """docs without hidden copies, with n_dupes. Copies are counted where they lie; a file with any number of them is one row."""
    kept = _keepers(docs).select(F.col("keeper").alias("rel"), "n_dupes")
    return docs.join(kept, "rel")


def shadows(docs: DataFrame) -> DataFrame:
    """(shadow, keeper, family, fy, sha256): each hidden copy with the file that stands for it."""
    kept = _keepers(docs).where("n_dupes > 0").select(*(F.col(c).alias(f"k_{c}") for c in _GROUP), "keeper")
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in _GROUP]
    return docs.join(kept, same[0] & same[1] & same[2]).where("rel <> keeper").select(F.col("rel").alias("shadow"), "keeper", *_GROUP)


def survivors(docs: DataFrame) -> DataFrame:
    """collapsed() with the list of each file's hidden copies, for shelves that show it."""
    lists = shadows(docs).groupBy("keeper").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.length("shadow").alias("n"), "shadow"))), lambda x: x["shadow"]).alias("dupes"))
    own = collapsed(docs).join(lists.withColumnRenamed("keeper", "rel"), "rel", "left")
    return own.withColumn("dupes", F.coalesce("dupes", F.array().cast("array<string>"))).select(*docs.columns, "dupes", "n_dupes")


def with_primary(kept: DataFrame, consensus: bool = False) -> DataFrame:
    """is_primary: one of each edition, by pages, size and path; with consensus unmarked files and copied ones come first. Without a year all are."""
    order = [-F.coalesce("n_pages", F.lit(-1)), -F.coalesce("size", F.lit(-1)), F.length("rel"), F.col("rel")]
    if consensus:
        order = [T.has_marker(T.stem(F.col("rel"))).cast("int"), -F.col("n_dupes"), *order]
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    best = kept.where("fy is not null").groupBy("family", "fy").agg(F.min(F.struct(key.alias("key"), "rel"))["rel"].alias("rel")).select("rel", F.lit(True).alias("best"))
    return kept.join(best, "rel", "left").withColumn("is_primary", F.col("fy").isNull() | F.coalesce("best", F.lit(False))).select(*kept.columns, "is_primary")


def families(kept: DataFrame) -> DataFrame:
    """(family, n_editions, n_members, fy_list)."""
    years = F.sort_array(F.collect_set(F.when(F.col("is_primary"), F.col("fy"))))
    return kept.groupBy("family").agg(F.count_distinct(F.when(F.col("is_primary"), F.col("fy"))).alias("n_editions"), F.count("*").alias("n_members"), years.alias("fy_list"))


def merge_targets(counts: DataFrame) -> DataFrame:
    """(family, target): families that are another, at least as large, with one to three words in front. One pass; no chains."""
    toks = F.split("family", " ")
    tails = counts.where(F.size(toks) >= 4).select("family", "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.size(toks) - 3))).alias("k"), toks.alias("toks"))
    tails = tails.select("family", "n", "k", F.array_join(F.slice("toks", F.col("k") + 1, F.size("toks")), " ").alias("target"))
    found = tails.join(counts.select(F.col("family").alias("target"), F.col("n").alias("size")), "target").where("size >= n and target <> family")
    found = found.groupBy("family").agg(F.min_by("target", "k").alias("target"))
    return found.join(found.select(F.col("family").alias("target")), "target", "left_anti").select("family", "target")


def merged_families(docs: DataFrame, passes: int = 3) -> DataFrame:
    """docs with fragment families folded into whole ones."""
    for _ in range(passes):
        targets = merge_targets(docs.groupBy("family").agg(F.count("*").alias("n")))
        docs = docs.join(targets, "family", "left").withColumn("family", F.coalesce("target", "family")).drop("target")
    return docs


def copies(kept: DataFrame, asked: DataFrame) -> DataFrame:
    """(rel, copy, is_primary, same_hash_as_primary): for each asked document all files of its edition and its hidden copies.

    The asked ones are given, so an edition of many files is listed once for each of them, not for all its members.
    """
    primary = kept.where("is_primary").groupBy("family", "fy").agg(F.max_by("sha256", "rel").alias("p_sha"))
    named = lambda d, by: d.select(*(F.col(c).alias(f"{by}_{c}") for c in d.columns))
    same = lambda x, y: (F.col(f"{x}_family") == F.col(f"{y}_family")) & F.col(f"{x}_fy").eqNullSafe(F.col(f"{y}_fy"))
    own = named(kept.join(asked.select("rel"), "rel", "left_semi").select("rel", "family", "fy", "sha256", "dupes"), "a").join(named(primary, "p"), same("a", "p"), "left")
    members = own.join(named(kept.select("rel", "family", "fy", "sha256", "is_primary"), "b"), same("a", "b"))
    shown = members.select(F.col("a_rel").alias("rel"), F.col("b_rel").alias("copy"), F.col("b_is_primary").alias("is_primary"), (F.col("b_sha256") == F.col("p_p_sha")).alias("same_hash_as_primary"))
    hidden = own.select(F.col("a_rel").alias("rel"), F.explode("a_dupes").alias("copy"), F.lit(False).alias("is_primary"), (F.col("a_sha256") == F.col("p_p_sha")).alias("same_hash_as_primary"))
    return shown.unionAll(hidden)


def dupe_audit(kept: DataFrame, files: DataFrame) -> DataFrame:
    """(keeper, family, fy, n_shadows, risky): hidden copies against their keeper, by pages and then bytes."""
    sizes = files.select("rel", "n_pages", "size")
    own = kept.where("n_dupes > 0").select(F.col("rel").alias("keeper"), "family", "fy", F.explode("dupes").alias("shadow"))
    own = own.join(sizes.toDF("keeper", "kp", "ks"), "keeper", "left").join(sizes.toDF("shadow", "sp", "ss"), "shadow", "left")
    beats = F.col("sp").isNotNull() & F.col("kp").isNotNull() & ((F.col("sp") > F.col("kp")) | (F.col("sp") == F.col("kp")) & (F.coalesce("ss", F.lit(0)) > F.coalesce("ks", F.lit(0))))
    return own.groupBy("keeper", "family", "fy").agg(F.count("*").alias("n_shadows"), F.max(beats).alias("risky"))


def audit_totals(audit: DataFrame) -> DataFrame:
    """(groups_with_copies, copies_hidden, risky_groups) of dupe_audit()."""
    return audit.agg(F.count("*").alias("groups_with_copies"), F.coalesce(F.sum("n_shadows"), F.lit(0)).alias("copies_hidden"), F.count_if("risky").alias("risky_groups"))


def worst(audit: DataFrame, most: int) -> DataFrame:
    """The groups to look at first: risky ones, then those with most hidden copies."""
    return audit.orderBy(F.desc(F.coalesce("risky", F.lit(False))), F.desc("n_shadows"), "keeper").limit(most)


def stale(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Cards and hidden copies (rel) of files that are indexed no more."""
    return kept.select("rel").unionAll(kept.select(F.explode("dupes").alias("rel"))).join(files.where("status = 'indexed'").select("rel"), "rel", "left_anti")


def counters(cards_: DataFrame, consensus: DataFrame, captions: DataFrame) -> DataFrame:
    """One row of a build's counters, from the shelf with title_source and is_primary, the same shelf with primaries by consensus, and the captions."""
    fam = cards_.groupBy("family").agg(F.count_distinct(F.when(F.col("is_primary"), F.col("fy"))).alias("n")).agg(F.count("*").alias("n_families"), F.count_if(F.col("n") >= 2).alias("n_families_with_2plus_editions"))
    groups = cards_.where("fy is not null").groupBy("family", "fy").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_multi_copy_editions"))
    first = lambda d, c: d.where("is_primary and fy is not null").select("family", "fy", F.col("rel").alias(c))
    changed = first(cards_, "a").join(first(consensus, "b"), ["family", "fy"]).agg(F.count_if(F.col("a") != F.col("b")).alias("n_primary_changed"))
    own = cards_.agg(F.count("*").alias("n_docs"), F.count_if(F.col("title_source") == "page0").alias("n_title_from_page0"), F.count_if(F.col("fy").isNotNull()).alias("n_with_fy"), F.coalesce(F.sum("n_dupes"), F.lit(0)).alias("n_dupes"), F.count_if(F.contains("family", F.lit("{yr}"))).alias("n_docs_with_calendar_year"))
    out = own.crossJoin(fam).crossJoin(groups).crossJoin(changed)  # one row each
    return out.crossJoin(captions.agg(F.count("*").alias("n_captions")))


def nearest_years(docs: DataFrame, asked: Column) -> DataFrame:
    """(family, asked, verdict, before, after): whether a family has the year, and the nearest years if not."""
    own = docs.where("is_primary and fy is not null").withColumn("asked", asked)
    out = own.groupBy("family", "asked").agg(F.max((F.col("fy") == F.col("asked")).cast("int")).alias("has"), F.max(F.when(F.col("fy") < F.col("asked"), F.col("fy"))).alias("nearest_before"), F.min(F.when(F.col("fy") > F.col("asked"), F.col("fy"))).alias("nearest_after"))
    return out.select("family", "asked", F.when(F.col("has") == 1, "EDITION_PRESENT").otherwise("NO_EDITION_FOR").alias("verdict"), "nearest_before", "nearest_after")


def missing(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Indexed files that no card and no list of copies has."""
    return files.where("status = 'indexed'").join(kept.select("rel").unionAll(kept.select(F.explode("dupes").alias("rel"))), "rel", "left_anti")


def updated(kept: DataFrame, all_docs: DataFrame, new: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """kept with new documents: every edition that one of them touches is decided again, hidden copies included.

    all_docs has the cards as they are now, of old and new documents; before has the former cards of documents that changed, whose editions are
    decided again too. Equal to a full rebuild.
    """
    touched = all_docs.join(new.select("rel"), "rel", "left_semi").select("family", "fy")
    touched = (touched if before is None else touched.unionAll(before.select("family", "fy"))).toDF("t_family", "t_fy").distinct()
    here = lambda d: (F.col("family") == F.col("t_family")) & F.col("fy").eqNullSafe(F.col("t_fy"))
    again = with_primary(survivors(all_docs.join(touched, here(all_docs), "left_semi")))
    return kept.join(touched, here(kept), "left_anti").unionByName(again)


def rebuild_preferred(n_missing: int, n_indexed: int) -> bool:
    """Whether so much is missing that the shelf should be built anew."""
    return n_missing * 2 >= n_indexed


def canonical_hash(df: DataFrame) -> DataFrame:
    """(n_rows, digest): the table's rows as sorted JSON. Rows are hashed where they lie; digests are summed, so order and partitions do not matter."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"p{i}") for i in range(4)]
    return df.agg(F.count("*").alias("n_rows"), *part).select("n_rows", F.sha2(F.concat_ws("|", "n_rows", *(f"p{i}" for i in range(4))), 256).alias("digest"))

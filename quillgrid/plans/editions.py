"""Queries over cards, editions and families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import shelf
from ..sources import derived
from . import sql
from .registry import query

DOCS = f"docs AS (SELECT c.rel, title_line AS title, {sql.family('title_line', 'fy')} AS family, fy, n_pages, size, sha256 FROM corpus c JOIN files f ON c.rel = f.rel WHERE status = 'indexed')"
KEPT = f"""{DOCS}, surv AS (SELECT *, row_number() OVER (PARTITION BY family, fy, sha256 ORDER BY length(rel), rel) AS k, count(*) OVER (PARTITION BY family, fy, sha256) - 1 AS n_dupes FROM docs),
kept AS (SELECT *, fy IS NULL OR row_number() OVER (PARTITION BY family, fy ORDER BY n_pages DESC, size DESC, length(rel), rel) = 1 AS is_primary FROM surv WHERE k = 1),
dupes AS (SELECT s.rel AS shadow, k.rel AS keeper, k.family, k.fy, k.sha256 FROM surv s JOIN kept k ON s.family = k.family AND s.fy IS NOT DISTINCT FROM k.fy AND s.sha256 = k.sha256 WHERE s.k > 1)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.corpus(spark, sf_dir).select("rel", F.col("title_line").alias("title"), T.family(F.col("title_line"), T.fiscal_years(F.col("title_line"))).alias("family"), "fy")
    return own.join(derived.files(spark, sf_dir).where("status = 'indexed'").drop("status"), "rel")


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.with_primary(shelf.survivors(docs(spark, sf_dir)))


@query(f"WITH {sql.CORPUS}, {KEPT} SELECT rel, family, fy, n_dupes FROM kept")
def dedupe_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.collapsed(docs(spark, sf_dir)).select("rel", "family", "fy", F.col("n_dupes").cast("long").alias("n_dupes"))


@query(f"WITH {sql.CORPUS}, {KEPT} SELECT shadow, keeper FROM dupes")
def hidden_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hidden copy with the file that stands for it."""
    return shelf.shadows(docs(spark, sf_dir)).select("shadow", "keeper")


@query(f"WITH {sql.CORPUS}, {KEPT} SELECT rel, is_primary FROM kept")
def edition_primary_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.with_primary(shelf.collapsed(docs(spark, sf_dir))).select("rel", "is_primary")


_STEM = "regexp_replace(string_split(rel, '/')[-1], '\\.[^.]*$', '')"


@query(f"WITH {sql.CORPUS}, {KEPT} SELECT rel, fy IS NULL OR row_number() OVER (PARTITION BY family, fy ORDER BY CASE WHEN regexp_matches({_STEM}, '(?i)(^|[^A-Za-z0-9])({T.MARKERS})($|[^A-Za-z0-9])') THEN 1 ELSE 0 END, n_dupes DESC, n_pages DESC, size DESC, length(rel), rel) = 1 AS is_primary FROM kept")
def edition_primary_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.with_primary(shelf.collapsed(docs(spark, sf_dir)), consensus=True).select("rel", "is_primary")


_FAMILIES = "SELECT family, count(DISTINCT fy) FILTER (is_primary) AS n_editions, count(*) AS n_members, coalesce(array_to_string(list_sort(list(DISTINCT fy) FILTER (is_primary AND fy IS NOT NULL)), ','), '') AS fy_list FROM kept GROUP BY family"


@query(f"WITH {sql.CORPUS}, {KEPT} {_FAMILIES}")
def families_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.families(kept(spark, sf_dir)).withColumn("fy_list", F.array_join("fy_list", ","))


@query(f"WITH {sql.CORPUS}, {KEPT}, f AS ({_FAMILIES}), best AS (SELECT family FROM f ORDER BY n_editions DESC, family LIMIT 1) SELECT family, round(avg(n_pages) FILTER (is_primary), 1) AS mean_pages FROM kept JOIN best USING (family) GROUP BY family")
def family_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family with most editions and the mean pages of its primaries."""
    own = kept(spark, sf_dir)
    best = shelf.families(own).orderBy(F.desc("n_editions"), "family").limit(1).select("family")
    return own.join(best, "family").groupBy("family").agg(F.round(F.avg(F.when(F.col("is_primary"), F.col("n_pages"))), 1).alias("mean_pages"))


_FRAG = f"frag AS (SELECT rel, CASE WHEN length(rel) % 5 = 0 AND fy IS NOT NULL THEN concat('see the ', family) ELSE family END AS family FROM docs)"


@query(f"""WITH {sql.CORPUS}, {DOCS}, {_FRAG}, c AS (SELECT family, count(*) AS n FROM frag GROUP BY family), t AS (SELECT family, n, k, array_to_string(string_split(family, ' ')[k + 1:], ' ') AS target FROM c, (VALUES (1), (2), (3)) v(k) WHERE len(string_split(family, ' ')) >= 4 AND len(string_split(family, ' ')) - k >= 3),
m AS (SELECT t.family, arg_min(target, k) AS target FROM t JOIN c g ON g.family = t.target WHERE g.n >= t.n GROUP BY t.family) SELECT family, target FROM m WHERE target NOT IN (SELECT family FROM m)""")
def family_fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs(spark, sf_dir).withColumn("family", F.when((F.length("rel") % 5 == 0) & F.col("fy").isNotNull(), F.concat(F.lit("see the "), "family")).otherwise(F.col("family")))
    return shelf.merge_targets(own.groupBy("family").agg(F.count("*").alias("n")))


_CAPTIONS = "caps AS (SELECT rel, page_index, i, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS caption FROM (SELECT rel, page_index, unnest(x) AS l, unnest(range(1, len(x) + 1)) AS i FROM (SELECT rel, page_index, regexp_extract_all(body, '(?m)^[ \\t]*Table\\s+[A-Za-z]?\\.?\\d+(?:\\.\\d+)*\\s*[:.\\-–]\\s*.{3,160}$') AS x FROM page_rows) a) b)"


@query(f"WITH {sql.CORPUS}, {_CAPTIONS}, d AS (SELECT rel, caption, min(page_index * 1000 + i) AS place FROM caps GROUP BY ALL) SELECT rel, caption, CAST(place // 1000 AS INTEGER) AS page_index, CAST(row_number() OVER (PARTITION BY rel ORDER BY place) AS INTEGER) AS ord FROM d QUALIFY ord <= 400")
def captions_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.harvested(derived.pages(spark, sf_dir)).select("rel", "caption", "page_index", "ord")


@query(f"""WITH {sql.CORPUS}, {_CAPTIONS}, cap AS (SELECT rel, string_agg(caption, chr(10) ORDER BY page_index, i) AS lines FROM caps GROUP BY rel), con AS (SELECT rel, left(string_agg(body, '' ORDER BY page_index), 6000) AS contents FROM page_rows WHERE page_index <= 15 AND regexp_matches(body, '(?i)contents|list of tables') GROUP BY rel)
SELECT rel, sha256(concat(coalesce(contents, ''), chr(10), coalesce(lines, ''))) AS catalog_sha FROM con FULL JOIN cap USING (rel)""")
def catalog_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.pages(spark, sf_dir)
    return shelf.catalogs(pages, shelf.harvested(pages)).select("rel", F.sha2("catalog", 256).alias("catalog_sha"))


@query("WITH " + sql.CORPUS + ", " + _CAPTIONS + " SELECT rel, page_index, caption FROM caps WHERE contains(lower(caption), 'expenditure of src1')")
def tables_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.harvested(derived.pages(spark, sf_dir)).where(F.contains(F.lower("caption"), F.lit("expenditure of src1"))).select("rel", "page_index", "caption")


@query(f"WITH {sql.CORPUS}, {KEPT} SELECT keeper, family, fy, count(*) AS n_shadows, max(fs.n_pages > fk.n_pages OR (fs.n_pages = fk.n_pages AND fs.size > fk.size)) AS risky FROM dupes d JOIN files fs ON fs.rel = shadow JOIN files fk ON fk.rel = keeper GROUP BY ALL")
def dupe_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.dupe_audit(kept(spark, sf_dir), derived.files(spark, sf_dir))


_AUDIT = "audit AS (SELECT keeper, count(*) AS n_shadows, max(fs.n_pages > fk.n_pages OR (fs.n_pages = fk.n_pages AND fs.size > fk.size) OR length(shadow) % 7 = 0) AS risky FROM dupes d JOIN files fs ON fs.rel = shadow JOIN files fk ON fk.rel = keeper GROUP BY ALL)"


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of files whose index says one page more for every hidden copy with a path of a multiple of seven characters, so that some are risky."""
    own = kept(spark, sf_dir)
    hidden = own.where("n_dupes > 0").select(F.explode("dupes").alias("rel")).where(F.length("rel") % 7 == 0).withColumn("more", F.lit(1))
    files = derived.files(spark, sf_dir).join(hidden, "rel", "left").withColumn("n_pages", F.col("n_pages") + F.coalesce("more", F.lit(0))).drop("more")
    return shelf.dupe_audit(own, files)


@query(f"WITH {sql.CORPUS}, {KEPT}, {_AUDIT} SELECT count(*) AS groups_with_copies, sum(n_shadows) AS copies_hidden, count(*) FILTER (risky) AS risky_groups FROM audit")
def dupe_audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shelf.audit_totals(_audited(spark, sf_dir))
    return out.withColumn("copies_hidden", F.col("copies_hidden").cast("decimal(38,0)"))


@query(f"WITH {sql.CORPUS}, {KEPT}, {_AUDIT} SELECT keeper, n_shadows, risky FROM audit ORDER BY risky DESC, n_shadows DESC, keeper LIMIT 10")
def dupe_audit_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten groups of copies to look at first."""
    return shelf.worst(_audited(spark, sf_dir), 10).select("keeper", "n_shadows", "risky")


@query(f"""WITH {sql.CORPUS}, {KEPT}, p AS (SELECT family, fy, arg_max(sha256, rel) AS sha FROM kept WHERE is_primary GROUP BY ALL) SELECT a.rel, b.rel AS copy, b.is_primary, b.sha256 = p.sha AS same_hash_as_primary FROM kept a JOIN kept b ON a.family = b.family AND a.fy IS NOT DISTINCT FROM b.fy JOIN p ON p.family = a.family AND p.fy IS NOT DISTINCT FROM a.fy WHERE a.is_primary AND a.fy IS NOT NULL
UNION ALL SELECT keeper, shadow, false, d.sha256 = p.sha FROM dupes d JOIN p ON p.family = d.family AND p.fy = d.fy WHERE keeper IN (SELECT rel FROM kept WHERE is_primary)""")
def copies_of_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every edition with a year: what its primary is a copy of."""
    own = kept(spark, sf_dir)
    return shelf.copies(own, own.where("is_primary and fy is not null"))


@query(f"WITH {sql.CORPUS}, {KEPT}, a AS (SELECT family, fy, CASE length(family) % 3 WHEN 0 THEN '2012-13' WHEN 1 THEN '2009-10' ELSE '2019-20' END AS asked FROM kept WHERE is_primary AND fy IS NOT NULL) SELECT family, asked, CASE WHEN bool_or(fy = asked) THEN 'EDITION_PRESENT' ELSE 'NO_EDITION_FOR' END AS verdict, max(fy) FILTER (fy < asked) AS nearest_before, min(fy) FILTER (fy > asked) AS nearest_after FROM a GROUP BY ALL")
def have_fy_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.expr("CASE length(family) % 3 WHEN 0 THEN '2012-13' WHEN 1 THEN '2009-10' ELSE '2019-20' END")
    return shelf.nearest_years(kept(spark, sf_dir), asked)


@query(f"WITH {sql.CORPUS}, {KEPT} SELECT rel, family, fy, n_dupes, is_primary FROM kept")
def update_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shelf of most documents, updated with the rest; the oracle is a full rebuild."""
    every = docs(spark, sf_dir)
    old = every.where(F.length("rel") % 4 != 1)
    shelf_ = shelf.with_primary(shelf.survivors(old))
    out = shelf.updated(shelf_, every, every.where(F.length("rel") % 4 == 1))
    return out.select("rel", "family", "fy", F.col("n_dupes").cast("long").alias("n_dupes"), "is_primary")


@query(f"WITH {sql.CORPUS}, {KEPT} SELECT rel FROM docs WHERE length(rel) % 4 = 1 AND rel NOT IN (SELECT rel FROM (SELECT *, row_number() OVER (PARTITION BY family, fy, sha256 ORDER BY length(rel), rel) AS k2 FROM docs WHERE length(rel) % 4 <> 1) z)")
def missing_from_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = shelf.with_primary(shelf.survivors(docs(spark, sf_dir).where(F.length("rel") % 4 != 1)))
    return shelf.missing(derived.files(spark, sf_dir), old).select("rel")


@query(f"WITH {sql.CORPUS}, {DOCS} SELECT rel FROM docs WHERE length(rel) % 6 = 0")
def stale_on_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards and hidden copies of files that the index has lost."""
    return shelf.stale(derived.files(spark, sf_dir).where(F.length("rel") % 6 != 0), kept(spark, sf_dir))


_V2 = f"v2 AS (SELECT rel, family, fy, row_number() OVER (PARTITION BY family, fy ORDER BY CASE WHEN regexp_matches({_STEM}, '(?i)(^|[^A-Za-z0-9])({T.MARKERS})($|[^A-Za-z0-9])') THEN 1 ELSE 0 END, n_dupes DESC, n_pages DESC, size DESC, length(rel), rel) AS k2 FROM kept WHERE fy IS NOT NULL)"


@query(f"""WITH {sql.CORPUS}, {KEPT}, {_V2}, {_CAPTIONS}, fam AS (SELECT family, count(DISTINCT fy) FILTER (is_primary) AS n FROM kept GROUP BY family) SELECT count(*) AS n_docs, count(*) FILTER (len(regexp_extract_all(title, '[A-Za-z]{{2,}}')) >= 3) AS n_title_from_page0, count(*) FILTER (fy IS NOT NULL) AS n_with_fy,
sum(n_dupes) AS n_dupes, count(*) FILTER (contains(family, '{{yr}}')) AS n_docs_with_calendar_year, (SELECT count(*) FROM fam) AS n_families, (SELECT count(*) FROM fam WHERE n >= 2) AS n_families_with_2plus_editions,
(SELECT count(*) FROM (SELECT family, fy FROM kept WHERE fy IS NOT NULL GROUP BY ALL HAVING count(*) > 1) g) AS n_multi_copy_editions, (SELECT count(*) FROM v2 JOIN kept a USING (rel) WHERE k2 = 1 AND NOT a.is_primary) AS n_primary_changed,
(SELECT count(*) FROM (SELECT DISTINCT rel, caption FROM caps) c) AS n_captions FROM kept""")
def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a build, primaries that consensus would change among them."""
    cards_ = shelf.collapsed(docs(spark, sf_dir)).withColumn("title_source", T.title_source(F.col("title")))
    out = shelf.counters(shelf.with_primary(cards_), shelf.with_primary(cards_, consensus=True), shelf.harvested(derived.pages(spark, sf_dir)))
    return out.withColumn("n_dupes", F.col("n_dupes").cast("decimal(38,0)"))


@query(f"WITH {sql.CORPUS}, {KEPT} SELECT count(*) AS n_docs, count(*) FILTER (fy IS NOT NULL) AS with_fy, sum(n_dupes) AS n_dupes, count(*) FILTER (is_primary) AS n_primary, count(*) + sum(n_dupes) = (SELECT count(*) FROM docs) AS n_docs_matches FROM kept")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = docs(spark, sf_dir)
    out = kept(spark, sf_dir).agg(F.count("*").alias("n_docs"), F.count_if(F.col("fy").isNotNull()).alias("with_fy"), F.sum("n_dupes").cast("decimal(38,0)").alias("n_dupes"), F.count_if("is_primary").alias("n_primary"))
    return out.withColumn("n_docs_matches", F.col("n_docs") + F.col("n_dupes") == F.lit(every.count()))


_PART = lambda i: f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT)"


@query(f"""WITH {sql.CORPUS}, {KEPT}, f AS (SELECT family, coalesce(list_sort(list(DISTINCT fy) FILTER (is_primary AND fy IS NOT NULL)), []) AS fy_list, count(DISTINCT fy) FILTER (is_primary) AS n_editions, count(*) AS n_members FROM kept GROUP BY family),
j AS (SELECT sha256(CAST(to_json(struct_pack(family := family, fy_list := fy_list, n_editions := n_editions, n_members := n_members)) AS VARCHAR)) AS h FROM f) SELECT count(*) AS n_rows, sha256(concat_ws('|', count(*), {", ".join(_PART(i) for i in range(4))})) AS digest FROM j""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.canonical_hash(shelf.families(kept(spark, sf_dir)))


@query(f"WITH {sql.CORPUS} SELECT c.rel, left(title_line, 160) AS title, 'page0' AS title_source, {sql.family('title_line', 'fy')} AS family, fy FROM corpus c JOIN files f USING (rel) WHERE status = 'indexed'")
def cards_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards from stored pages and files."""
    return shelf.cards(derived.pages(spark, sf_dir), derived.files(spark, sf_dir)).select("rel", "title", "title_source", "family", "fy")

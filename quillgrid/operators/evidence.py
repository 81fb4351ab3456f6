"""Evidence: notes against pages, answers against notes, conversations against what was opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE_CHARS = 12_000
THIN_CHARS = 50


def open_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rel, page_index, body, error) for the wanted (rel, page_index): bodies are cut for display, thin pages are flagged."""
    own = wanted.join(pages, ["rel", "page_index"], "left")
    error = F.when(F.col("body").isNull(), "PAGE_NOT_IN_INDEX").when(F.length(T.strip(F.col("body"))) < THIN_CHARS, "PAGE_HAS_NO_READABLE_TEXT")
    return own.select("rel", "page_index", F.substring("body", 1, PAGE_CHARS).alias("body"), error.alias("error"))


def _cited(notes: DataFrame) -> DataFrame:
    return notes.withColumns({"path": T.citation_path(F.col("text")), "page": T.citation_page(F.col("text"))}).withColumn("tail", T.tail2(F.col("path")))


def _by_tail(files: DataFrame) -> DataFrame:
    """(tail, rel): the least path of those that end alike."""
    return files.groupBy(T.tail2(F.col("rel")).alias("tail")).agg(F.min("rel").alias("rel"))


def _with_pages(notes: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    own = _cited(notes).join(_by_tail(files), "tail", "left")
    return own.join(pages.select("rel", F.col("page_index").alias("page"), "body"), ["rel", "page"], "left")


def note_verdicts(notes: DataFrame, opened: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """(note_id, verdict): whether a note (note_id, slug, text, quote) may be recorded, or the first reason why not."""
    seen = opened.select("slug", T.tail2(F.col("rel")).alias("tail"), F.col("page_index").alias("page"), F.lit(True).alias("seen")).distinct()
    own = _with_pages(notes, files, pages).join(seen, ["slug", "tail", "page"], "left")
    chunks = T.quote_chunks(F.col("quote"))
    verdict = F.when(F.col("path").isNull() | F.col("page").isNull(), "NO_CITATION").when(F.col("seen").isNull(), "PAGE_NOT_OPENED").when(F.size(chunks) == 0, "NO_QUOTE").when(F.col("body").isNull(), "PAGE_NOT_IN_INDEX")
    return own.select("note_id", verdict.when(~T.quote_on_page(F.col("quote"), F.col("body")), "QUOTE_NOT_ON_PAGE").otherwise("ok").alias("verdict"))


def verified(notes: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """(note_id, error, page_changed): each recorded note (with page_sha) against the index as it is now."""
    own = _with_pages(notes, files, pages)
    changed = F.col("page_sha").isNotNull() & (F.col("page_sha") != T.page_sha(F.col("body")))
    on_page = T.quote_on_page(F.col("quote"), F.col("body"))
    error = F.when(F.col("path").isNull(), "NO_CITATION_TAIL").when(F.col("rel").isNull(), "CITED_FILE_NOT_IN_INDEX").when(F.col("body").isNull(), "CITED_PAGE_NOT_IN_INDEX")
    error = error.when(~on_page & changed, "PAGE_CHANGED_SINCE_NOTE").when(~on_page, "QUOTE_NOT_ON_PAGE").otherwise("ok")
    return own.select("note_id", error.alias("error"), F.coalesce(F.col("body").isNotNull() & changed, F.lit(False)).alias("page_changed"))


def verify_totals(checks: DataFrame, figures_: DataFrame | None = None) -> DataFrame:
    """(n_notes, n_bad), and n_bad_answer if the figures of answers are given: those that no note supports."""
    out = checks.agg(F.count("*").alias("n_notes"), F.count_if(F.col("error") != "ok").alias("n_bad"))
    return out if figures_ is None else out.crossJoin(figures_.agg(F.count_if(~F.col("supported")).alias("n_bad_answer")))  # one row each


def figures(answers: DataFrame, notes: DataFrame) -> DataFrame:
    """(slug, figure, supported, in_notes): each figure of an answer (slug, text), and up to three notes whose quote has it."""
    stated = answers.select("slug", F.explode(F.array_distinct(T.numbers_in(T.without_citations(F.col("text"))))).alias("figure"))
    quoted = notes.select("slug", "note_id", F.explode(T.quote_numbers(F.col("quote"))).alias("figure"))
    place = F.row_number().over(Window.partitionBy("slug", "figure").orderBy("note_id"))
    shown = quoted.distinct().join(stated.distinct(), ["slug", "figure"], "left_semi").withColumn("place", place).where("place <= 3")  # cut before the exchange
    lists = shown.groupBy("slug", "figure").agg(F.sort_array(F.collect_list("note_id")).alias("in_notes"))
    own = stated.distinct().join(lists, ["slug", "figure"], "left").withColumn("in_notes", F.coalesce("in_notes", F.array().cast(lists.schema["in_notes"].dataType)))
    return own.select("slug", "figure", (F.size("in_notes") > 0).alias("supported"), "in_notes")


def unsupported_everywhere(checked: DataFrame, by: str = "session") -> DataFrame:
    """(session, figure): figures that no slug of a session supports; a slug is a group of notes."""
    slugs = checked.groupBy(by).agg(F.count_distinct("slug").alias("n_slugs"))
    bad = checked.where("not supported").groupBy(by, "figure").agg(F.count_distinct("slug").alias("n_bad"))
    return bad.join(slugs, by).where("n_bad = n_slugs").select(by, "figure")


def recent_slugs(notes: DataFrame, now: Column, minutes: int = 180) -> DataFrame:
    """Slugs with a note in the last minutes."""
    return notes.groupBy("slug").agg(F.max("ts").alias("last")).where(F.col("last") >= now - F.make_interval(mins=F.lit(minutes))).select("slug")


def citation_rules(answers: DataFrame, opened: DataFrame, header: str | None = None) -> DataFrame:
    """(session, rules): the rules that a final answer (session, text) violates, against opened (session, rel, page_index).

    The cited paths are compared with the opened ones of the same session by file name first; only those pairs get the full test.
    """
    text = F.col("text")
    name = lambda p: F.get(T.segments(p), F.size(T.segments(p)) - 1)
    seen = opened.select("session", F.col("rel").alias("o_rel"), F.col("page_index").alias("o_page"), name(F.col("rel")).alias("name"))
    cited = answers.select("session", F.explode(T.cited_paths(text)).alias("path")).withColumn("name", name(F.col("path")))
    good = cited.join(seen, ["session", "name"]).where(T.same_path(F.col("path"), F.col("o_rel"))).select("session", "path").distinct()
    unopened = cited.join(good, ["session", "path"], "left_anti").select("session", F.lit("cited_unopened").alias("rule"))
    sources = answers.select("session", F.explode(T.sources_lines(text)).alias("s")).select("session", "s.path", "s.page").withColumn("name", name(F.col("path")))
    good = sources.join(seen, ["session", "name"]).where(T.same_path(F.col("path"), F.col("o_rel")) & (F.col("page") == F.col("o_page"))).select("session", "path", "page").distinct()
    lines = sources.join(good, ["session", "path", "page"], "left_anti").select("session", F.lit("sources_line_not_opened").alias("rule"))
    refs = answers.select("session", F.explode(T.page_refs(text)).alias("o_page")).join(seen.select("session", "o_page").distinct(), ["session", "o_page"], "left_anti").select("session", F.lit("page_ref_not_opened").alias("rule"))
    bare = answers.where(T.figures_without_citation(text)).select("session", F.lit("figures_no_citation").alias("rule"))
    # of the citation rules the first one counts, in this order
    order = F.create_map(*(x for i, r in enumerate(("cited_unopened", "sources_line_not_opened", "page_ref_not_opened", "figures_no_citation")) for x in (F.lit(r), F.lit(i))))
    first = unopened.unionAll(lines).unionAll(refs).unionAll(bare).groupBy("session").agg(F.min_by("rule", order[F.col("rule")]).alias("rule"), F.min(order[F.col("rule")]).alias("n"))
    more = F.array_compact(F.array(F.col("rule"), F.when(F.lit(header is not None) & ~T.has_header(text, header or ""), "missing_header"), F.when(F.size(T.machinery_words(text)) > 0, "machinery_words"), F.when(T.prose_after_sources(text), "prose_after_sources")))
    return answers.join(first.select("session", "rule"), "session", "left").select("session", more.alias("rules"))


# The names of the rules are results and are given.
def answer_names(answer: Column, rel: Column) -> Column:
    """Which rule says that an answer names a file, if one does."""
    text, path = T.norm_text(answer), T.norm_path(rel)
    own = F.filter(F.split(path, "/"), lambda x: x != "")
    base, parent = F.get(own, F.size(own) - 1), F.get(own, F.size(own) - 2)
    tail = F.concat_ws("/", parent, base)
    pieces = F.split(text, F.concat(F.lit(r"\Q"), base, F.lit(r"\E")), -1)
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda s, p: s + F.length(p) + F.length(base)) - F.length(base))
    near = F.exists(starts, lambda s: F.contains(F.substring(text, F.greatest(s - 79, F.lit(1)), s + F.length(base) + 80 - F.greatest(s - 80, F.lit(0))), parent)) & (F.size(pieces) > 1)
    deep = F.when(F.contains(text, tail), "last_two_segments").when(near, "parent_and_child_adjacent").otherwise("basename_only_or_absent")
    flat = F.when(F.contains(text, base) & (F.length(base) >= 12), "distinctive_basename_depth0").when(F.contains(text, base), "basename_too_generic").otherwise("absent")
    return F.when((text == "") | (path == ""), "empty").when(F.contains(text, path), "full_path").when(F.size(own) >= 2, deep).otherwise(flat)


def is_found(rule: Column) -> Column:
    return rule.isin("full_path", "last_two_segments", "parent_and_child_adjacent", "distinctive_basename_depth0")


def retrieval_hit(opened: Column, rel: Column) -> Column:
    """Whether one of the opened paths is the expected file."""
    path = T.norm_path(rel)
    own = F.filter(F.split(path, "/"), lambda x: x != "")
    tail = F.concat_ws("/", F.get(own, F.size(own) - 2), F.get(own, F.size(own) - 1))
    slash = F.lit("/")
    return F.exists(F.transform(opened, T.norm_path), lambda p: (p != "") & ((p == path) | F.endswith(p, F.concat(slash, path)) | F.endswith(path, F.concat(slash, p)) | ((F.size(own) >= 2) & F.endswith(p, tail))))


def decisions(results: DataFrame) -> DataFrame:
    """(session, reason, slugs): why a session's answer should be held back, if it should: bad notes first, else figures in no note.

    results has session, slug, n_bad, n_bad_answer; marked (already asked this turn) is optional and stops a second block.
    """
    own = results if "marked" in results.columns else results.withColumn("marked", F.lit(False))
    out = own.groupBy("session").agg(F.bool_or("marked").alias("marked"), F.sort_array(F.collect_set(F.when(F.col("n_bad") > 0, F.col("slug")))).alias("notes"), F.sort_array(F.collect_set(F.when(F.col("n_bad_answer") > 0, F.col("slug")))).alias("figures"))
    reason = F.when(F.col("marked"), None).when(F.size("notes") > 0, "notes").when(F.size("figures") > 0, "figures")
    return out.select("session", reason.alias("reason"), F.when(reason == "notes", F.slice("notes", 1, 4)).when(reason == "figures", F.slice("figures", 1, 4)).alias("slugs"))

"""Scalar text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Stop words, filler words, file-name markers, tool vocabulary and path extensions decide results and are given.
STOP = (
    "a an the of in on at to for and or is are was were be been being with by from as that this these those it its which what when where who whom how why does do did doing than then there "
    "their them they he she his her you your we our us i me my if but not no nor so such only own same too very can will just should now over under between into through during before after above "
    "below up down out off again further once here both each few more most other some any all need want give show tell find look"
).split()
FILLER = "has have gone period much decade so trajectory years we me give".split()
MARKERS = r"\(1\)|\(2\)|\(3\)|\(4\)|\(5\)|\(6\)|\(7\)|\(8\)|\(9\)|copy|draft|final|new|old|v1|v2|v3|v4|v5|v6|v7|v8|v9|rev|revised|updated|use this one|backup"
MACHINERY = (
    r"(?i)(?<![A-Za-z])(?:the shelf|shelf (?:returned|gave|listed|showed)|(?:\d+|two|three|four|five|six|several|my|the) rewrites|rewrites? (?:of|for) (?:the|my) (?:question|query|search)|"
    r"(?:query|search) rewrites?|the whole index|occur in the index|search(?:ed|ing)? the index|not indexed|hooks?(?![A-Za-z])|slugs?(?![A-Za-z])|exit code|harness|coverage line|"
    r"(?:stop|verify|note|citation) guard|c_shelf|99_scratch|engine[\\/]bin)"
)
PATH_EXTENSIONS = "pdf|xlsx|xls|docx|doc|csv|txt|md|pptx|ppt"
FISCAL_YEAR = r"\b(20[0-3]\d-\d\d)\b"
CAPTION = r"(?md)^[ \t]*Table\s+[A-Za-z]?\.?\d+(?:\.\d+)*\s*[:.\-–]\s*.{3,160}$"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
UNIT = r"(?i)(?<![A-Za-z])(billion|million|percent|%|rs|rupees|tonnes|thousand)(?![A-Za-z])"
# Fixed values too: how a Sources block, a citation and a figure look.
SOURCES_HEAD = r"(?im)^\s*#{0,6}\s*\**\s*sources\s*\**\s*:?\s*$"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Index terms: runs of letters and digits, lower case, without accents."""
    return _all(F.translate(F.lower(text), ACCENTED, PLAIN), r"[\p{L}\p{N}]+")


def content_words(query: Column, unicode: bool = False) -> Column:
    """Words worth a search: two characters or more, no stop words, each once, in order."""
    found = _all(F.lower(F.coalesce(query, F.lit(""))), r"[\p{L}\p{N}_\-]+" if unicode else r"[A-Za-z0-9_\-]+")
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~F.array_contains(_words(STOP), t)))


def raw_words(query: Column) -> Column:
    return _all(query, r"[A-Za-z0-9_\-]+")


def fiscal_years(text: Column) -> Column:
    return _all(F.coalesce(text, F.lit("")), FISCAL_YEAR, 1)


def bare_years(text: Column) -> Column:
    return _all(F.coalesce(text, F.lit("")), r"\b(?:19|20)\d\d\b")


def label_words(query: Column) -> Column:
    """Content words of a row label: fiscal years and filler words go."""
    return F.array_except(content_words(F.regexp_replace(query, FISCAL_YEAR, " ")), _words(FILLER))


def is_title_line(line: Column) -> Column:
    return (F.size(_all(line, r"[A-Za-z]{2,}")) >= 3) & ~line.rlike(r"^\s*[\[{]") & (F.size(_all(line, r"[A-Za-z0-9_]+")) <= 25)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def stem(rel: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(rel, "/"), -1), r"(?<=.)\.[^.]*$", "")


def file_title(rel: Column) -> Column:
    return F.translate(stem(rel), "_-", "  ")


def title(first_page: Column, rel: Column) -> Column:
    """The first line of the first page that can be a title, or else the file name."""
    line = F.get(F.filter(F.transform(lines(first_page), strip), is_title_line), F.lit(0))
    return F.substring(F.coalesce(line, file_title(rel)), 1, 160)


def title_source(first_page: Column) -> Column:
    return F.when(F.exists(F.transform(lines(first_page), strip), is_title_line), "page0").otherwise("filename")


def family(name: Column, years: Column, bare: bool = False) -> Column:
    """A title without years, markers and punctuation: what the editions of a publication share."""
    text = F.aggregate(years, F.lower(name), lambda s, y: F.replace(s, F.lower(y), F.lit("{fy}")))
    if bare:
        text = F.regexp_replace(text, r"\b(?:19|20)\d\d\b", "{yr}")
    text = F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9])(?:{MARKERS})(?![A-Za-z0-9])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9{}]+", " "), r"\s+", " "))


def family_words(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(name, F.lit("{fy}"), F.lit(" ")), r"\s+", " "))


def has_marker(text: Column) -> Column:
    return text.rlike(rf"(?i)(?<![A-Za-z0-9])(?:{MARKERS})(?![A-Za-z0-9])")


def captions(body: Column) -> Column:
    return F.transform(_all(body, CAPTION), strip)


def is_contents(body: Column) -> Column:
    return body.rlike("(?i)contents|list of tables")


def junk_count(body: Column) -> Column:
    return F.length(body) - F.length(F.regexp_replace(body, r"[\x00-\x08\x0b\x0c\x0e-\x1f-]", ""))


def is_junk(body: Column) -> Column:
    return junk_count(body) > F.greatest(F.lit(4.0), F.length(body) * 0.02)


def squeezed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def quote_chunks(quote: Column) -> Column:
    """The parts of a quote between elisions that are long enough to check."""
    parts = F.transform(F.split(F.coalesce(quote, F.lit("")), r"\.{3,}|…"), squeezed)
    return F.filter(parts, lambda c: (F.length(c) >= 6) | ((F.length(c) >= 3) & c.rlike(r"\d")))


def missing_chunk(quote: Column, body: Column) -> Column:
    """The first part of the quote that is not on the page; null if all are."""
    page = squeezed(body)
    return F.get(F.filter(quote_chunks(quote), lambda c: ~F.contains(page, c)), F.lit(0))


def quote_on_page(quote: Column, body: Column) -> Column:
    return missing_chunk(quote, body).isNull()


def page_sha(body: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(body, F.lit("")), 256), 1, 16)


def canonical(number: Column) -> Column:
    return F.regexp_replace(F.replace(number, F.lit(","), F.lit("")), r"\.+$", "")


def numbers_in(text: Column) -> Column:
    """Figures that a text states: no fiscal years, no single digits, no years."""
    found = F.transform(_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"\b(?:19|20)\d\d\s*[-/]\s*\d\d\b", " "), NUMBER), canonical)
    return F.filter(found, lambda n: (F.length(F.replace(n, F.lit("."), F.lit(""))) >= 2) & ~F.replace(n, F.lit("."), F.lit("")).rlike(r"^(19\d\d|20\d\d)$"))


def quote_numbers(quote: Column) -> Column:
    return F.array_distinct(F.transform(_all(F.coalesce(quote, F.lit("")), NUMBER), canonical))


def without_citations(answer: Column) -> Column:
    return F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?i)\|[^|\n]*\|\s*p\d+\b|\bp\d+\b", " ")


def citation_path(note: Column) -> Column:
    found = F.regexp_extract(note, r"(?i)\|\s*([^|]+?)\s*\|\s*p(\d+)\s*$", 1)
    return F.when(found != "", found)


def citation_page(note: Column) -> Column:
    return F.regexp_extract(note, r"(?i)\|\s*([^|]+?)\s*\|\s*p(\d+)\s*$", 2).try_cast("int")


def segments(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), "/"), lambda x: x != "")


def tail2(path: Column) -> Column:
    own = segments(path)
    return F.array_join(F.slice(own, F.greatest(F.size(own) - 1, F.lit(1)), F.lit(2)), "/")


def same_path(cited: Column, opened: Column) -> Column:
    """Equal file names, and one parent's name ends with the other's if both have one."""
    a, b = segments(cited), segments(opened)
    up = lambda s: F.get(s, F.size(s) - 2)
    parents = (F.size(a) < 2) | (F.size(b) < 2) | F.endswith(up(a), up(b)) | F.endswith(up(b), up(a))
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.get(a, F.size(a) - 1) == F.get(b, F.size(b) - 1)) & parents


def norm_path(path: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))), r"^(?:\./|/)+", "")


def norm_text(text: Column) -> Column:
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("/")))


def best_line(body: Column, words: Column) -> Column:
    """The line with most of the words, the first of equals, squeezed, at most 200 characters."""
    scored = F.transform(lines(body), lambda line, i: F.struct((-F.size(F.filter(words, lambda w: F.contains(F.lower(line), w)))).alias("n"), i.alias("i"), line.alias("line")))
    return F.substring(F.trim(F.regexp_replace(F.array_min(scored)["line"], r"\s+", " ")), 1, 200)


def why_lines(catalog: Column, words: Column, name: Column) -> Column:
    """The two catalog lines that share most words with the query, or else the title."""
    scored = F.transform(lines(catalog), lambda line, i: F.struct((-F.size(F.array_intersect(content_words(line), words))).alias("n"), i.alias("i"), strip(line).alias("line")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["n"] < 0)), 1, 2)
    return F.when(F.size(best) > 0, F.transform(best, lambda s: s["line"])).otherwise(F.array(name))


def snippet(body: Column, words: Column, size: int = 24) -> Column:
    """The window of this many tokens with most query words, the first of equals; found words are marked.

    For the few pages that are shown: a sliding count over all tokens, which built-in functions would recompute for each window.
    """

    @F.pandas_udf("string")
    def run(bodies: pd.Series, wanted: pd.Series) -> pd.Series:
        fold = str.maketrans(ACCENTED, PLAIN)
        out = []
        for text, own in zip(bodies, wanted):
            found = re.findall(r"[^\W_]+", text or "")
            hit = [t.lower().translate(fold) in set(own) for t in found]
            best = count = sum(hit[:size])
            start = 0
            for i in range(1, len(found) - size + 1):
                count += hit[i + size - 1] - hit[i - 1]
                if count > best:
                    best, start = count, i
            out.append(" ".join(f">>{t}<<" if h else t for t, h in zip(found[start : start + size], hit[start : start + size])))
        return pd.Series(out)

    return run(body, words)


def page_refs(text: Column) -> Column:
    """Page numbers that a text names: p. 12, p12, page 12."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(_all(text, r"(?i)(?<![A-Za-z0-9])p\.?\s?(\d{1,4})(?![0-9-])", 1), _all(text, r"(?i)(?<![A-Za-z0-9])page\s+(\d{1,4})(?![0-9-])", 1))
    return F.transform(found, lambda x: x.cast("int"))


def cited_paths(text: Column) -> Column:
    found = _all(F.coalesce(text, F.lit("")), rf"(?i)[A-Za-z0-9_\-.()\[\]][A-Za-z0-9_\-./\\()\[\] ]{{0,180}}?[/\\][A-Za-z0-9_\-.()\[\] ]{{1,120}}?\.(?:{PATH_EXTENSIONS})")
    return F.filter(F.transform(found, strip), lambda p: F.length(p) > 6)


def sources_lines(text: Column) -> Column:
    """(path, page) of each Sources line."""
    pattern = rf"(?i)\|\s*([^|]*?\.(?:{PATH_EXTENSIONS}))\s*\|\s*p\.?\s?(\d{{1,4}})\b"
    return F.arrays_zip(F.transform(_all(text, pattern, 1), strip).alias("path"), F.transform(_all(text, pattern, 2), lambda x: x.cast("int")).alias("page"))


def has_sources(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return text.rlike(SOURCES_HEAD) | text.rlike(r"(?i)(?<![A-Za-z])sources\s*:")


def prose_after_sources(text: Column) -> Column:
    """Whether ordinary text follows the source lines of the last Sources block."""
    head = r"(?i)^\s*#{0,6}\s*\**\s*sources\s*\**\s*:?\s*$"
    start = F.struct(F.lit(0).alias("seen"), F.lit(False).alias("prose"))

    def step(state: Column, line: Column) -> Column:
        source, blank = line.rlike(r"^\s*(?:[-*]|\d+\.|\|)|\s\|\s"), strip(line) == ""
        seen = F.when(line.rlike(head), 1).when((state["seen"] >= 1) & source & ~blank, 2).otherwise(state["seen"])
        prose = F.when(line.rlike(head), False).otherwise(state["prose"] | ((state["seen"] == 2) & ~source & ~blank))
        return F.struct(seen.alias("seen"), prose.alias("prose"))

    return F.aggregate(lines(text), start, step)["prose"]


def figures_without_citation(text: Column) -> Column:
    """A number with a unit within three tokens, and neither a page nor a Sources block anywhere."""
    own = _all(F.coalesce(text, F.lit("")), r"\S+")
    near = F.exists(F.transform(own, lambda t, i: t.rlike(r"(?<![A-Za-z0-9.,])\d[\d,]*(?:\.\d+)?(?![A-Za-z])") & F.exists(F.slice(own, F.greatest(i - 2, F.lit(1)), i + 4 - F.greatest(i - 3, F.lit(0))), lambda w: w.rlike(UNIT))), lambda x: x)
    return (F.size(page_refs(text)) == 0) & ~has_sources(text) & near


def machinery_words(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_all(F.coalesce(text, F.lit("")), MACHINERY), F.lower)))


def has_header(text: Column, header: str) -> Column:
    return F.startswith(F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"^[`*_ ]+", ""), F.lit(header))


def corpus_key(path: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), 256), 1, 12)


def timeout_budget(size: Column) -> Column:
    """Seconds to read a file of this many bytes."""
    return F.least(F.lit(1800), F.greatest(F.lit(180), (60 + 12 * size / (1 << 20)).cast("int")))

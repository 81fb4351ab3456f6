"""Main text of web pages by template deduction over equivalence classes.

1. Each page is read once as a stream of tokens: elements by signature (tag with class and id words, digits masked) and text chunks. For each
   host and token, the occurrence vector over the host's pages is kept as a linear fingerprint, the sum of count times a
   hash of the page. Equal fingerprints are equal vectors, so tokens of one fingerprint and host form an equivalence class. It is a
   plain aggregate with map-side combine: no task ever holds the pages of a host.
2. A class is valid with at least two elements that occur once on each of its pages, and with `support` pages that are a SHARE of the host's
   pages with any token, so an empty or odd page takes no class from the others. Each element knows the text that lies inside it and
   all text of its pages: of a class, the innermost element that holds MOST of the text is a content slot, or an article or main that
   does. The slots of a host nest; a page uses the deepest that it has. Text chunks of such a class are template, unless they
   are more than the rest of MOST, as on pages that are copies of each other.
3. The content slot of each page is extracted, without nested menus, headers, footers, asides, forms, adverts, notices, comments and scripts. A slot
   inside an article or main stands for that. A page without a slot's element, or a host without a template, uses article, main, or else the
   body. Template chunks go only outside article, main and slots below the body.

Edge cases: a null or empty html has the empty text; a null url is a host of its own kind; unclosed elements end with their parent; pages
that repeat are pages; an empty table gives an empty result; pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import checkpointed

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("head nav footer aside form button select option script style noscript template svg iframe textarea title dialog menu object canvas audio video".split())
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments disqus respond replies reply login signup "
    "search pagination pager toolbar skip complementary contentinfo masthead".split()
)
CONTENT_ORDER = ("article", "main")
CONTENT = frozenset(CONTENT_ORDER)
#: A slot holds at least this share of the text of its pages.
MOST = 0.7
SUPPORT = 3
SHARE = 0.05
#: Pages of a class from which on its text chunks count as template.
TEXT_SUPPORT = 8
BATCH = 256
SALT = 64


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """('open', tag, attributes), ('close', tag, '') and ('text', chunk, '') in page order."""
    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            yield "text", html[at : m.start()], ""
        at = m.end()
        if m[3]:
            yield ("close" if m[2] else "open"), m[3].lower(), m[4] or ""
    if at < len(html):
        yield "text", html[at:], ""


def signature(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's signature, and whether its name says that it is not content."""
    words: list[str] = []
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            words += WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower())
    skipped = tag in SKIPPED or any(w in SKIPPED_WORDS for w in words) and tag not in ("body", "html", *CONTENT)
    return ".".join([tag, *sorted({"0" if w.isdigit() else w for w in words})]) if words else tag, skipped


def walk(html: str) -> Iterator[tuple[str, str, list[tuple[str, str, bool]], bool]]:
    """('element', signature, ...), ('text', chunk, ...) and ('break', '', ...) with the stack of (tag, signature, skipped) and whether it is skipped."""
    stack: list[tuple[str, str, bool]] = []
    skips = 0
    for kind, value, attributes in tokens(html):
        if kind == "text":
            yield "text", value, stack, skips > 0
            continue
        block = value not in INLINE
        if kind == "open":
            if value in CONTENT:
                while skips:
                    skips -= stack.pop()[2]
            elif block and value not in VOID:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] == value and value in ("li", "dt", "dd", "tr", "td", "th", "option"):
                        skips -= sum(x[2] for x in stack[i:])
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            sig, skipped = signature(value, attributes)
            if value == "header":
                skipped = not any(x[0] in CONTENT for x in stack)
            if value not in VOID:
                if not attributes.endswith("/") or not block:
                    stack.append((value, sig, skipped))
                    skips += skipped
            yield ("element" if block else "inline"), sig, stack, skips > 0
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == value:
                    skips -= sum(x[2] for x in stack[i:])
                    del stack[i:]
                    break
                if not block and stack[i][0] not in INLINE:
                    break
            if block:
                yield "break", value, stack, skips > 0


def chunk_key(chunk: str) -> str:
    """A text chunk as a token: its hash."""
    return "#" + xxhash.xxh64_hexdigest(" ".join(chunk.split()).encode("utf-8", "replace"))


def observed(html: str) -> dict[str, tuple[int, int, int]]:
    """For each token of a page: how often it occurs, the characters of content inside it, and its depth; '' is the page."""
    count: Counter[str] = Counter()
    inside: Counter[str] = Counter()
    depth: dict[str, int] = {}
    for kind, value, stack, skipped in walk(html):
        if kind in ("element", "inline"):
            count[value] += 1
            depth.setdefault(value, len(stack))
        elif kind == "text" and not skipped and (n := len(value) - value.count(" ")) and not value.isspace():
            key = chunk_key(value)
            count[key] += 1
            for sig in {key, "", *(x[1] for x in stack)}:
                inside[sig] += n
    if count:
        count[""] = 1
    return {k: (n, inside[k], depth.get(k, 0)) for k, n in count.items()}


def extract(html: str, slots: tuple[str, ...] = (), template: frozenset[str] = frozenset()) -> str:
    """The text of the first slot on the page: blocks in page order, joined by one space."""
    if not html:
        return ""
    keys = [*(("slot", s) for s in slots), *(("tag", t) for t in (*CONTENT_ORDER, "body"))]
    blocks: dict[tuple[str, str], list[list[str]]] = {k: [[]] for k in keys}
    around: dict[str, str] = {}
    for kind, value, stack, skipped in walk(html):
        if kind == "text":
            if not skipped:
                tags, sigs = [x[0] for x in stack], [x[1] for x in stack]
                constant = bool(template) and chunk_key(value) in template and not any(t in CONTENT or s in slots and t not in ("html", "body") for t, s in zip(tags, sigs))
                if constant:
                    continue
                for (how, name), parts in blocks.items():
                    if how == "slot" and name in sigs:
                        outer = tags[: sigs.index(name)]
                        for t in CONTENT_ORDER:
                            if t in outer:
                                around.setdefault(name, t)
                                break
                        parts[-1].append(value)
                    elif how == "tag" and (name == "body" or name in tags):
                        parts[-1].append(value)
        elif kind != "inline":
            for parts in blocks.values():
                if parts[-1]:
                    parts.append([])
    for how, name in keys:
        texts = [" ".join(entities.unescape("".join(b)).split()) for b in blocks[("tag", around[name]) if how == "slot" and name in around else (how, name)]]
        if joined := " ".join(t for t in texts if t):
            return joined
    return extract(html, slots) if template else ""


def templates(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(host, slots, template): the signatures of the content slots, deepest first, and the text chunks of the template."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                out: list[list] = [[] for _ in range(7)]
                for host, mark, html in zip(*(part.column(c).to_pylist() for c in ("host", "mark", "html"))):
                    seen = observed(html or "")
                    for token, (n, size, depth) in seen.items():
                        for column, value in zip(out, (host, token, n * mark, size, seen[""][1], depth, int(n == 1))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(out)], ["host", "token", "vector", "inside", "whole", "depth", "once"])

    mark = F.xxhash64("url", "page_id", "html").bitwiseAND(F.lit((1 << 40) - 1))
    seen = pages.select("host", mark.alias("mark"), "html").mapInArrow(run, "host string, token string, vector long, inside long, whole long, depth long, once long")
    sums = [F.sum(c).alias(c) for c in ("inside", "whole", "depth", "once")]
    tokens_ = checkpointed(seen.groupBy("host", "token").agg(F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), *sums, F.count("*").alias("pages")).where(F.col("pages") >= support))
    all_pages = tokens_.where("token = ''").select("host", F.col("pages").alias("n"))
    once = tokens_.where("token <> '' and once = pages").join(all_pages, "host").where(F.col("pages") >= SHARE * F.col("n"))
    element, chunk = F.expr("token not like '#%'"), F.expr(f"token like '#%' and pages >= {TEXT_SUPPORT}")
    content = F.substring_index("token", ".", 1).isin(*CONTENT)
    # the least of: an article or main before others, less text inside, deeper, name
    order = F.struct(F.when(content, 0).otherwise(1).alias("other"), "inside", (-F.col("depth")).alias("up"), "token")
    classes = (
        once.groupBy("host", "vector", "pages")
        .agg(F.count_if(element).alias("size"), F.min(F.when(element & (F.col("whole") > 0) & (F.col("inside") >= MOST * F.col("whole")), order)).alias("slot"), F.sum(F.when(chunk, F.col("inside")).otherwise(0)).alias("fixed"), F.max("whole").alias("whole"), F.collect_set(F.when(chunk, F.col("token"))).alias("texts"))
        .where("size >= 2 and slot is not null")
    )
    texts = F.when(F.col("fixed") <= (1 - MOST) * F.col("whole"), F.col("texts")).otherwise(F.array().cast("array<string>"))
    nested = classes.select("host", F.struct((F.col("slot.up") / F.col("pages")).alias("up"), (-F.col("pages")).alias("fewer"), F.col("slot.token").alias("token")).alias("slot"), texts.alias("texts"))
    return nested.groupBy("host").agg(F.transform(F.sort_array(F.collect_list("slot")), lambda x: x["token"]).alias("slots"), F.array_distinct(F.flatten(F.collect_list("texts"))).alias("template"))


def main_text(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    # one host may have a third of all pages: its template, a row, is joined in SALT parts
    salted = templates(base, support).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    known = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "slots", "template")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                texts = [extract(h or "", tuple(s or ()), frozenset(t or ())) for h, s, t in zip(*(part.column(c).to_pylist() for c in ("html", "slots", "template")))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return known.mapInArrow(run, "page_id long, url string, text string, n_chars long")

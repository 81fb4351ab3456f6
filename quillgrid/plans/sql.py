"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from ..functions import text as T
from ..sources import derived

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"
FILLER = "[" + ", ".join(f"'{w}'" for w in T.FILLER) + "]"
FY = r"(20[0-3]\d-\d\d)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(translate(lower({x}), '{T.ACCENTED}', '{T.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


def distinct(x: str) -> str:
    """The distinct elements of a list, first occurrences in order."""
    return f"list_filter({x}, lambda dx, di: list_position({x}, dx) = di)"


def content_words(x: str) -> str:
    own = f"list_filter(regexp_extract_all(lower({x}), '[A-Za-z0-9_\\-]+'), lambda t: length(t) >= 2 AND NOT list_contains({STOP}, t))"
    return distinct(own)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squeezed(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def family(title: str, fy: str, years: bool = False) -> str:
    """Separators are doubled around markers, as this engine's expressions have no look-behind."""
    markers = T.MARKERS.replace(r"\(", r"\(\(").replace(r"\)", r"\)\)").replace("use this one", "use  this  one")
    x = f"replace(lower({title}), coalesce({fy}, chr(1)), '{{fy}}')"
    if years:
        x = f"regexp_replace({x}, '\\b(19|20)\\d\\d\\b', '{{yr}}', 'g')"
    y = f"' ' || regexp_replace(replace({x}, ')(', ') ('), '([^a-z0-9])', '\\1\\1', 'g') || ' '"
    z = f"regexp_replace({y}, '([^a-z0-9])({markers})([^a-z0-9])', '\\1 \\3', 'g')"
    return f"replace(replace(trim(regexp_replace(regexp_replace({z}, '[^a-z0-9{{}}]+', ' ', 'g'), '\\s+', ' ', 'g')), '{{{{', '{{'), '}}}}', '}}')"


def words(queries: str, expr: str = "", name: str = "terms") -> str:
    """CTE name(qid, toks, term): the words of each query that have a token, each as its tokens side by side; content words unless expr lists others."""
    own = expr or content_words("query")
    return f"{name} AS (SELECT qid, toks, array_to_string(toks, ' ') AS term FROM (SELECT qid, unnest(list_transform({own}, lambda w: {tokens('w')})) AS toks FROM {queries}) {name}_w WHERE len(toks) > 0)"


def bm25(docs: str, key: str, fields: dict[str, float], queries: str, scope: str | None = None, prefix: str = "", expr: str = "", also: tuple[str, ...] = ()) -> str:
    """CTEs for hits(qid, key, score, n_terms); docs and queries (qid, query) are given as CTEs or tables. Sizes count the fields in `also` too.

    Places of a phrase are counted in a string that has two spaces between tokens, so that one place does not take the next one's space; a phrase
    that overlaps itself would be counted once.
    """
    s, on = (f"{scope}, ", f"AND x.{scope} = y.{scope}") if scope else ("", "")
    parts = " UNION ALL ".join(f"SELECT {key}, t, concat(' ', array_to_string(t, '  '), ' ') AS p, {w} AS w FROM (SELECT {key}, {tokens(c)} AS t FROM {docs}) own" for c, w in fields.items())
    size = " + ".join(f"len({tokens(c)})" for c in (*fields, *also))
    stats = f"SELECT {s}count(*) AS docs, avg(dl) AS avgdl FROM {prefix}size" + (f" GROUP BY {scope}" if scope else "")
    return f"""{words(queries, expr, prefix + "terms")},
{prefix}size AS (SELECT {key}, {size} AS dl FROM {docs}),
{prefix}stats AS ({stats}),
{prefix}parts AS MATERIALIZED ({parts}),
{prefix}post AS (SELECT {key}, term, sum(w) AS f FROM (SELECT {key}, unnest(t) AS term, w FROM {prefix}parts) p WHERE term IN (SELECT term FROM {prefix}terms WHERE len(toks) = 1) GROUP BY ALL
  UNION ALL SELECT {key}, term, sum(w * (len(string_split(p, ph)) - 1)) FROM {prefix}parts JOIN (SELECT DISTINCT term, concat(' ', array_to_string(toks, '  '), ' ') AS ph FROM {prefix}terms WHERE len(toks) > 1) m ON contains(p, ph) GROUP BY ALL),
{prefix}df AS (SELECT {s}term, count(*) AS df FROM {prefix}post GROUP BY ALL),
{prefix}hits AS (SELECT qid, {", ".join("x." + k.strip() for k in key.split(","))}, count(*) AS n_terms,
  sum(CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {prefix}post x JOIN {prefix}terms t USING (term) JOIN {prefix}df y ON x.term = y.term {on} JOIN {prefix}size z ON {" AND ".join(f"x.{k.strip()} = z.{k.strip()}" for k in key.split(","))}
  JOIN {prefix}stats w ON {f"x.{scope} = w.{scope}" if scope else "true"} GROUP BY ALL)"""


def label_words(x: str) -> str:
    return f"list_filter({content_words(f"regexp_replace({x}, '{FY}', ' ', 'g')")}, lambda lw: NOT list_contains({FILLER}, lw))"


def vectors(docs: str, key: str, text: str, name: str) -> str:
    """CTEs name(key, axis, w) and name_norm(key, norm): the default embedding as sparse rows."""
    return f"""{name} AS (SELECT {key}, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS INTEGER) AS axis, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END) AS w FROM (SELECT {key}, unnest({tokens(text)}) AS term FROM {docs}) {name}_t GROUP BY ALL),
{name}_norm AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {name} GROUP BY ALL)"""


def top(hits: str, k: int, key: str, by: str = "qid") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, {key}) AS rank FROM {hits} QUALIFY rank <= {k}"


CORPUS = derived.SQL

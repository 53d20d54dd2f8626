"""Queries of full-text search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import load
from ..functions import text as T
from ..operators import search as S

_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_PAGES = f"""WITH own AS (SELECT book_id, page, source, {_TRIM.format('text')} AS original_text, row_number() OVER (PARTITION BY book_id, page ORDER BY indexed_at DESC NULLS LAST, doc_id DESC) AS rn FROM documents WHERE book_id IS NOT NULL AND page IS NOT NULL),
pages AS (SELECT book_id, page, source, original_text FROM own WHERE rn = 1 AND length(original_text) > 0),
tok AS (SELECT *, ' ' || trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(original_text)), '\\p{{M}}+', '', 'g'), '([\\x{{3400}}-\\x{{9FFF}}])', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS tokens FROM pages)"""


def _snippet(query: str) -> str:
    first = query.replace('"', " ").split()[0]
    n = len(query)
    return f"""CASE WHEN pos = 0 THEN substr(original_text, 1, 60) ELSE (CASE WHEN greatest(pos - 31, 0) > 0 THEN '…' ELSE '' END) || substr(original_text, greatest(pos - 31, 0) + 1, least(pos - 1 + {n} + 30, length(original_text)) - greatest(pos - 31, 0)) || (CASE WHEN pos - 1 + {n} + 30 < length(original_text) THEN '…' ELSE '' END) END AS snippet
FROM (SELECT *, CASE WHEN strpos(original_text, '{query}') > 0 THEN strpos(original_text, '{query}') ELSE strpos(original_text, '{first}') END AS pos FROM hits)"""


def _sql(query: str, where: str) -> str:
    return f"{_PAGES}, hits AS (SELECT * FROM tok WHERE {where} ORDER BY book_id, page LIMIT 200) SELECT book_id, page, {_snippet(query)}"


def search_and_snippet(s, d):
    return S.search_documents(load(s, d, "documents"), "tide register")


def search_phrase(s, d):
    return S.search_documents(load(s, d, "documents"), "half-tide dock")


def search_injection_literal(s, d):
    return S.search_documents(load(s, d, "documents"), 'map" OR')


def search_ideographs(s, d):
    return S.search_documents(load(s, d, "documents"), "潮汐登记册")


def search_accents(s, d):
    return S.search_documents(load(s, d, "documents"), "fälle")


def search_empty(s, d):
    return S.search_documents(load(s, d, "documents"), ' "" -- ')


def search_all_matches(s, d):
    """Every page of the corpus that matches, without the report's limit."""
    return S.matching(load(s, d, "documents"), "salt road").select("book_id", "page")


def search_by_postings(s, d):
    return S.search_postings(S.postings(S.pages(load(s, d, "documents"))), "half-tide dock map")


def postings_frequencies(s, d):
    return S.postings(S.pages(load(s, d, "documents"))).groupBy("token").agg(F.count("*").alias("pages"), F.sum(F.size("positions")).cast("long").alias("places"))


def page_text_latest(s, d):
    return S.pages(load(s, d, "documents")).select("book_id", "page", "source", F.length("original_text").cast("long").alias("chars"), F.md5("original_text").alias("digest"))


def page_has_text(s, d):
    return load(s, d, "documents").select("doc_id", T.has_text(F.col("text")).alias("has_text"))


def indexed_page_count(s, d):
    return S.pages(load(s, d, "documents")).groupBy("book_id").agg(F.count("*").alias("pages"))


def search_hits_by_book(s, d):
    hits = load(s, d, "search_hits").dropDuplicates(["hit_id"])
    g = S.hits_by_book(hits, load(s, d, "books"))
    return g.select("book_id", "title", F.size("hits").cast("long").alias("hits"), F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["page"], h["hit_id"])), ",").alias("places"))


def search_occurrences(s, d):
    """Where the words "the" stand in each snippet: non-overlapping, case aside."""
    at = T.occurrences(F.col("snippet"), "the")
    return load(s, d, "search_hits").dropDuplicates(["hit_id"]).select("hit_id", F.size(at).cast("long").alias("n"), F.array_join(at, ",").alias("offsets"))


def snippet_ignore_case(s, d):
    return load(s, d, "search_hits").dropDuplicates(["hit_id"]).select("hit_id", T.snippet(F.col("snippet"), "the ", ignore_case=True).alias("head"))


QUERIES = {
    "search_and_snippet": (search_and_snippet, _sql("tide register", "contains(tokens, ' tide ') AND contains(tokens, ' register ')")),
    "search_phrase": (search_phrase, _sql("half-tide dock", "contains(tokens, ' half tide ') AND contains(tokens, ' dock ')")),
    "search_injection_literal": (
        search_injection_literal,
        f"{_PAGES}, hits AS (SELECT * FROM tok WHERE contains(tokens, ' map ') AND contains(tokens, ' or ') ORDER BY book_id, page LIMIT 200) SELECT book_id, page, " + _snippet('map" OR')
    ),
    "search_ideographs": (search_ideographs, _sql("潮汐登记册", "contains(tokens, ' 潮 汐 登 记 册 ') OR contains(regexp_replace(tokens, ' +', ' ', 'g'), ' 潮 汐 登 记 册 ')")),
    "search_accents": (search_accents, _sql("fälle", "contains(tokens, ' falle ')")),
    "search_empty": (search_empty, f"{_PAGES} SELECT book_id, page, original_text AS snippet FROM tok WHERE false"),
    "search_all_matches": (search_all_matches, f"{_PAGES} SELECT book_id, page FROM tok WHERE contains(tokens, ' salt ') AND contains(tokens, ' road ')"),
    "search_by_postings": (search_by_postings, f"{_PAGES} SELECT book_id, page FROM tok WHERE contains(tokens, ' half tide ') AND contains(tokens, ' dock ') AND contains(tokens, ' map ')"),
    "postings_frequencies": (
        postings_frequencies,
        f"{_PAGES}, t AS (SELECT book_id, page, unnest(list_filter(string_split(tokens, ' '), lambda x: x <> '')) AS token FROM tok) SELECT token, count(DISTINCT (book_id, page)) AS pages, count(*) AS places FROM t GROUP BY 1"
    ),
    "page_text_latest": (page_text_latest, f"{_PAGES} SELECT book_id, page, source, length(original_text) AS chars, md5(original_text) AS digest FROM pages"),
    "page_has_text": (page_has_text, f"SELECT doc_id, coalesce(length({_TRIM.format('text')}) > 0, false) AS has_text FROM documents"),
    "indexed_page_count": (indexed_page_count, f"{_PAGES} SELECT book_id, count(*) AS pages FROM pages GROUP BY 1"),
    "search_hits_by_book": (
        search_hits_by_book,
        "WITH h AS (SELECT DISTINCT hit_id, book_id, page FROM search_hits) SELECT h.book_id, coalesce(max(b.title), '#' || h.book_id) AS title, count(*) AS hits, string_agg(h.page || ':' || h.hit_id, ',' ORDER BY h.page, h.hit_id) AS places FROM h LEFT JOIN books b ON h.book_id = b.id GROUP BY h.book_id"
    ),
    "search_occurrences": (
        search_occurrences,
        """WITH RECURSIVE h AS (SELECT DISTINCT hit_id, lower(snippet) AS t FROM search_hits), r AS (SELECT hit_id, t, strpos(t, 'the') AS pos FROM h UNION ALL SELECT hit_id, t, pos + 2 + strpos(substr(t, pos + 3), 'the') FROM r WHERE pos > 0 AND strpos(substr(t, pos + 3), 'the') > 0)
SELECT hit_id, count(*) FILTER (WHERE pos > 0) AS n, coalesce(string_agg(pos - 1, ',' ORDER BY pos) FILTER (WHERE pos > 0), '') AS offsets FROM r GROUP BY 1""",
    ),
    "snippet_ignore_case": (
        snippet_ignore_case,
        f"WITH hits AS (SELECT DISTINCT hit_id, {_TRIM.format('snippet')} AS original_text FROM search_hits), p AS (SELECT *, strpos(lower(original_text), 'the') AS pos FROM hits) SELECT hit_id, CASE WHEN pos = 0 THEN substr(original_text, 1, 60) ELSE (CASE WHEN pos > 31 THEN '…' ELSE '' END) || substr(original_text, greatest(pos - 31, 0) + 1, least(pos + 32, length(original_text)) - greatest(pos - 31, 0)) || (CASE WHEN pos + 32 < length(original_text) THEN '…' ELSE '' END) END AS head FROM p",
    ),
}

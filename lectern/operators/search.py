"""Full-text search: pages, postings, phrases and snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from .tables import latest

LIMIT, MOST = 200, 500


#: What the rows of a page are ordered by, of which the last counts; the hash decides between rows that tie in all else.
ORDER = ["indexed_at", "doc_id", "_tie"]


def _own(documents: DataFrame) -> DataFrame:
    return documents.where("book_id IS NOT NULL AND page IS NOT NULL").select("book_id", "page", "source", "text", "indexed_at", "doc_id", F.xxhash64("source", "text").alias("_tie"))


def pages(documents: DataFrame) -> DataFrame:
    """(book_id, page, source, original_text): of each page the text that was indexed last, blank ones left out."""
    own = _own(documents).withColumn("original_text", T.trim_white(F.col("text"))).drop("text")
    return latest(own, ["book_id", "page"], ORDER).where(T.has_text(F.col("original_text"))).select("book_id", "page", "source", "original_text")


def matching(documents: DataFrame, query: str) -> DataFrame:
    """(book_id, page, original_text): ``match`` on ``pages``, with texts read where they lie: only those that match are shuffled, and joined with the keys
    of each page's last row, which hold no text."""
    hits = match(_own(documents), query, "text")
    last = _own(documents).groupBy("book_id", "page").agg(F.max(F.struct(*ORDER)).alias("_last")).select(F.col("book_id").alias("_b"), F.col("page").alias("_p"), "_last")
    same = [F.col("book_id") == F.col("_b"), F.col("page") == F.col("_p"), F.struct(*ORDER).eqNullSafe(F.col("_last"))]
    return hits.join(last, same, "left_semi").dropDuplicates(["book_id", "page"]).select("book_id", "page", T.trim_white(F.col("text")).alias("original_text"))


def clamp_limit(limit: int | None) -> int:
    return max(1, min(MOST, LIMIT if limit is None else limit))


def match(df: DataFrame, query: str, col: str = "original_text") -> DataFrame:
    """Rows whose text has all phrases of the query, in any order; no row for a query without any.

    A scan: texts without the tokens are passed over by plain search, the others are split into tokens, and nothing is shuffled.
    """
    wanted = list(dict.fromkeys(T.phrases(query)))
    if not wanted:
        return df.limit(0)
    tokens = T.token_text(F.col(col))
    some = T.may_have(F.col(col), sorted({t for p in wanted for t in p.split()}))
    return df.where(some).where(reduce(lambda a, b: a & b, [F.contains(tokens, F.lit(f" {p} ")) for p in wanted]))


def _report(hits: DataFrame, query: str, limit: int | None) -> DataFrame:
    return hits.orderBy("book_id", "page").limit(clamp_limit(limit)).select("book_id", "page", T.snippet(F.col("original_text"), query).alias("snippet"))


def search(df: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(book_id, page, snippet): the first hits among pages, in order of book and page."""
    return _report(match(df, query), query, limit)


def search_documents(documents: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """``search`` on the pages of documents."""
    return _report(matching(documents, query), query, limit)


def postings(df: DataFrame, col: str = "original_text") -> DataFrame:
    """(token, book_id, page, positions): the positional index; written partitioned by a hash of the token it answers a query by a few files."""
    tokens = F.filter(F.split(T.token_text(F.col(col)), " "), lambda t: t != "")
    rows = df.select("book_id", "page", F.posexplode(tokens).alias("pos", "token"))
    return rows.groupBy("token", "book_id", "page").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def search_postings(index: DataFrame, query: str) -> DataFrame:
    """(book_id, page): pages with all phrases, from the postings of the query's tokens alone."""
    wanted = [p.split() for p in dict.fromkeys(T.phrases(query))]
    if not wanted:
        return index.select("book_id", "page").limit(0)
    tokens = sorted({t for p in wanted for t in p})
    some = index.where(F.col("token").isin(tokens)).groupBy("book_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at"))
    has_all = F.size("at") == len(tokens)

    def adjacent(phrase: list[str]):
        first = F.col("at")[phrase[0]]
        return F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.col("at")[t], p + i) for i, t in enumerate(phrase)]))

    return some.where(has_all & reduce(lambda a, b: a & b, map(adjacent, wanted))).select("book_id", "page")


def hits_by_book(hits: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, title, hits): each book's hits in order of page; a book that is gone is labelled by its number."""
    grouped = hits.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("page", "hit_id", "snippet"))).alias("hits"))
    named = grouped.join(books.select(F.col("id").alias("book_id"), "title"), "book_id", "left")
    return named.select("book_id", F.coalesce("title", F.concat(F.lit("#"), F.col("book_id"))).alias("title"), "hits")

"""Scalar text functions, all as built-in expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, functions as F

WHITE = r"\s\p{Z}"
SNIPPET_HALF = 30
ERROR_LIMIT = 600


def trim_white(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+$", "")


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(trim_white(text)) > 0, F.lit(False))


def blank_to(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(trim_white(text), F.lit("")), F.lit(default))


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the same without: a rule of Unicode's decompositions."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(i))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _accents()


def fold(text: Column) -> Column:
    """Lower case, Latin letters without their marks, combining marks removed."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"\p{M}+", "")


def may_have(text: Column, tokens: list[str]) -> Column:
    """False only for texts that can't have all the tokens, with marks on their letters or without: one search of the text as it is, much cheaper than ``fold``."""

    def shape(token: str) -> str:
        return "".join(f"[{re.escape(c)}{''.join(m for m, p in zip(_MARKED, _PLAIN) if p == c)}]\\p{{M}}*+" for c in token)

    return reduce(lambda a, b: a & b, [F.lower(text).rlike(shape(t)) for t in tokens])


def token_text(text: Column) -> Column:
    """Tokens joined by blanks, with one at either end: runs of letters and digits, each ideograph a token of its own."""
    spaced = F.regexp_replace(fold(text), r"([\x{3400}-\x{9FFF}])", " $1 ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def phrases(query: str | None) -> list[str]:
    """The phrases of a query, all of which a page must have: one for each word between blanks, quotes ignored, without words of marks alone."""
    out = []
    for word in (query or "").replace('"', " ").split():
        plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
        plain = "".join(f" {c} " if "㐀" <= c <= "鿿" else c if unicodedata.category(c)[0] in "LN" else " " for c in plain)
        if plain.split():
            out.append(" ".join(plain.split()))
    return out


def snippet(text: Column, query: str, ignore_case: bool = False) -> Column:
    """The text around the first place of the query, else of its first token, else the text's head; ellipses where it is cut."""
    body = trim_white(text)
    seen = F.lower(body) if ignore_case else body
    query = query.strip()
    first = next((w for w in query.replace('"', " ").split()), "")
    at = F.coalesce(*(F.nullif(F.locate(x.lower() if ignore_case else x, seen), F.lit(0)) for x in dict.fromkeys([query, first]) if x), F.lit(None).cast("int"))
    start = F.greatest(at - 1 - SNIPPET_HALF, F.lit(0))
    end = F.least(at - 1 + len(query) + SNIPPET_HALF, F.length(body))
    window = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(body, start + 1, end - start), F.when(end < F.length(body), "…").otherwise(""))
    return F.when(at.isNull(), F.substring(body, 1, 2 * SNIPPET_HALF)).otherwise(window)


def occurrences(text: Column, query: str) -> Column:
    """0-based offsets of the query's places in the text, case aside, none overlapping another."""
    query = query.lower()
    if not query:
        return F.array().cast("array<int>")
    parts = F.split(F.lower(text), "\\Q" + query + "\\E", -1)
    step = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p) + len(query))
    return F.transform(step, lambda _, i: F.aggregate(F.slice(step, 1, i + 1), F.lit(0), lambda a, x: a + x) - len(query))


def error_text(text: Column) -> Column:
    """Without a leading "Exception:"."""
    return F.regexp_replace(text, r"^Exception:", "")


def http_error(status: Column, body: Column) -> Column:
    """A failed request's status with at most ERROR_LIMIT characters of its body."""
    return F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), F.substring(F.coalesce(body, F.lit("")), 1, ERROR_LIMIT))


def endpoint(url: Column, default: str) -> Column:
    """The trimmed address without slashes at its end, or the default."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(url), "/+$", ""), F.lit("")), F.lit(default))


def search_endpoint(url: Column, default: str) -> Column:
    """The whole address of a web search, or the default."""
    return endpoint(url, default)


def responses_endpoint(url: Column, default: str) -> Column:
    return F.concat(F.regexp_replace(endpoint(url, default), "/v1$", ""), F.lit("/responses"))


def data_url(png: Column) -> Column:
    """Bytes as a data address; without the line breaks that base64 puts in."""
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), r"[\r\n]", ""))


def minute(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm")


def file_stamp(time: Column, width: Column, height: Column) -> Column:
    return F.format_string("shot_%s_%dx%d.png", F.date_format(time, "yyyyMMdd_HHmmss"), width, height)

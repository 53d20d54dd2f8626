"""All queries of the core, by name, with their oracle SQL."""

from __future__ import annotations

from .plans import interface, library, pages, reader, search, streams, talk

_ALL = library.QUERIES | search.QUERIES | talk.QUERIES | pages.QUERIES | streams.QUERIES | reader.QUERIES | interface.QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """Queries without SQL are left out; they are tested against brute force."""
    return {name: sql for name, (_, sql) in _ALL.items() if sql}

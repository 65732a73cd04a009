"""Tokens, snippets and match scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def contains_all(text: Column, query: str) -> Column:
    """All words of the query are tokens of the text; a quoted query is a phrase."""
    if query.startswith('"') and query.endswith('"'):
        return F.lower(text).contains(query[1:-1].lower())
    words = query.lower().split()
    have = tokens(text)
    return F.coalesce(sum((F.array_contains(have, w).cast("int") for w in words), F.lit(0)) == len(words), F.lit(False))


def boolean(fields: dict[str, Column], must: list[str] = (), should: list[str] = (), must_not: list[str] = ()) -> Column:
    """Whether a document's fields satisfy a boolean search.

    A term is a word, a "quoted phrase", or field:term for one field; else any field may hold it. All of ``must`` hold, at
    least one of ``should`` if there is no ``must``, and none of ``must_not``.
    """

    def holds(term: str) -> Column:
        name, _, rest = term.partition(":")
        asked = [fields[name]] if rest and name in fields else list(fields.values())
        word = rest if rest and name in fields else term
        hits = [contains_all(c, word) for c in asked]
        return F.coalesce(F.greatest(*hits) if len(hits) > 1 else hits[0], F.lit(False))

    out = F.lit(True)
    for term in must:
        out &= holds(term)
    if should and not must:
        out &= F.greatest(F.lit(False), *map(holds, should))
    for term in must_not:
        out &= ~holds(term)
    return out


def snippet(text: Column, term: str, width: int = 60) -> Column:
    """Text around the first hit of the term, with the hit in <b>; null without one."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - F.lit(width // 2), F.lit(1))
    piece = F.substring(text, start, F.lit(width))
    return F.when(at > 0, F.regexp_replace(piece, f"(?i)({term})", "<b>$1</b>"))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the lower-case text."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))


def local_name(iri: Column) -> Column:
    """The last segment after '/', else after '#'."""
    return F.when(iri.contains("/"), F.element_at(F.split(iri, "/"), -1)).otherwise(F.element_at(F.split(iri, "#"), -1))

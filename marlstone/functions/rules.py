"""Rules for the fields of requests and records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: published request bounds, the form of an id, failure labels and the mark of no genre
MOST_K = {"engine": 512, "pilot": 50, "account": 20}
MOST_RETRIEVED = 65_536
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
FAILURES = {"55P03": "lock_timeout", "57014": "query_cancelled", "40001": "serialization", "40P01": "deadlock"}
NO_GENRES = "(no genres listed)"


def request_fault(k: Column, retrieved: Column, timeout_ms: Column, service: str = "engine") -> Column:
    """Why a request is out of bounds, or null; a null value is out of bounds."""
    inside = lambda c, low, high: F.coalesce(c.between(low, high), F.lit(False))
    return F.when(~inside(k, 1, MOST_K[service]), "bad_k").when(~inside(retrieved, 1, MOST_RETRIEVED), "bad_retrieve").when(~F.coalesce(timeout_ms > 0, F.lit(False)), "bad_timeout")


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def is_identifier(c: Column) -> Column:
    """1 to 128 characters, none of them a space or control character (below 33)."""
    return F.coalesce((F.char_length(c) <= 128) & c.rlike(r"\A[^\x00-\x20]+\z"), F.lit(False))


def canonical(columns: list[str]) -> Column:
    """The columns as JSON without spaces, by names in order; nulls stay as null."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def folded(email: Column) -> Column:
    return F.lower(email)


def failure_reason(state: Column, invalidated: Column, pool_timeout: Column) -> Column:
    """One of a few labels for a database failure: never its text."""
    found = F.when(pool_timeout, "pool_timeout")
    for code, label in FAILURES.items():
        found = found.when(state == code, label)
    return found.when(invalidated | state.startswith("08"), "connection").otherwise("other")


def genre_label(genres: Column) -> Column:
    """The first two named genres."""
    return F.array_join(F.slice(F.filter(genres, lambda g: g != NO_GENRES), 1, 2), " / ")


def plain_title(title: Column) -> Column:
    """A title without its trailing year."""
    return F.regexp_replace(title, r"\s*\(\d{4}\)$", "")

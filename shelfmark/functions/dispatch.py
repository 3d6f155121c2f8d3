"""Per-collection values looked up by substring of the collection name, under three policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import tables as T


def _lit(value) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def _holds(name: Column, key: str) -> Column:
    return F.lower(name).contains(key.lower())


def first_match(name: Column, table: dict, default=None) -> Column:
    """Value of the first key, in table order, that occurs in the name."""
    out = None
    for key, value in table.items():
        out = F.when(_holds(name, key), _lit(value)) if out is None else out.when(_holds(name, key), _lit(value))
    return out if default is None else out.otherwise(_lit(default))


def longest_match(name: Column, table: dict, default=None) -> Column:
    """Value of the longest key that occurs in the name."""
    return first_match(name, dict(sorted(table.items(), key=lambda kv: -len(kv[0]))), default)


def all_matches(name: Column, table: dict) -> Column:
    """Values of every key that occurs in the name, in table order."""
    hits = [F.when(_holds(name, key), _lit(value)) for key, value in table.items()]
    return F.filter(F.array(*hits), lambda v: v.isNotNull())


def accepted_types(collection: Column, longest: bool = False) -> Column:
    """Member types a collection accepts (with dot); NULL when it has no list."""
    return (longest_match if longest else first_match)(collection, T.MEMBER_TYPES)


def plan_rules(collection: Column) -> Column:
    return longest_match(collection, T.PLAN_RULES, T.DEFAULT_RULES)


def swaps_bytes(catalog_name: Column) -> Column:
    return F.size(all_matches(catalog_name, {k: k for k in T.BYTE_ORDER_CATALOGS})) > 0

"""Source lists: (path, collection) pairs and the collections they introduce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def sources(*lists: DataFrame) -> DataFrame:
    """All configured (path, collection) pairs, each once."""
    return reduce(DataFrame.unionByName, [x.select("path", "collection") for x in lists]).distinct()


def new_collections(existing: DataFrame, *lists: DataFrame) -> DataFrame:
    """Collections a source list names that are not known yet."""
    return sources(*lists).select("collection").distinct().join(existing.select("collection"), "collection", "left_anti")


def with_new_collections(existing: DataFrame, *lists: DataFrame) -> DataFrame:
    return existing.select("collection").unionByName(new_collections(existing, *lists))


def catalog_collections(registry: DataFrame) -> DataFrame:
    return registry.select("collection").distinct()

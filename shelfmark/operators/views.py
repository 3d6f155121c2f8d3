"""Result views: filters, facets, sorting, counts and file details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.functions import tables as T
from shelfmark.operators.members import member_rows


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _passes(values: dict[str, list[str]]) -> Column:
    return reduce(lambda a, b: a & b, [_text(c).isin(list(v)) for c, v in values.items()], F.lit(True))


def value_filter(rows: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """Rows whose columns all hold one of the chosen values; NULL counts as ''."""
    return rows.filter(_passes(values))


def text_filter(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Rows whose columns contain the trimmed text, ignoring case; a blank text is off."""
    for column, text in texts.items():
        wanted = (text or "").strip().lower()
        if wanted:
            rows = rows.filter(F.lower(_text(column)).contains(wanted))
    return rows


def facets(rows: DataFrame, columns: list[str], values: dict[str, list[str]]) -> DataFrame:
    """(facet, value) under the value filters of all other columns, every facet in one pass."""
    items = [
        F.when(
            _passes({c: v for c, v in values.items() if c != column}),
            F.struct(F.lit(column).alias("facet"), _text(column).alias("value")),
        )
        for column in columns
    ]
    return rows.select(F.explode(F.array_compact(F.array(*items))).alias("f")).select("f.*").distinct()


def default_view(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status").isin(T.DEFAULT_VIEW))


def focus_view(rows: DataFrame, analysed: DataFrame) -> DataFrame:
    """Rows described like any row of an analysed file. ``analysed``: collection, file_name."""
    said = (
        rows.join(analysed.select("collection", "file_name").distinct(), ["collection", "file_name"], "left_semi")
        .select("collection", _text("description").alias("_said")).distinct()
    )
    return (
        rows.filter(F.col("status").isin(T.FOCUS_VIEW)).withColumn("_said", _text("description"))
        .join(said, ["collection", "_said"], "left_semi").drop("_said")
    )


def analysed_only(rows: DataFrame) -> DataFrame:
    return rows.filter((_text("status") != "") & (F.col("status") != "unverified"))


def skipped_count(rows: DataFrame) -> DataFrame:
    open_row = (_text("status") == "") | (F.col("status") == "unverified")
    return rows.groupBy("collection").agg(
        F.count_if(~open_row).alias("n_queued"), F.count_if(open_row).alias("n_skipped"))


def sort_keys(column: str) -> list[Column]:
    """Numeric-aware order: values that begin with a number by that number, then the others as text."""
    number = F.regexp_extract(_text(column), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    value = F.when(number != "", number.cast("double"))
    return [value.isNull().alias("is_text"), value.alias("number"), F.lower(_text(column)).alias("text_key")]


def natural_sort(rows: DataFrame, column: str, pos: str, ascending: bool = True) -> DataFrame:
    is_text, number, text = sort_keys(column)
    keyed = rows.withColumns({"is_text": is_text, "number": number, "text_key": text})
    order = ["is_text", "number", "text_key"]
    return keyed.orderBy(*[F.asc(c) if ascending else F.desc(c) for c in order], pos)


def bucket() -> Column:
    return F.when(F.col("status") == "missing", "missing").when(
        F.col("status") == "unmatched", "unmatched").otherwise("owned")


def view_rows(rows: DataFrame, view: str = "owned") -> DataFrame:
    """owned (with unmatched), missing or all; ``view_ord`` gives the order of the parts."""
    part = rows.withColumn("view", bucket()).withColumn(
        "view_ord", F.when(F.col("view") == "owned", 1).when(F.col("view") == "unmatched", 2).otherwise(3))
    if view == "missing":
        return part.filter(F.col("view") == "missing")
    return part if view == "all" else part.filter(F.col("view") != "missing")


def view_counts(rows: DataFrame) -> DataFrame:
    view = bucket()
    return rows.groupBy("collection").agg(
        F.count_if(view == "owned").alias("owned_count"), F.count_if(view == "unmatched").alias("unmatched_count"),
        F.count_if(view == "missing").alias("missing_count"), F.count(F.lit(1)).alias("total_count"),
    )


def status_summary(rows: DataFrame) -> DataFrame:
    known = ["ok", "unverified", "missing", "bad_dump"]
    shown = F.when(F.col("status").isin(known), F.col("status")).otherwise("other")
    counts = rows.withColumn("bucket", shown).groupBy("collection").pivot("bucket", [*known, "other"]).agg(F.count(F.lit(1)))
    return counts.fillna(0)


def overview(collections: DataFrame, catalogs: DataFrame, directories: DataFrame, results: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(metric, value): sizes of the four tables, the number of stale collections, and, given ``runs`` (finished), when the last one ended.

    That time is in microseconds since 1970, NULL when nothing has run yet.
    """
    def count(df, metric):
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), "value")

    parts = [
        count(collections, "collections"), count(catalogs, "catalogs"), count(directories, "directories"),
        count(results, "results"), count(stale_collections(results, directories), "stale_collections"),
    ]
    if runs is not None:
        parts.append(runs.agg(F.unix_micros(F.max("finished").cast("timestamp")).alias("value")).select(F.lit("last_run").alias("metric"), "value"))
    return reduce(DataFrame.unionByName, parts)


def stale_collections(results: DataFrame, directories: DataFrame) -> DataFrame:
    """Collections that have results but no directory any more."""
    return results.select("collection").distinct().join(
        directories.select("collection").distinct(), "collection", "left_anti")


def drop_stale(collections: DataFrame, *registries: DataFrame) -> DataFrame:
    """Collections named by at least one registry."""
    named = reduce(DataFrame.unionByName, [r.select("collection") for r in registries]).distinct()
    return collections.join(named, "collection", "left_semi")


def with_collection_name(prechecks: DataFrame, collections: DataFrame) -> DataFrame:
    """Left join on collection_id; rows without one say Unknown."""
    return prechecks.join(collections.select("collection_id", "collection"), "collection_id", "left").withColumn(
        "collection", F.coalesce("collection", F.lit("Unknown")))


def first_seen(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Distinct keys with the position of their first row."""
    return rows.groupBy(*keys).agg(F.min(pos).alias("first_pos"))


def locate_files(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """First configured directory that holds each file.

    ``wanted``: collection, file_name. ``inventory``: collection, file_name, directory, directory_pos.
    """
    return wanted.select("collection", "file_name").distinct().join(inventory, ["collection", "file_name"]).groupBy(
        "collection", "file_name").agg(F.min_by("directory", "directory_pos").alias("directory"))


def file_details(files: DataFrame, members: DataFrame, results: DataFrame, steps: DataFrame) -> DataFrame:
    """All that is known of each file as rows (section, item_pos, item, detail), in long form.

    A file may have any number of members, so they are rows and not one nested value.
    """
    key = ["collection", "file_name"]
    known = files.select(*key)

    def part(df, section, pos, item, detail):
        return df.join(known, key, "left_semi").select(
            *key, F.lit(section).alias("section"), pos.cast("bigint").alias("item_pos"), item.alias("item"),
            detail.alias("detail"))

    parts = [
        files.select(*key, F.lit("file").alias("section"), F.lit(0).cast("bigint").alias("item_pos"),
                     N.member_type(F.col("file_name")).alias("item"), F.col("size").cast("string").alias("detail")),
        part(member_rows(members), "member", F.col("member_pos"), F.col("member_name"),
             F.concat_ws(" ", "member_type", F.col("size").cast("string"), "crc")),
        part(results, "result", F.col("row_pos"), F.col("set_name"), F.concat_ws(" ", "status", "note", "plan")),
        part(steps, "step", F.col("step_pos"), F.col("name"), F.col("description")),
    ]
    return reduce(DataFrame.unionByName, parts)

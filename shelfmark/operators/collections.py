"""Which catalogues belong to which collection, by vendor and collection name.

Names are compared as distinct values, and only pairs that can score at all are formed: both
sides list the keys a positive score needs (canonical alias, a shared word, a leading gram of
the contained name) and meet on equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.functions import tables as T


def _split(text: Column) -> Column:
    """Vendor and rest of a name."""
    parts = F.split(text, " - ", 2)
    two = F.size(parts) == 2
    return F.struct(F.when(two, N.strip(F.get(parts, 0))).otherwise("").alias("vendor"), N.strip(F.element_at(parts, -1)).alias("rest"))


def _bare(rest: Column) -> Column:
    return N.strip(F.regexp_replace(rest, r"(?U)\s*\([^)]*\)", ""))


def _forms(df: DataFrame, name: str, out: str) -> DataFrame:
    """Distinct names with column ``out``: the name after taking off 0, 1, ... source words in front.

    A word comes off while the vendor is a source word and there is another vendor behind it: as
    often as the name has separators, whatever their number.
    """
    text = F.lower(name)

    def step(forms: Column, _: Column) -> Column:
        last = F.element_at(forms, -1)
        strips = last["vendor"].isin(T.SOURCE_PREFIXES) & last["rest"].contains(" - ")
        return F.when(strips, F.concat(forms, F.array(_split(last["rest"])))).otherwise(forms)

    chain = F.aggregate(F.split(text, " - "), F.array(_split(text)), step)
    return df.select(name).distinct().withColumn(out, F.transform(chain, lambda f: F.struct(f["vendor"].alias("vendor"), _bare(f["rest"]).alias("form"))))


def _grams(c: Column) -> Column:
    def of(n):
        last = F.length(c) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda p: F.substring(c, p, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(F.lit("")), of(1), of(2), of(3)))


def _keys(df: DataFrame, name: str, inner: str, outer: str, to_none: str, from_none: str) -> DataFrame:
    """Blocking keys of each name.

    ``inner``/``outer`` tag the two directions of containment. Every key also carries the vendor:
    two names only meet when theirs are equal or at least one has none, as a score asks for.
    ``to_none``/``from_none`` tag the two ways in which one side has no vendor.
    """
    form = F.col("form")
    words = F.transform(N.tokenize(form), lambda t: F.concat(F.lit("w|"), t))
    alias = F.array_compact(F.array(F.concat(F.lit("a|"), N.canonicalize(form))))
    lead = F.array(F.concat(F.lit(inner), F.substring(form, 1, 3)))
    grams = F.transform(_grams(form), lambda g: F.concat(F.lit(outer), g))
    named = F.col("vendor") != ""
    sides = F.when(named, F.array(F.concat(F.lit("v|"), "vendor"), F.lit(to_none))).otherwise(
        F.array(F.lit("none"), F.lit(from_none)))
    forms = _forms(df, name, "_f").select(name, F.explode(F.array_distinct("_f")).alias("f")).select(name, "f.*")
    return (
        forms.select(name, F.explode(sides).alias("side"), F.concat(alias, words, lead, grams).alias("keys"))
        .select(name, "side", F.explode("keys").alias("key")).distinct()
    )


def score_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``score`` for catalogue name ``a`` and collection name ``b``.

    While both vendors are there and differ, source words come off ``a`` first, then off ``b``: the
    forms to compare are the first of ``a`` that agrees with the whole ``b``, or else the last of
    ``a`` and the first of ``b`` that agrees with it.
    """
    def agrees(x: Column, y: Column) -> Column:
        return (x["vendor"] == "") | (y["vendor"] == "") | (x["vendor"] == y["vendor"])

    def first(forms: str, other: Column) -> Column:
        at = F.array_position(F.transform(forms, lambda f: agrees(f, other)), F.lit(True))
        return F.element_at(forms, F.when(at > 0, at).otherwise(F.size(forms)).cast("int"))

    df = pairs.join(_forms(pairs, a, "_fa"), a).join(_forms(pairs, b, "_fb"), b)
    df = df.withColumn("_a", first("_fa", F.get("_fb", 0))).withColumn("_b", first("_fb", F.col("_a")))
    df = df.select(*pairs.columns, (~agrees(F.col("_a"), F.col("_b"))).alias("_apart"), F.col("_a.form").alias("_x"), F.col("_b.form").alias("_y"))
    df = df.withColumns({"_tx": N.tokenize(F.col("_x")), "_ty": N.tokenize(F.col("_y")),
                         "_cx": N.canonicalize(F.col("_x")), "_cy": N.canonicalize(F.col("_y"))})
    x, y = F.col("_x"), F.col("_y")
    common = F.size(F.array_intersect("_tx", "_ty"))
    union = F.size(F.array_union("_tx", "_ty"))
    fewest = F.least(F.size("_tx"), F.size("_ty"))
    score = (
        F.when(F.col("_apart"), 0.0)
        .when(x == y, 100.0)
        .when(F.col("_cx") == F.col("_cy"), 90.0)
        .when(y.contains(x) | x.contains(y), 80.0)
        .when((common > 0) & (common / fewest >= 0.5), common / union * 70.0)
        .otherwise(0.0)
    )
    return df.select(*pairs.columns, score.alias("score"))


def collection_scores(catalogs: DataFrame, collections: DataFrame, threshold: float | None = None) -> DataFrame:
    """All (catalog_name, collection, score) with a positive score, or at least ``threshold``."""
    pairs = (
        _keys(catalogs, "catalog_name", "in|", "out|", "left", "right")
        .join(_keys(collections, "collection", "out|", "in|", "right", "left"), ["side", "key"])
        .select("catalog_name", "collection").distinct()
    )
    scored = score_pairs(pairs, "catalog_name", "collection")
    return scored.filter(F.col("score") > 0 if threshold is None else F.col("score") >= threshold)


def best_collection(catalogs: DataFrame, collections: DataFrame) -> DataFrame:
    """Best collection per catalogue name; the earlier ``pos`` wins ties. ``collections``: collection, pos."""
    pos = collections.groupBy("collection").agg(F.min("pos").alias("pos"))
    return (
        collection_scores(catalogs, collections).join(pos, "collection")
        .groupBy("catalog_name")
        .agg(F.max_by(F.struct("collection", "score"), F.struct("score", -F.col("pos"))).alias("b"))
        .select("catalog_name", "b.*")
    )


def catalogs_for_collections(registry: DataFrame, collections: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Every catalogue whose collection matches, so several sources serve one directory.

    ``registry``: catalog_path, catalog_name.
    """
    names = collection_scores(registry, collections, threshold)
    return names.join(registry.select("catalog_path", "catalog_name").distinct(), "catalog_name")


def ranked_matches(catalogs: DataFrame, collections: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Matches of each collection numbered best first; ``catalogs``: catalog_name, pos."""
    pos = catalogs.groupBy("catalog_name").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("collection").orderBy(F.desc("score"), "pos")
    return (
        collection_scores(catalogs, collections, threshold).join(pos, "catalog_name")
        .withColumn("match_rank", F.row_number().over(order))
    )
